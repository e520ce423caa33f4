"""Rule registry: how each rule type becomes Column expressions.

A row-local rule is a condition plus the text of the failing value. A group
rule names the columns whose repetition makes a row fail. New types are added
with :func:`register_local_rule` or :func:`register_group_rule`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, functions as F, types as T

from plumbrule.functions.text import canonical_of, quoted
from plumbrule.spec import BOOLEAN, DECIMAL, INTEGER, RuleSpec, json_number, normalized_type


@dataclass(frozen=True)
class LocalRule:
    """A row-local rule bound to a schema."""

    fails: Column
    failed_value: Column
    expected_value: str | None
    reason: str


@dataclass(frozen=True)
class GroupRule:
    """A rule on repeated values of ``columns``. One NULL column never repeats; in a wider key NULL is a value."""

    columns: tuple[str, ...]
    failed_value: Column
    expected_value: str
    reason: str


LocalBuilder = Callable[[T.StructType, RuleSpec], "LocalRule | None"]
GroupBuilder = Callable[[T.StructType, RuleSpec], GroupRule]

_local: dict[str, LocalBuilder] = {}
_group: dict[str, GroupBuilder] = {}


def register_local_rule(rule_type: str, build: LocalBuilder) -> None:
    _local[rule_type] = build


def register_group_rule(rule_type: str, build: GroupBuilder) -> None:
    _group[rule_type] = build


def is_supported(rule_type: str) -> bool:
    return rule_type in _local or rule_type in _group


def is_group_rule(rule_type: str) -> bool:
    return rule_type in _group


def local_rule(schema: T.StructType, rule: RuleSpec) -> LocalRule | None:
    """None when the rule can never fail (no bound, empty regex, unknown check)."""
    return _local[rule.rule_type](schema, rule)


def group_rule(schema: T.StructType, rule: RuleSpec) -> GroupRule:
    return _group[rule.rule_type](schema, rule)


def threshold_of(rule: RuleSpec) -> float:
    """Tolerated percentage of NULLs or duplicates before single rows fail."""
    name = "max_null_percentage" if rule.rule_type == "COMPLETENESS" else "max_duplicate_percentage"
    return float(rule.definition.get(name, 0.0) or 0.0)


def _none() -> Column:
    return F.lit(None).cast("string")


# Fixed output: expected values and reasons are stored with failures and read as they stand.


def _completeness(schema: T.StructType, rule: RuleSpec) -> LocalRule:
    limit = float(rule.definition.get("max_null_percentage", 0.0) or 0.0)
    return LocalRule(
        fails=F.col(rule.column).isNull(), failed_value=_none(), expected_value="NOT NULL",
        reason=f"Column '{rule.column}' is null (max_null_percentage={limit})")


def _range(schema: T.StructType, rule: RuleSpec) -> LocalRule | None:
    low, high = rule.definition.get("min"), rule.definition.get("max")
    data_type = schema[rule.column].dataType
    comparable = normalized_type(data_type) in (INTEGER, DECIMAL, BOOLEAN) or isinstance(data_type, T.StringType)
    if (low is None and high is None) or not comparable:
        return None
    number = F.col(rule.column).try_cast("double")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (number < float(low))
    if high is not None:
        outside = outside | (number > float(high))
    span = f"[{json_number(low)}, {json_number(high)}]"
    return LocalRule(
        fails=F.coalesce(outside & ~F.isnan(number), F.lit(False)),
        failed_value=canonical_of(schema, rule.column), expected_value=span,
        reason=f"Value outside range {span}")


def _pattern(schema: T.StructType, rule: RuleSpec) -> LocalRule | None:
    regex = rule.definition.get("regex")
    if not regex:
        return None
    text = canonical_of(schema, rule.column)
    return LocalRule(
        fails=F.coalesce(~text.rlike(start_anchored(regex)), F.lit(False)),
        failed_value=text, expected_value=regex, reason=f"Value does not match pattern '{regex}'")


def start_anchored(regex: str) -> str:
    """Match from the start of the text, not necessarily to its end."""
    return f"^(?:{regex})"


def _cross_column(schema: T.StructType, rule: RuleSpec) -> LocalRule | None:
    if rule.definition.get("check", "all_equal") != "all_equal":
        return None
    kinds = {normalized_type(schema[c].dataType) for c in rule.columns}
    typed = len(kinds) == 1 or kinds <= {INTEGER, DECIMAL}
    values = [F.col(c) if typed else canonical_of(schema, c) for c in rule.columns]
    equal = F.lit(True)
    for other in values[1:]:
        equal = equal & values[0].eqNullSafe(other)
    shown = F.concat(F.lit("["), F.concat_ws(
        ", ", *[F.coalesce(canonical_of(schema, c), F.lit("None")) for c in rule.columns]), F.lit("]"))
    return LocalRule(
        fails=~equal, failed_value=shown, expected_value="all equal",
        reason=f"Columns {quoted(rule.columns)} are not all equal")


def _uniqueness(schema: T.StructType, rule: RuleSpec) -> GroupRule:
    return GroupRule(
        columns=rule.columns, failed_value=canonical_of(schema, rule.column), expected_value="UNIQUE",
        reason=f"Duplicate value in column '{rule.column}'")


def _duplicate(schema: T.StructType, rule: RuleSpec) -> GroupRule:
    return GroupRule(
        columns=tuple(sorted(schema.names)), failed_value=_none(), expected_value="UNIQUE row",
        reason="Full-row duplicate")


register_local_rule("COMPLETENESS", _completeness)
register_local_rule("RANGE", _range)
register_local_rule("PATTERN", _pattern)
register_local_rule("CROSS_COLUMN", _cross_column)
register_group_rule("UNIQUENESS", _uniqueness)
register_group_rule("DUPLICATE", _duplicate)

__all__ = [
    "GroupRule", "LocalRule", "group_rule", "is_group_rule", "is_supported", "local_rule",
    "register_group_rule", "register_local_rule", "start_anchored", "threshold_of",
]
