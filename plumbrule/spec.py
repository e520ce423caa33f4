"""Plain configuration: keys, rules and the seven normalized column types."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Iterable, Mapping

from pyspark.sql import types as T

# Normalized types.
INTEGER, DECIMAL, BOOLEAN = "INTEGER", "DECIMAL", "BOOLEAN"
DATE, DATETIME, STRING, TEXT = "DATE", "DATETIME", "STRING", "TEXT"
NUMERIC_TYPES = (INTEGER, DECIMAL)
TEXT_TYPES = (STRING, TEXT)
TEMPORAL_TYPES = (DATE, DATETIME)

# Key strategies.
SINGLE_COLUMN, COMPOSITE, ROW_INDEX = "SINGLE_COLUMN", "COMPOSITE", "ROW_INDEX_FALLBACK"

# Rule types, scopes and severities.
RULE_TYPES = ("COMPLETENESS", "UNIQUENESS", "DUPLICATE", "RANGE", "PATTERN", "CROSS_COLUMN")
SCOPE_SINGLE, SCOPE_DATASET, SCOPE_CROSS = "SINGLE_COLUMN", "DATASET_LEVEL", "CROSS_COLUMN"
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
FAILING_SEVERITIES = ("CRITICAL", "HIGH")


class SpecError(ValueError):
    """A key or rule does not fit the table it is bound to."""


def normalized_type(data_type: T.DataType) -> str:
    """Collapse a Spark type onto the normalized set; unknown types are STRING."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.DecimalType, T.FloatType, T.DoubleType)):
        return DECIMAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return STRING


#: Metadata of a column whose source type is narrower than its Spark type.
NORMALIZED = "normalized_type"


def normalized_of(column: T.StructField) -> str:
    """The normalized type a source declared for a column, else that of its Spark type.

    Spark has one string type; unbounded text is told from short strings by what the source's catalog says.
    """
    return (column.metadata or {}).get(NORMALIZED) or normalized_type(column.dataType)


def staging_type(data_type: T.DataType) -> T.DataType:
    """Column type of a materialized staging table."""
    kind = normalized_type(data_type)
    if kind == INTEGER:
        return T.LongType()
    if kind == DECIMAL:
        if isinstance(data_type, T.DecimalType):
            return data_type
        return T.DoubleType()
    if kind == BOOLEAN:
        return T.BooleanType()
    if kind == DATE:
        return T.DateType()
    if kind == DATETIME:
        return T.TimestampNTZType()
    return T.StringType()


@dataclass(frozen=True)
class KeySpec:
    """How a row of a dataset is addressed."""

    columns: tuple[str, ...] = ()

    @property
    def strategy(self) -> str:
        if not self.columns:
            return ROW_INDEX
        return SINGLE_COLUMN if len(self.columns) == 1 else COMPOSITE

    @property
    def is_reliable(self) -> bool:
        return bool(self.columns)


def declare_key(schema: T.StructType, columns: Iterable[tuple[int, str]]) -> KeySpec:
    """Build a key from (ordinal, column) pairs, refusing repeats and unknown columns."""
    pairs = list(columns)
    if not pairs:
        raise SpecError("a key needs at least one column")
    ordinals = [ordinal for ordinal, _ in pairs]
    names = [name for _, name in pairs]
    if len(set(ordinals)) != len(ordinals):
        raise SpecError("key ordinals must be unique")
    if len(set(names)) != len(names):
        raise SpecError("key columns must be unique")
    unknown = sorted(set(names) - set(schema.names))
    if unknown:
        raise SpecError(f"unknown key columns: {unknown}")
    return KeySpec(tuple(name for _, name in sorted(pairs)))


def effective_key(declared: KeySpec, active_columns: Iterable[str]) -> KeySpec:
    """The declared key restricted to columns that are still active."""
    active = set(active_columns)
    return KeySpec(tuple(c for c in declared.columns if c in active))


@dataclass(frozen=True)
class RuleSpec:
    """One rule version bound to a dataset (an assignment)."""

    assignment_id: str
    rule_type: str
    columns: tuple[str, ...] = ()
    definition: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "MEDIUM"
    rule_id: str = ""
    rule_name: str = ""
    version: int = 1
    is_enabled: bool = True

    @property
    def column(self) -> str | None:
        return self.columns[0] if len(self.columns) == 1 else None

    @property
    def scope(self) -> str:
        if self.rule_type == "DUPLICATE":
            return SCOPE_DATASET
        return SCOPE_CROSS if self.rule_type == "CROSS_COLUMN" else SCOPE_SINGLE

    @property
    def cross_column_key(self) -> str | None:
        """Order-independent identity of a cross-column assignment."""
        return "|".join(sorted(self.columns)) if self.scope == SCOPE_CROSS else None


def check_rules(schema: T.StructType, rules: Iterable[RuleSpec]) -> list[RuleSpec]:
    """Validate shapes against the schema, refuse duplicates, drop disabled rules.

    Unsupported rule types pass through: evaluation skips and counts them.
    """
    known = set(schema.names)
    seen: set[tuple] = set()
    enabled: list[RuleSpec] = []
    for rule in rules:
        if rule.severity not in SEVERITIES:
            raise SpecError(f"{rule.assignment_id}: unknown severity {rule.severity!r}")
        if rule.rule_type in RULE_TYPES:
            unknown = sorted(set(rule.columns) - known)
            if unknown:
                raise SpecError(f"{rule.assignment_id}: columns not in the dataset: {unknown}")
            if rule.scope == SCOPE_DATASET and rule.columns:
                raise SpecError(f"{rule.assignment_id}: a dataset-level rule takes no column")
            if rule.scope == SCOPE_CROSS and len(set(rule.columns)) < 2:
                raise SpecError(f"{rule.assignment_id}: a cross-column rule needs two or more columns")
            if rule.scope == SCOPE_SINGLE and len(rule.columns) != 1:
                raise SpecError(f"{rule.assignment_id}: {rule.rule_type} needs exactly one column")
        identity = (rule.rule_id or rule.assignment_id, rule.version, rule.scope,
                    rule.cross_column_key or rule.columns)
        if identity in seen:
            raise SpecError(f"{rule.assignment_id}: duplicate assignment")
        seen.add(identity)
        if rule.is_enabled:
            enabled.append(rule)
    return enabled


def disable(rule: RuleSpec) -> RuleSpec:
    """Soft-disable: the assignment stays, evaluation ignores it."""
    return replace(rule, is_enabled=False)


def json_number(value: Any) -> str:
    """Bounds as they appear in failure reasons: the JSON spelling, None for open."""
    return "None" if value is None else str(value)
