"""Row-local rules on a streaming DataFrame.

COMPLETENESS, RANGE, PATTERN and CROSS_COLUMN look at one row at a time, so
their Columns apply unchanged to a stream and need no state or watermark.
Rules on repeated values and thresholds need the whole table and are refused.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from plumbrule.operators import rules as R
from plumbrule.operators.validate import Validation, validate
from plumbrule.spec import KeySpec, RuleSpec, SpecError


def validate_stream(df: DataFrame, rules: Sequence[RuleSpec], key: KeySpec, run_id: str = "stream") -> Validation:
    """Evaluate row-local rules; ``results()`` and ``failures()`` of the outcome are streaming frames."""
    for rule in rules:
        if R.is_supported(rule.rule_type) and R.is_group_rule(rule.rule_type):
            raise SpecError(f"{rule.assignment_id}: {rule.rule_type} needs the whole table")
        if rule.rule_type == "COMPLETENESS" and R.threshold_of(rule) > 0:
            raise SpecError(f"{rule.assignment_id}: a threshold needs the whole table")
    return validate(df, rules, key, run_id)
