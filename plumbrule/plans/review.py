"""From a table and its rules to issues with suggestions and ranked evidence."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.functions.storage import cut_lineage
from plumbrule.operators import generate
from plumbrule.operators.evidence import rank
from plumbrule.operators.evidence.progression import column_values
from plumbrule.operators.evidence.relationship import relationship_evidence
from plumbrule.operators.evidence.roles import applicable_strategies, column_roles
from plumbrule.operators.evidence.sequence import sequence_evidence
from plumbrule.operators.evidence.template import closed_targets, template_evidence_for_columns
from plumbrule.operators.evidence.temporal import temporal_evidence
from plumbrule.operators.validate import Validation
from plumbrule.spec import KeySpec, RuleSpec, TEXT_TYPES, normalized_type


def assignment_table(df: DataFrame, rules: Sequence[RuleSpec]) -> DataFrame:
    """Rule specs as a DataFrame (configuration, one row per assignment)."""
    rows = [(r.assignment_id, r.rule_id or r.assignment_id, r.rule_name, r.rule_type, r.version, r.severity,
             r.column, json.dumps(dict(r.definition))) for r in rules]
    return df.sparkSession.createDataFrame(
        rows, "assignment_id string, rule_id string, rule_name string, rule_type string, version int, "
              "severity string, column_name string, definition string")


@dataclass(frozen=True)
class Review:
    issues: DataFrame
    suggestions: DataFrame


def open_review(df: DataFrame, validation: Validation, profiles: DataFrame, runs: DataFrame, review_run_id: str,
                created_at: Column) -> Review:
    """Issues of a completed run and their deterministic suggestions."""
    issues = generate.create_issues(validation.failures(), runs, review_run_id, validation.run_id, created_at)
    return Review(issues, generate.suggest(issues, assignment_table(df, validation.rules), profiles))


def typed_issues(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues with the normalized type of their column."""
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(normalized_type(f.dataType)))])
    return issues.withColumn("normalized_data_type", F.element_at(kinds, F.col("column_name")))


def gather_evidence(df: DataFrame, key: KeySpec, issues: DataFrame, profiles: DataFrame,
                    key_changes: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Ranked evidence for every issue whose record can be addressed.

    With ``key_changes`` (dataset_id, changed_at) and ``runs`` (run_id, dataset_id, created_at), issues of
    runs that are older than the key of their dataset get none.

    The number of evidence passes depends on the columns under review, which
    are read from the issues first (at most one row per column and rule type);
    each pass then serves all issues of its column. The located issues are
    checkpointed, because every pass reads them.
    """
    typed = typed_issues(df, issues)
    if key_changes is not None and runs is not None:
        typed = rank.stale_keys(typed, key_changes, runs)
    else:
        typed = typed.withColumn("key_changed", F.lit(False))
    kinds = F.array_sort(applicable_strategies(F.col("normalized_data_type"), F.col("rule_type")))
    located = rank.locate_issues(df, key, typed)
    usable = cut_lineage(located.where(rank.availability(
        key, F.col("key_changed"), F.col("record_ref"), F.col("matches")) == "AVAILABLE"))
    wanted = usable.where(F.col("column_name").isNotNull()).select(
        "column_name", F.explode(kinds).alias("strategy")).distinct().collect()
    columns: dict[str, list[str]] = {}
    for row in wanted:
        columns.setdefault(row["strategy"], []).append(row["column_name"])

    found: list[DataFrame] = []
    for family, judge in (("SEQUENCE", sequence_evidence), ("TEMPORAL", temporal_evidence)):
        if family in columns:
            verdicts = judge(column_values(df, sorted(columns[family])))
            found.append(rank.column_candidates(usable.drop("row", "matches"), verdicts, family))
    roles = {}
    if "RELATIONSHIP" in columns:
        roles = {r["column_name"]: r["role"] for r in column_roles(profiles, key.columns).orderBy("ordinal").collect()}
    for target in sorted(columns.get("RELATIONSHIP", [])):
        rows = usable.where((F.col("column_name") == target) & F.array_contains(kinds, "RELATIONSHIP"))
        verdicts = relationship_evidence(
            df, rows.select("issue_id", "row.*"), target,
            [c for c, r in roles.items() if r == "DIMENSION"], [c for c, r in roles.items() if r == "MEASURE"])
        found.append(rank.relationship_candidates(verdicts))
    words = [f.name for f in df.schema.fields if normalized_type(f.dataType) in TEXT_TYPES]
    targets = {t: [w for w in words if w != t] for t in sorted(columns.get("TEMPLATE", []))}
    targets = {t: sources for t, sources in targets.items() if sources}
    if targets:
        rows = usable.where(F.col("column_name").isin(*targets) & F.array_contains(kinds, "TEMPLATE"))
        training = closed_targets(df, text.record_ref(df.schema, key), issues, targets)
        verdicts = template_evidence_for_columns(
            training, rows.select("issue_id", F.col("column_name").alias("_column"), "row.*"), targets, "_closed")
        found.append(rank.template_candidates(verdicts))
    if not found:
        empty = typed.select("issue_id").where(F.lit(False))
        candidates = empty.select("issue_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("value", "string"), ("strategy", "string"), ("confidence", "double"), ("supporting_count", "bigint"),
            ("contradicting_count", "bigint"))])
    else:
        candidates = found[0]
        for more in found[1:]:
            candidates = candidates.unionByName(more)
    return rank.rank_candidates(candidates, usable)
