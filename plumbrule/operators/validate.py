"""Evaluate rules over a whole table.

Plan shape: one scan with every row-local rule in a single projection, which
is cut down to (record_ref, hash, failures) before anything shuffles. All group
rules share one narrow count of keys and one way to find the rows that hold
repeated ones (:mod:`plumbrule.functions.repeats`). Thresholds above 0 are settled
by those counts and one aggregate of NULLs; rules that pass are left out of
the plan altogether.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrule.functions import text
from plumbrule.functions.repeats import key_counts, key_hashes, mark_repeated, repeated_keys
from plumbrule.operators import rules as R
from plumbrule.spec import (
    FAILING_SEVERITIES, KeySpec, RuleSpec, SpecError, check_rules,
)

# Stored failures per run, rule types whose result needs every row.
EXACT_RULE_TYPES = ("COMPLETENESS", "UNIQUENESS", "DUPLICATE", "CROSS_COLUMN")

_FAILURE = "struct<ordinal:int,failed_value:string>"


def needs_full_scan(rules: Sequence[RuleSpec]) -> bool:
    """Whether any rule's verdict depends on seeing every row."""
    return any(r.rule_type in EXACT_RULE_TYPES for r in rules)


def column_stats(df: DataFrame, nulls: Sequence[str], repeats: Sequence[str]) -> dict[str, dict[str, int]]:
    """Exact total, NULL and distinct counts of a few columns.

    NULL counts share one scan, and all distinct counts one count of keys, in which a frequent
    value is combined before the shuffle.
    """
    out: dict[str, dict[str, int]] = {}
    if nulls:
        row = df.agg(F.count(F.lit(1)).alias("total"),
                     *[F.count(c).alias(f"n_{i}") for i, c in enumerate(nulls)]).first()
        for i, c in enumerate(nulls):
            out[c] = {"total": row["total"], "nulls": row["total"] - row[f"n_{i}"]}
    if repeats:
        counted = key_counts(df, {i: (c,) for i, c in enumerate(repeats)}).groupBy("o").agg(
            F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("k1").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("k1").alias("distinct"))
        rows = {r["o"]: r for r in counted.collect()}
        for i, c in enumerate(repeats):
            out.setdefault(c, {}).update({k: rows[i][k] if i in rows else 0 for k in ("total", "nulls", "distinct")})
    return out


def _tolerated(df: DataFrame, rules: Sequence[RuleSpec], repeated: DataFrame | None) -> set[str]:
    """Assignments that pass as a whole. A threshold of 0 needs no statistics."""
    tolerant = [(i, r) for i, r in enumerate(rules) if r.rule_type in ("COMPLETENESS", "UNIQUENESS") and R.threshold_of(r) > 0]
    if not tolerant:
        return set()
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(r.column).alias(f"n{i}") for i, r in tolerant]).first()
    again: dict[int, int] = {}
    if repeated is not None:
        # One row per rule: how many rows repeat a value that an earlier one holds.
        again = {r["o"]: r["again"] for r in repeated.groupBy("o").agg(F.sum(F.col("n") - 1).alias("again")).collect()}
    passed = set()
    for i, r in tolerant:
        bad = row["total"] - row[f"n{i}"] if r.rule_type == "COMPLETENESS" else again.get(i, 0)
        if row["total"] and 100.0 * bad / row["total"] <= R.threshold_of(r):
            passed.add(r.assignment_id)
    return passed


@dataclass(frozen=True)
class Validation:
    """Outputs of one validation run, all derived from ``evaluated``.

    ``evaluated`` has one row per source row: record_ref, row_index,
    source_row_hash, failures array<struct<ordinal, failed_value>>. Write it
    once (:meth:`stored`) when several outputs are needed.
    """

    run_id: str
    rules: tuple[RuleSpec, ...]
    evaluated: DataFrame
    described: tuple[tuple, ...]

    @property
    def spark(self) -> SparkSession:
        return self.evaluated.sparkSession

    def stored(self, path: str) -> "Validation":
        """Write the evaluated rows once and continue from the written table."""
        self.evaluated.write.mode("errorifexists").parquet(path)
        return Validation(self.run_id, self.rules, self.spark.read.parquet(path), self.described)

    def _status(self) -> Column:
        failing = [i for i, r in enumerate(self.rules) if r.severity in FAILING_SEVERITIES]
        severe = F.exists("failures", lambda f: f["ordinal"].isin(failing)) if failing else F.lit(False)
        return (F.when(F.size("failures") == 0, F.lit("PASSED"))
                .when(severe, F.lit("FAILED")).otherwise(F.lit("WARNING")))

    def results(self) -> DataFrame:
        """One row per source row with its status."""
        return self.evaluated.select(
            F.lit(self.run_id).alias("run_id"), "record_ref", "row_index",
            self._status().alias("status"), F.size("failures").alias("failure_count"), "source_row_hash")

    @cached_property
    def rule_table(self) -> DataFrame:
        """The evaluated assignments as a DataFrame (one row per rule)."""
        return self.spark.createDataFrame(
            [tuple(d) for d in self.described],
            "ordinal int, assignment_id string, rule_id string, rule_name string, rule_type string, "
            "column_name string, severity string, expected_value string, reason string, supported boolean")

    def failures(self) -> DataFrame:
        """One row per (row, failing assignment).

        The rule's constant fields come from literals looked up by position,
        so no join is needed.
        """
        def field(i: int) -> Column:
            values = F.array(*[F.lit(d[i]).cast("string") for d in self.described])
            return F.get(values, F.col("f.ordinal"))

        exploded = self.evaluated.select(
            "record_ref", "row_index", "source_row_hash", F.explode("failures").alias("f"))
        return exploded.select(
            F.lit(self.run_id).alias("run_id"), "record_ref", "row_index", "source_row_hash",
            F.col("f.ordinal").alias("rule_ordinal"), field(1).alias("assignment_id"),
            field(4).alias("rule_type"), field(5).alias("column_name"), field(6).alias("severity"),
            F.col("f.failed_value").alias("failed_value"), field(7).alias("expected_value"),
            field(8).alias("reason"))

    def stored_failures(self, cap: int | None = None) -> DataFrame:
        """All failures; with ``cap`` a report of the first in row, then assignment order (a top-k, not a full sort)."""
        order = ["row_index", "record_ref", "rule_ordinal"]
        return self.failures() if cap is None else self.failures().orderBy(*order).limit(cap)

    def summary(self) -> DataFrame:
        """Row counts and the quality score: 100 * passed / total, NULL for an empty table."""
        status = self._status()
        counted = self.evaluated.select(status.alias("s"), F.size("failures").alias("n")).agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("s") == "PASSED").alias("passed_rows"),
            F.count_if(F.col("s") == "WARNING").alias("warning_rows"),
            F.count_if(F.col("s") == "FAILED").alias("failed_rows"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("failure_count"))
        return counted.select(
            F.lit(self.run_id).alias("run_id"), "total_rows", "passed_rows", "warning_rows", "failed_rows",
            text.percent(F.col("passed_rows"), F.col("total_rows")).alias("quality_score"), "failure_count",
            F.lit(len(self.rules)).alias("rules_evaluated_count"),
            F.lit(len(self.rules) == 0).alias("no_applicable_rules"))

    def metrics(self, cap: int | None = None) -> DataFrame:
        """Named run metrics. An empty table reports only its size. ``cap`` is that of a capped report, if one was stored."""
        base = self.summary().select(
            F.col("total_rows").cast("bigint").alias("n"),
            F.when(F.lit(cap is not None) & (F.col("failure_count") >= (cap or 0)) & (F.col("total_rows") > 0), 1).otherwise(0)
            .cast("bigint").alias("cut"))
        rows = [
            F.struct(F.lit("total_rows").alias("metric_name"), F.lit(None).cast("string").alias("metric_group"),
                     F.col("n").alias("metric_value")),
            F.struct(F.lit("failure_storage_truncated").alias("metric_name"),
                     F.lit(None).cast("string").alias("metric_group"), F.col("cut").alias("metric_value")),
        ]
        skipped: dict[str, int] = {}
        for d in self.described:
            if d[9]:
                rows.append(F.struct(F.lit("rule_evaluated").alias("metric_name"), F.lit(d[1]).alias("metric_group"),
                                     F.lit(1).cast("bigint").alias("metric_value")))
            else:
                skipped[d[4]] = skipped.get(d[4], 0) + 1
        for rule_type, n in sorted(skipped.items()):
            rows.append(F.struct(F.lit("unsupported_rule_type_skipped").alias("metric_name"),
                                 F.lit(rule_type).alias("metric_group"), F.lit(n).cast("bigint").alias("metric_value")))
        kept = F.when(F.col("n") > 0, F.array(*rows)).otherwise(F.array(*rows[:2]))
        return base.select(F.inline(kept)).select(
            F.lit(self.run_id).alias("run_id"), "metric_name", "metric_group", "metric_value")


def validate(
    df: DataFrame,
    rules: Sequence[RuleSpec],
    key: KeySpec,
    run_id: str = "run",
    row_index: str | None = None,
    is_full_scan: bool = True,
) -> Validation:
    """Evaluate every enabled rule over the whole of ``df``.

    Keys that several rows share are found at once, before the result is lazily evaluated. ``is_full_scan``
    says whether ``df`` is the whole table; a sample is refused when a rule needs every row.

    Without a key, ``row_index`` names a column with the row's position (see
    :func:`plumbrule.sources.tables.with_row_index`); it is not part of the
    row for hashing and duplicate checks.
    """
    checked = check_rules(df.schema, rules)
    source = df.drop(row_index) if row_index else df
    schema = source.schema
    if not key.is_reliable and row_index is None:
        raise SpecError("a dataset without a key needs row_index")
    if not is_full_scan and needs_full_scan(checked):
        raise SpecError("a rule that compares rows or counts them needs the whole table, not a sample")
    groups = {i: R.group_rule(schema, r) for i, r in enumerate(checked) if R.is_group_rule(r.rule_type)}
    repeated = repeated_keys(source, {i: g.columns for i, g in groups.items()}) if groups else None
    passed = _tolerated(source, checked, repeated)

    described, local, grouped = [], [], []
    for ordinal, rule in enumerate(checked):
        supported = R.is_supported(rule.rule_type)
        built = None
        if supported and R.is_group_rule(rule.rule_type):
            built = groups[ordinal]
            if rule.assignment_id not in passed:
                grouped.append((ordinal, built))
        elif supported:
            built = R.local_rule(schema, rule)
            if built is not None and rule.assignment_id not in passed:
                local.append((ordinal, built))
        described.append((
            ordinal, rule.assignment_id, rule.rule_id, rule.rule_name, rule.rule_type, rule.column,
            rule.severity, built.expected_value if built else None, built.reason if built else None, supported))

    ref = text.record_ref(schema, key, F.col(row_index) if row_index else None)

    def failure(ordinal: int, value: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), value.alias("failed_value"))

    found = F.array(*[F.when(b.fails, failure(o, b.failed_value)) for o, b in local]) if local \
        else F.array().cast(f"array<{_FAILURE}>")
    hashes = {o: key_hashes(schema, b.columns) for o, b in grouped}
    rows = df.select(
        ref.alias("record_ref"),
        (F.col(row_index) if row_index else F.lit(None)).cast("bigint").alias("row_index"),
        text.row_hash(schema).alias("source_row_hash"),
        F.filter(found, lambda f: f.isNotNull()).cast(f"array<{_FAILURE}>").alias("failures"),
        *[h.alias(f"_{x}{o}") for o, pair in hashes.items() for x, h in zip("ab", pair, strict=True)],
        *[b.failed_value.alias(f"_v{o}") for o, b in grouped])
    if grouped:
        rows = mark_repeated(rows, repeated, [o for o, _ in grouped], ["record_ref", "row_index", "source_row_hash"])
        extra = F.array_compact(F.array(*[
            F.when(F.array_contains("_repeats", o), failure(o, F.col(f"_v{o}"))) for o, _ in grouped])).cast(f"array<{_FAILURE}>")
        rows = rows.withColumn("failures", F.array_sort(F.concat("failures", extra))).drop(
            "_repeats", *[f"_v{o}" for o, _ in grouped])
    return Validation(run_id, tuple(checked), rows, tuple(described))
