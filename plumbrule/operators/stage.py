"""Stage, check and materialize corrected rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from plumbrule.functions import text
from plumbrule.functions.grouping import join_small, keep_matching
from plumbrule.functions.ordered import number_in_group
from plumbrule.operators import rules as R
from plumbrule.operators.evidence.rank import locate_issues
from plumbrule.sources.sinks import delete_path, export_snapshots, resolve_target, swap
from plumbrule.spec import KeySpec, RuleSpec, check_rules, normalized_type, staging_type

# Words of a BOOLEAN correction, drift and revalidation outcomes.
TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")
UNCHANGED, CHANGED, NOT_FOUND = "UNCHANGED", "VALUE_CHANGED", "RECORD_NOT_FOUND"
PASS, FAIL, NEEDS_DATASET = "REVALIDATED_PASS", "REVALIDATED_FAIL", "REQUIRES_DATASET_REVALIDATION"


class StagingError(ValueError):
    """Corrections that cannot be staged."""


def field_corrections(scope: DataFrame) -> DataFrame:
    """One row per (record, column) with its integrity problem, NULL when sound.

    Agreeing corrections of one column collapse; a missing or a second,
    different value is a problem.
    """
    grouped = scope.where(F.col("column_name").isNotNull()).groupBy("record_ref", "column_name").agg(
        F.min("issue_id").alias("issue_id"), F.min("original_value").alias("original_value"),
        F.min("final_value").alias("final_value"), F.max("final_value").alias("_other"),
        F.count_if(F.col("final_value").isNull()).alias("_missing"), F.count(F.lit(1)).alias("issue_count"))
    problem = (F.when(F.col("_missing") > 0, "missing final value")
               .when(F.col("final_value") != F.col("_other"), "conflicting final values"))
    return grouped.select("record_ref", "column_name", "issue_id", "original_value", "final_value", "issue_count",
                          problem.alias("problem"))


def integrity_problems(scope: DataFrame) -> DataFrame:
    return field_corrections(scope).where(F.col("problem").isNotNull())


def check_integrity(scope: DataFrame) -> None:
    """Refuse the run when any correction is missing or contradictory."""
    found = integrity_problems(scope).limit(5).collect()
    if found:
        raise StagingError("; ".join(f"{r['record_ref']}/{r['column_name']}: {r['problem']}" for r in found))


def corrected_records(scope: DataFrame) -> DataFrame:
    """One row per record with the array of its corrected fields (at most one per column)."""
    return field_corrections(scope).groupBy("record_ref").agg(F.array_sort(F.collect_list(F.struct(
        "column_name", "original_value", "final_value", "issue_id"))).alias("corrected_fields"))


def _json_member(name: str, value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def stage_records(df: DataFrame, key: KeySpec, scope: DataFrame) -> DataFrame:
    """Snapshot and drift of every corrected record against the current source.

    Drift looks at corrected fields only. A record that is gone keeps just its
    corrected fields. Output: record_ref, corrected_fields, row_snapshot
    (JSON, keys in name order), source_row_hash, drift_status, drift_fields.
    """
    records = corrected_records(scope).withColumn("issue_id", F.col("record_ref"))
    if key.is_reliable:
        located = locate_issues(df, key, records, unique_only=False)
    else:
        empty = F.lit(None).cast(T.StructType(df.schema.fields))
        located = records.withColumn("matches", F.lit(0).cast("bigint")).withColumn("row", empty)
    there = F.col("matches") > 0

    def fixed(name: str) -> Column:
        return F.get(F.filter("corrected_fields", lambda f: f["column_name"] == name), F.lit(0))

    members, drifted = [], []
    for name in sorted(df.columns):
        current = F.col("row").getField(name)
        fix = fixed(name)
        members.append(F.when(fix.isNotNull(), _json_member(name, fix["final_value"]))
                       .when(there, _json_member(name, current)))
        shown = F.to_json(current) if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) \
            else current.cast("string")
        drifted.append(F.when(fix.isNotNull() & ~shown.eqNullSafe(fix["original_value"]), F.lit(name)))
    changed = F.filter(F.array(*drifted), lambda c: c.isNotNull())
    status = (F.when(~there, NOT_FOUND).when(F.size(changed) > 0, CHANGED).otherwise(UNCHANGED))
    return located.select(
        "record_ref", "corrected_fields",
        F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("row_snapshot"),
        F.when(there, text.staging_hash(df.columns, "row")).alias("source_row_hash"),
        status.alias("drift_status"), F.when(status == CHANGED, changed).alias("drift_fields"))


def drifted_records(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("drift_status") != UNCHANGED)


def staging_summary(staged: DataFrame) -> DataFrame:
    return staged.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.sum(F.size("corrected_fields")), F.lit(0)).cast("bigint").alias("field_count"),
        F.coalesce(F.bool_or(F.col("drift_status") != UNCHANGED), F.lit(False)).alias("has_source_drift"))


def attempts(runs: DataFrame) -> DataFrame:
    """Number the staging attempts of each review; the last one is current."""
    numbered = number_in_group(runs, "review_run_id", "created_at", "staging_run_id", "attempt_number", "_attempts")
    return numbered.withColumn("is_current", F.col("attempt_number") == F.col("_attempts")).drop("_attempts")


def coerced(value: Column, data_type: T.DataType) -> Column:
    """Correction text as a typed value, NULL when it does not fit."""
    kind = normalized_type(data_type)
    stripped = text.strip(value)
    word = F.lower(stripped)
    if kind == "INTEGER":
        return F.when(stripped.rlike(r"^[+-]?[0-9]+$"), stripped.try_cast("bigint"))
    if kind == "DECIMAL":
        return stripped.try_cast(staging_type(data_type))
    if kind == "BOOLEAN":
        return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    if kind == "DATE":
        return F.when(stripped.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(stripped, 1, 10).try_cast("date"))
    if kind == "DATETIME":
        iso = stripped.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
        return F.when(iso, F.coalesce(stripped.try_cast("timestamp_ntz"),
                                      F.substring(stripped, 1, 10).try_cast("timestamp_ntz")))
    return value


def uncoercible(corrections: DataFrame, schema: T.StructType) -> DataFrame:
    """Corrections whose text does not fit their column."""
    fits = F.lit(True)
    for f in schema.fields:
        fits = F.when(F.col("column_name") == f.name, coerced(F.col("final_value"), f.dataType).isNotNull()).otherwise(fits)
    return corrections.where(F.col("final_value").isNotNull() & ~fits)


def overlay(df: DataFrame, key: KeySpec, corrections: DataFrame) -> DataFrame:
    """All rows of ``df`` in staging types, with corrections applied by key.

    ``corrections``: record_ref, column_name, final_value, at most one per
    pair. They are pivoted to one row per record; how they are joined depends
    on their checked number, so a small set never shuffles the table. A
    dataset without a key is copied unchanged.
    """
    typed = df.select(*[F.col(f.name).cast(staging_type(f.dataType)).alias(f.name) for f in df.schema.fields])
    if not key.is_reliable:
        return typed
    fixes = corrections.groupBy("record_ref").agg(*[
        F.max(F.when(F.col("column_name") == f.name, F.struct(
            F.lit(True).alias("has"), coerced(F.col("final_value"), f.dataType).alias("v")))).alias(f"_fix{i}")
        for i, f in enumerate(df.schema.fields)])
    keyed = df.withColumn("record_ref", text.record_ref(df.schema, key))
    joined = join_small(keyed, fixes, ["record_ref"], "left")
    return joined.select(*[
        F.when(F.col(f"_fix{i}.has"), F.col(f"_fix{i}.v").cast(staging_type(f.dataType)))
        .otherwise(F.col(f.name).cast(staging_type(f.dataType))).alias(f.name)
        for i, f in enumerate(df.schema.fields)])


def materialize(df: DataFrame, key: KeySpec, corrections: DataFrame, path: str) -> int:
    """Write the corrected copy; returns its row count.

    Refuses uncoercible text before anything is written. The copy becomes
    visible at ``path`` only after its count equals the source's, which is
    taken while the source is read for the copy. An older copy is moved aside
    first and comes back if the new one cannot take its place; nothing
    else is left behind.
    """
    bad = uncoercible(corrections, df.schema).limit(5).collect()
    if bad:
        raise StagingError("; ".join(f"{r['column_name']}: {r['final_value']!r} does not fit" for r in bad))
    spark = df.sparkSession
    pending = f"{path.rstrip('/')}__pending-{uuid.uuid4().hex}"
    seen = Observation()
    try:
        overlay(df.observe(seen, F.count(F.lit(1)).alias("rows")), key, corrections).write.parquet(pending)
        written, source = spark.read.parquet(pending).count(), seen.get["rows"]
        if written != source:
            raise StagingError(f"copied {written} of {source} rows")
        swap(spark, pending, path)
    except BaseException:
        delete_path(spark, pending)
        raise
    return written


@dataclass(frozen=True)
class Copy:
    """A corrected copy of a Parquet table: files that were rewritten, and those that are taken over as they are."""

    path: str
    rewritten: int
    taken_over: int
    rows: int


_MANIFEST = "_taken_over"


def copy_on_write(spark: SparkSession, source: str, key: KeySpec, corrections: DataFrame, path: str) -> Copy:
    """The corrected copy of a Parquet table at ``path``, in which only files that hold a corrected key are rewritten.

    The others are named in a manifest beside the rewritten ones and must stay where they are; :func:`read_copy` reads both. Like
    :func:`materialize` it refuses uncoercible text first, and the copy becomes visible at once, after its rows are counted.
    """
    whole = spark.read.parquet(source)
    bad = uncoercible(corrections, whole.schema).limit(5).collect()
    if bad:
        raise StagingError("; ".join(f"{r['column_name']}: {r['final_value']!r} does not fit" for r in bad))
    # Only the key columns and the file's name are read to find the files; one row per file comes to the driver.
    held = whole.select(*key.columns, F.col("_metadata.file_path").alias("_file"))
    files = {r["_file"]: r["n"] for r in held.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()}
    touched = set()
    if key.is_reliable:
        keyed = held.select(text.record_ref(held.schema, key).alias("record_ref"), "_file")
        touched = {r["_file"] for r in keep_matching(keyed, corrections, "record_ref").select("_file").distinct().collect()}
    pending = f"{path.rstrip('/')}__pending-{uuid.uuid4().hex}"
    try:
        # The schema of the whole table: files may lack columns that others have.
        part = spark.read.schema(whole.schema).parquet(*sorted(touched)) if touched else whole.limit(0)
        overlay(part, key, corrections).write.parquet(f"{pending}/rewritten")
        kept = sorted(set(files) - touched)
        spark.createDataFrame([(f,) for f in kept], "file string").coalesce(1).write.parquet(f"{pending}/{_MANIFEST}")
        rows = spark.read.parquet(f"{pending}/rewritten").count() + sum(files[f] for f in kept)
        if rows != sum(files.values()):
            raise StagingError(f"copied {rows} of {sum(files.values())} rows")
        swap(spark, pending, path)
    except BaseException:
        delete_path(spark, pending)
        raise
    return Copy(path, len(touched), len(kept), rows)


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a copy on write, in staging types."""
    rewritten = spark.read.parquet(f"{path}/rewritten")
    kept = [r["file"] for r in spark.read.parquet(f"{path}/{_MANIFEST}").collect()]
    if not kept:
        return rewritten
    taken = spark.read.parquet(*kept)
    return rewritten.unionByName(taken.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in taken.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in rewritten.schema.fields]))


def split_changed(staged: DataFrame, key: KeySpec, corrections: DataFrame, changed: bool) -> DataFrame:
    """Rows of the staged copy that were (or were not) corrected.

    Without a key nothing is addressable: no row counts as changed.
    """
    if not key.is_reliable:
        return staged.where(F.lit(not changed))
    keyed = staged.withColumn("record_ref", text.record_ref(staged.schema, key))
    return keep_matching(keyed, corrections, "record_ref", changed).select(*staged.columns)


def with_change_flag(staged: DataFrame, key: KeySpec, corrections: DataFrame) -> DataFrame:
    """Staged rows with ``changed_fields`` and ``is_changed``."""
    if not key.is_reliable:
        return staged.withColumn("changed_fields", F.array().cast("array<string>")).withColumn("is_changed", F.lit(False))
    fields = corrections.groupBy("record_ref").agg(F.array_sort(F.collect_set("column_name")).alias("changed_fields"))
    keyed = staged.withColumn("record_ref", text.record_ref(staged.schema, key))
    return join_small(keyed, fields, ["record_ref"], "left").select(
        *staged.columns, F.coalesce("changed_fields", F.array().cast("array<string>")).alias("changed_fields"),
        F.col("changed_fields").isNotNull().alias("is_changed"))


def destination_metadata(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), normalized_type(f.dataType), staging_type(f.dataType).simpleString())
            for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, source_type string, normalized_data_type string, "
              "staging_type string")


def revalidate(staged: DataFrame, key: KeySpec, rules: Sequence[RuleSpec]) -> DataFrame:
    """Every enabled rule on every staged row, in long form and without a shuffle.

    Rules about other rows cannot be settled here. A COMPLETENESS threshold
    does not apply to a single row.
    """
    schema = staged.schema
    cells = []
    for rule in check_rules(schema, rules):
        shown = text.canonical_of(schema, rule.column) if rule.column else F.lit(None).cast("string")
        if not R.is_supported(rule.rule_type) or R.is_group_rule(rule.rule_type):
            status, reason, checked = F.lit(NEEDS_DATASET), F.lit("needs the other rows of the dataset"), shown
        else:
            built = R.local_rule(schema, rule)
            fails = built.fails if built else F.lit(False)
            status = F.when(fails, FAIL).otherwise(PASS)
            reason = F.when(fails, F.lit(built.reason)) if built else F.lit(None).cast("string")
            checked = F.when(fails, built.failed_value).otherwise(shown) if built else shown
        cells.append(F.struct(
            F.lit(rule.assignment_id).alias("assignment_id"), F.lit(rule.rule_type).alias("rule_type"),
            F.lit(rule.column).cast("string").alias("column_name"), status.alias("status"), reason.alias("reason"),
            checked.alias("checked_value")))
    ref = text.record_ref(schema, key)
    return staged.select(ref.alias("record_ref"), F.inline(F.array(*cells)))


@dataclass(frozen=True)
class PublishOutcome:
    status: str
    row_count: int | None = None
    target: str | None = None
    reason: str | None = None


def publish(staged: DataFrame, base: str, reference: str, is_current: bool, is_ready: bool,
            drift_acknowledged: bool = False, overwrite: bool = False) -> PublishOutcome:
    """Export the staged snapshots, unless unacknowledged drift keeps the run pending."""
    if not (is_current and is_ready):
        raise StagingError("publishing needs the current, ready staging run")
    target = resolve_target(reference, base)
    if not drift_acknowledged and not drifted_records(staged).isEmpty():
        return PublishOutcome("PENDING", reason="source drift is not acknowledged")
    # The rows are counted as they are read, and nothing is at the target unless all of them are there.
    written = export_snapshots(staged, target, overwrite)
    return PublishOutcome("PUBLISHED", written, target)
