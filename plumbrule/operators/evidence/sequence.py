"""Gaps and next values of numbered identifiers (prefix, digits, suffix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.operators.evidence import AMBIGUOUS, CANDIDATE, INSUFFICIENT, NO_RELATIONSHIP
from plumbrule.operators.evidence.progression import (
    MIN_CONSISTENCY, MIN_OBSERVATIONS, MIN_SUPPORT, progression,
)

# Identifier pattern (a hyphen before digits is a sign) and coverage.
IDENTIFIER = r"^([^0-9-]*)(-?[0-9]+)([^0-9-]*)$"
MIN_COVERAGE = 0.9


def sequence_evidence(values: DataFrame, min_observations: int = MIN_OBSERVATIONS,
                      min_support: int = MIN_SUPPORT) -> DataFrame:
    """One verdict per column from (column_name, value) pairs of non-blank text.

    Values are counted with map-side combining, and distinct numbers are ordered range by range.
    """
    v = text.strip(F.col("value"))
    number = F.regexp_extract(v, IDENTIFIER, 2)
    # Never NULL, and NULL numbers are told apart by an aggregate: an IS NOT NULL test of a parsed value
    # would be pushed down to the scan and parse every row again.
    parsed = values.select(
        "column_name", F.coalesce(F.regexp_extract(v, IDENTIFIER, 1), F.lit("")).alias("prefix"),
        F.coalesce(F.regexp_extract(v, IDENTIFIER, 3), F.lit("")).alias("suffix"), number.try_cast("decimal(38,0)").alias("number"),
        F.length(F.regexp_replace(number, "^-", "")).alias("width"))
    counts = parsed.groupBy("column_name", "prefix", "suffix", "number").agg(
        F.count(F.lit(1)).alias("n"), F.count("number").alias("known"),
        F.min("width").alias("w0"), F.max("width").alias("w1")).where(F.col("n") > 0)
    schemes = counts.groupBy("column_name", "prefix", "suffix").agg(
        F.sum("n").alias("n_all"), F.sum("known").alias("members"),
        F.count("number").alias("d"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.min("w0").alias("w0"), F.max("w1").alias("w1"))
    columns = schemes.groupBy("column_name").agg(
        F.sum("n_all").alias("observed"),
        F.max(F.struct(F.coalesce("members", F.lit(0)).alias("members"), "prefix", "suffix", "d", "least", "most",
                       "w0", "w1")).alias("top")
    ).select("column_name", "observed", "top.*").withColumn(
        "covered", F.col("members") / F.col("observed") >= MIN_COVERAGE)
    usable = columns.where(
        (F.col("observed") >= min_observations) & F.col("covered") & (F.col("d") >= 2)
        & (F.col("most") - F.col("least") < F.lit(10**18)))
    # One row per column.
    series = counts.join(F.broadcast(usable.select("column_name", "prefix", "suffix", "least")),
                         ["column_name", "prefix", "suffix"]).where(F.col("known") > 0).select(
        "column_name", (F.col("number") - F.col("least")).cast("bigint").alias("idx"))
    facts = progression(series, ["column_name"], F.lit(True))
    joined = columns.join(
        facts.select("column_name", "step", "supporting", "transitions", "slots", "present", "gap_count", "gap", "hi",
                     "span"),
        "column_name", "left")

    duplicates = F.col("members") - F.col("d")
    consistency = F.col("supporting") / F.col("transitions")
    status = (
        F.when(F.col("observed") < min_observations, INSUFFICIENT)
        .when(~F.col("covered") | (F.col("d") < 2) | F.col("step").isNull(), NO_RELATIONSHIP)
        .when(consistency < MIN_CONSISTENCY, NO_RELATIONSHIP)
        .when((F.col("gap_count") == 0) & (duplicates == 0), NO_RELATIONSHIP)
        .when((F.col("gap_count") > 1) | (duplicates > 1) | (F.col("supporting") < min_support), AMBIGUOUS)
        .otherwise(CANDIDATE))
    is_gap = F.col("gap_count") == 1
    found = F.col("least") + F.when(is_gap, F.col("gap")).otherwise(F.col("hi") + F.col("step"))
    digits = F.abs(found).cast("decimal(38,0)").cast("string")
    padded = F.when((F.col("w0") == F.col("w1")) & (F.col("w0") > F.length(digits)),
                    F.lpad(digits, F.col("w0"), F.lit("0"))).otherwise(digits)
    rendered = F.concat(F.col("prefix"), F.when(found < 0, "-").otherwise(""), padded, F.col("suffix"))
    marks = F.when(F.col("w0") == F.col("w1"), F.repeat(F.lit("#"), F.col("w0"))).otherwise(F.lit("#+"))
    plain = (F.col("prefix") == "") & (F.col("suffix") == "")
    best = F.col("status") == CANDIDATE
    return joined.withColumn("status", status).select(
        "column_name", "status", F.col("observed").alias("observed_values_count"),
        F.when(best, F.when(is_gap, "SEQUENCE_GAP").otherwise("SEQUENCE_NEXT_VALUE")).alias("strategy"),
        F.when(best, rendered).alias("candidate_value"),
        F.when(best & ~plain, F.concat("prefix", marks, "suffix")).alias("template"),
        F.when(best, F.col("step")).alias("step"),
        F.when(best, F.col("gap_count")).alias("gap_count"), F.when(best, duplicates).alias("duplicate_count"),
        F.when(best, F.col("supporting")).alias("supporting_count"),
        F.when(best, F.col("transitions") - F.col("supporting")).alias("contradicting_count"),
        F.when(best, consistency).alias("step_consistency"),
        F.when(best, F.col("present") / F.col("slots")).alias("coverage_ratio"),
        F.when(best, consistency * F.least(F.lit(1.0), F.col("d") / F.lit(2.0 * min_observations)))
        .alias("confidence"))
