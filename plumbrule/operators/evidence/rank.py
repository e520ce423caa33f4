"""Availability of evidence per issue and ranking of its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbrule.functions import text
from plumbrule.functions.grouping import join_small, keep_matching, lookup
from plumbrule.operators.evidence.roles import applicable_strategies, strategy_fits_rule
from plumbrule.spec import KeySpec

AMBIGUITY_MARGIN = 0.03


def stale_keys(issues: DataFrame, key_changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Flag issues whose dataset key changed after their validation run was created.

    Both other tables are reduced to one row per dataset or run first.
    """
    changed = key_changes.groupBy("dataset_id").agg(F.max("changed_at").alias("last_changed"))
    created = runs.select("run_id", "dataset_id", F.col("created_at").alias("run_created"))
    joined = join_small(join_small(issues, created, ["run_id"], "left"), changed, ["dataset_id"], "left")
    return joined.withColumn(
        "key_changed", F.coalesce(F.col("last_changed") > F.col("run_created"), F.lit(False))
    ).drop("last_changed", "run_created")


def locate_issues(df: DataFrame, key: KeySpec, issues: DataFrame, unique_only: bool = True) -> DataFrame:
    """Each issue with how many current rows carry its key, and the row when it is exactly one.

    With ``unique_only`` off, the smallest of the rows stands for a repeated key.

    The keyed rows are reduced to the keys under review and counted per key
    before the join, so a repeated key never multiplies issues. Output: the
    issue columns, ``matches`` and ``row`` (struct, NULL unless matches = 1).
    """
    ref = text.record_ref(df.schema, key)
    keyed = df.select(ref.alias("record_ref"), F.struct(*df.columns).alias("row"))
    found = keep_matching(keyed, issues, "record_ref").groupBy("record_ref").agg(
        F.count(F.lit(1)).alias("matches"), F.min("row").alias("row"))
    located = lookup(issues, found, "record_ref", "issue_id")
    counted = located.withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))
    return counted.withColumn("row", F.when(F.col("matches") == 1, F.col("row"))) if unique_only else counted


def availability(key: KeySpec, key_changed: Column, record_ref: Column, matches: Column) -> Column:
    """Why evidence is unavailable for an issue, or AVAILABLE."""
    if not key.is_reliable:
        return F.lit("NO_RELIABLE_KEY")
    parts = F.split(record_ref, text.UNIT_SEPARATOR)
    malformed = record_ref.isNull() | (F.size(parts) != len(key.columns)) if len(key.columns) > 1 \
        else record_ref.isNull()
    has_null = F.exists(parts, lambda p: p == text.NULL_SENTINEL)
    return (
        F.when(key_changed, "KEY_CHANGED").when(malformed, "MALFORMED_RECORD_REF")
        .when(has_null, "NULL_KEY_PART").when(matches == 0, "RECORD_NOT_FOUND")
        .when(matches > 1, "KEY_NOT_UNIQUE").otherwise("AVAILABLE"))


def column_candidates(issues: DataFrame, evidence: DataFrame, strategy_family: str) -> DataFrame:
    """Attach a per-column verdict (sequence or temporal) to the issues it answers.

    ``evidence`` has one row per column, so it is broadcast after a size check.
    """
    mine = issues.where(F.array_contains(
        applicable_strategies(F.col("normalized_data_type"), F.col("rule_type")), strategy_family))
    found = evidence.where(F.col("status") == "CANDIDATE").select(
        "column_name", "strategy", F.col("candidate_value").alias("value"), "confidence", "supporting_count",
        "contradicting_count")
    return join_small(mine.select("issue_id", "column_name", "rule_type"), found, ["column_name"]).where(
        strategy_fits_rule(F.col("strategy"), F.col("rule_type"))
    ).select("issue_id", "value", "strategy", "confidence", "supporting_count", "contradicting_count")


def relationship_candidates(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("status") == "CANDIDATE").select(
        "issue_id", text.number_text(F.col("candidate_value")).alias("value"),
        F.col("relationship_type").alias("strategy"), "confidence", "supporting_count",
        F.lit(0).cast("bigint").alias("contradicting_count"))


def template_candidates(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("status") == "CANDIDATE").select(
        "issue_id", F.col("candidate_value").alias("value"), "strategy", "confidence", "supporting_count",
        "contradicting_count")


def rank_candidates(candidates: DataFrame, issues: DataFrame | None = None,
                    margin: float = AMBIGUITY_MARGIN) -> DataFrame:
    """One row per issue: the recommended candidate, or why there is none.

    Order: confidence descending, then strategy, then value. A different value
    within ``margin`` of the first makes the issue ambiguous. An issue has at
    most one candidate per strategy and source column, so its list is short.
    ``issues`` (issue_id) adds the issues without any candidate.
    """
    listed = candidates.groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("confidence")).alias("order"), "strategy", "value", "confidence", "supporting_count",
        "contradicting_count"))).alias("all"))
    if issues is not None:
        listed = issues.select("issue_id").join(listed, "issue_id", "left")
    top = F.get("all", F.lit(0))
    rivals = F.size(F.filter("all", lambda c: ((top["confidence"] - c["confidence"]) <= margin + 1e-12)
                             & ~text.same_value(c["value"], top["value"])))
    n = F.coalesce(F.size("all"), F.lit(0))
    ambiguous = F.coalesce((n > 0) & (rivals > 0), F.lit(False))
    best = (n > 0) & ~ambiguous
    return listed.select(
        "issue_id", F.greatest(n, F.lit(0)).alias("candidates"), ambiguous.alias("ambiguous"),
        F.when(best, top["value"]).alias("recommended_value"), F.when(best, top["strategy"]).alias("recommended_strategy"),
        F.when(best, F.round(top["confidence"], 4)).alias("confidence"),
        F.when(best, top["supporting_count"]).alias("supporting_count"),
        F.when(best, top["contradicting_count"]).alias("contradicting_count"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda c: c["strategy"]))), ",")
        .alias("strategies_with_candidates"),
        F.when(n < 1, "no strategy produced a candidate")
        .when(ambiguous, "close candidates disagree on the value").alias("no_candidate_reason"))


def strategies_attempted(issues: DataFrame) -> DataFrame:
    """Which strategies apply to each issue, whether or not they find anything."""
    return issues.select("issue_id", F.array_join(F.array_sort(applicable_strategies(
        F.col("normalized_data_type"), F.col("rule_type"))), ",").alias("strategies_attempted"))


def duplicate_peers(failures: DataFrame, limit: int) -> DataFrame:
    """For each repeated-value failure, how many other rows have the same value, and the first ``limit`` of them.

    Each group keeps only its first ``limit`` + 1 members (Spark prunes the
    ranking before the shuffle), and a failure reads that short list.
    """
    repeated = failures.where(F.col("rule_type").isin("UNIQUENESS", "DUPLICATE")).withColumn(
        "_peer", F.sha2(F.concat_ws(text.UNIT_SEPARATOR, "run_id", "assignment_id",
                                    F.coalesce("failed_value", F.lit(text.NULL_SENTINEL))), 256)
    ).withColumn("_pos", F.xxhash64("run_id", "assignment_id", "record_ref", "row_index"))
    order = W.partitionBy("_peer").orderBy("row_index", "record_ref")
    heads = repeated.select("_peer", "row_index", "record_ref").withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= limit + 1)
    sizes = repeated.groupBy("_peer").agg(F.count(F.lit(1)).alias("size"))
    lists = heads.groupBy("_peer").agg(F.array_sort(F.collect_list(F.struct("r", "record_ref"))).alias("head")).join(sizes, "_peer")
    joined = lookup(repeated, lists, "_peer", "_pos")
    others = F.slice(F.filter("head", lambda h: h["record_ref"] != F.col("record_ref")), 1, limit)
    return joined.select(
        "run_id", "assignment_id", "record_ref", "failed_value",
        F.transform(others, lambda h: h["record_ref"]).alias("peers"), (F.col("size") - 1).alias("peer_count"))


def issue_summaries(issues: DataFrame) -> DataFrame:
    """Severity, status and column of every issue of a review; no values."""
    return issues.select("issue_id", "review_run_id", "severity", "status", "column_name")
