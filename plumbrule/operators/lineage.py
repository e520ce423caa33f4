"""Lineage edges: recording, reading and rebuilding them from the base tables."""

from __future__ import annotations

from typing import Collection, Mapping

from pyspark.sql import DataFrame, functions as F

from plumbrule.functions.ordered import latest_as_of
from plumbrule.functions.repeats import BROADCAST_KEYS
from plumbrule.functions.storage import written

EDGE = ("parent_type", "parent_id", "child_type", "child_id", "relationship")


class UnknownEntity(LookupError):
    """The entity has no lineage edge in either direction."""


def edges(df: DataFrame, parent_type: str, parent_id: str, child_type: str, child_id: str, relationship: str) -> DataFrame:
    """Edges from two id columns of a table."""
    return df.select(
        F.lit(parent_type).alias("parent_type"), F.col(parent_id).cast("string").alias("parent_id"),
        F.lit(child_type).alias("child_type"), F.col(child_id).cast("string").alias("child_id"),
        F.lit(relationship).alias("relationship"))


def new_edges(existing: DataFrame, offered: DataFrame) -> DataFrame:
    """The offered edges that are not recorded yet, each once."""
    return offered.select(*EDGE).dropDuplicates(list(EDGE)).join(existing.select(*EDGE), list(EDGE), "left_anti")


def record_edges(existing: DataFrame, offered: DataFrame) -> DataFrame:
    """The edge table after recording; recording twice changes nothing."""
    return existing.select(*EDGE).unionByName(offered.select(*EDGE)).dropDuplicates(list(EDGE))


def edges_of(lineage: DataFrame, entity_type: str, entity_id: str, direction: str = "both") -> DataFrame:
    """One hop up, down or both; an entity without any edge is an error."""
    as_child = (F.col("child_type") == entity_type) & (F.col("child_id") == entity_id)
    as_parent = (F.col("parent_type") == entity_type) & (F.col("parent_id") == entity_id)
    either = lineage.where(as_child | as_parent)
    if either.isEmpty():
        raise UnknownEntity(f"{entity_type}/{entity_id} has no lineage")
    if direction == "up":
        return lineage.where(as_child)
    return lineage.where(as_parent) if direction == "down" else either


def nodes_of(found: DataFrame) -> DataFrame:
    """The distinct entities of some edges."""
    parents = found.select(F.col("parent_type").alias("entity_type"), F.col("parent_id").alias("entity_id"))
    children = found.select(F.col("child_type").alias("entity_type"), F.col("child_id").alias("entity_id"))
    return parents.unionByName(children).distinct()


def approvals_of_staging(staging_runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Each staging run with the newest approved request created at or before it."""
    approved = requests.where(F.col("status") == "APPROVED").select("request_id", "review_run_id", "created_at")
    return latest_as_of(
        staging_runs.select("staging_run_id", "review_run_id", "created_at"), approved, "review_run_id",
        "created_at", "created_at", "request_id", "request_id")


def corrections_of_requests(corrections: DataFrame, issues: DataFrame, requests: DataFrame) -> DataFrame:
    """(issue_id, request_id): the first request of the review that covers each resolved correction.

    A later request of the review covers the correction as well; the first one is when it was put up
    for approval, and one edge per correction says so. An as-of join on the reversed time line finds it. Requests
    of equal time prefer the larger id.
    """
    def reversed_time(c: str):
        return F.timestamp_micros(-F.unix_micros(F.col(c).cast("timestamp")))

    resolved = corrections.where(
        F.col("final_value").isNotNull() & F.col("status").isin("ACCEPTED", "EDITED")).select("issue_id", "decided_at")
    # The as-of join reads its left side several times, so the join below is written and not repeated.
    placed = written(resolved.join(issues.select("issue_id", "review_run_id"), "issue_id").select(
        "issue_id", "review_run_id", reversed_time("decided_at").alias("_t")))
    asked = requests.select("request_id", "review_run_id", reversed_time("requested_at").alias("_r"))
    return latest_as_of(placed, asked, "review_run_id", "_t", "_r", "request_id", "request_id").where(
        F.col("request_id").isNotNull()).select("issue_id", "request_id")


def distinct_edges(made: DataFrame) -> DataFrame:
    """Edges of one pair of types, read from a table, each once.

    Their hashes are counted first. While few repeat these are broadcast, and only edges with a repeated hash are shuffled
    with their texts.
    """
    ids = ["parent_id", "child_id"]
    pair = F.xxhash64(*ids)
    again = written(made.groupBy(pair.alias("_pair")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_pair"))
    if again.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return made.dropDuplicates(ids)
    # Counted above.
    repeats = F.broadcast(again)
    single = made.join(repeats, pair == F.col("_pair"), "left_anti")
    return single.unionByName(made.join(repeats, pair == F.col("_pair"), "left_semi").dropDuplicates(ids))


def backfill(tables: Mapping[str, DataFrame], repeating: Collection[str] = ()) -> DataFrame:
    """All edges of the nine touch points, rebuilt from the base tables.

    Each touch point gives edges of its own types, so an edge can repeat only where a table repeats its id. Ids are
    primary keys of the base tables; the edges of those named as ``repeating`` are deduplicated, and no others.

    ``tables``: connections, schemas, datasets, columns, profile_runs,
    validation_runs, review_runs, issues, corrections, approval_requests,
    staging_runs, publish_runs. Absent tables contribute nothing.
    """
    # Touch points as (table, parent type, parent id, child type, child id, relationship).
    plain = (
        ("connections", "DATA_SOURCE", "data_source_id", "CONNECTION", "connection_id", "DERIVED_FROM"),
        ("schemas", "CONNECTION", "connection_id", "SCHEMA", "schema_id", "DERIVED_FROM"),
        ("datasets", "SCHEMA", "schema_id", "DATASET", "dataset_id", "DERIVED_FROM"),
        ("columns", "DATASET", "dataset_id", "COLUMN", "column_id", "DERIVED_FROM"),
        ("profile_runs", "DATASET", "dataset_id", "PROFILE_RUN", "profile_run_id", "PROFILED_BY"),
        ("validation_runs", "DATASET", "dataset_id", "VALIDATION_RUN", "run_id", "VALIDATED_BY"),
        ("review_runs", "VALIDATION_RUN", "run_id", "REVIEW_RUN", "review_run_id", "DERIVED_FROM"),
        ("issues", "REVIEW_RUN", "review_run_id", "ISSUE", "issue_id", "DERIVED_FROM"),
        ("corrections", "ISSUE", "issue_id", "CORRECTION", "issue_id", "CORRECTED_BY"),
        ("publish_runs", "STAGING_RUN", "staging_run_id", "PUBLISH_RUN", "publish_run_id", "PUBLISHED_TO"),
    )
    def once(made: DataFrame, *sources: str) -> DataFrame:
        return made.dropDuplicates(["parent_id", "child_id"]) if set(sources) & set(repeating) else made

    def scanned_once(made: DataFrame, source: str) -> DataFrame:
        return distinct_edges(made) if source in repeating else made

    found = [scanned_once(edges(tables[t], p, pid, c, cid, rel), t) for t, p, pid, c, cid, rel in plain if t in tables]
    if {"corrections", "issues", "approval_requests"} <= set(tables):
        pairs = corrections_of_requests(tables["corrections"], tables["issues"], tables["approval_requests"])
        found.append(once(edges(pairs, "CORRECTION", "issue_id", "APPROVAL_REQUEST", "request_id", "APPROVED_BY"), "corrections", "issues"))
    if {"staging_runs", "approval_requests"} <= set(tables):
        staged = approvals_of_staging(tables["staging_runs"], tables["approval_requests"]).where(
            F.col("request_id").isNotNull())
        found.append(once(edges(staged, "APPROVAL_REQUEST", "request_id", "STAGING_RUN", "staging_run_id", "STAGED_INTO"), "staging_runs"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
