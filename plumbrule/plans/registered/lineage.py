"""Lineage edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.operators import lineage
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import (
    CORRECTIONS, ISSUES, REQUESTS, RUNS, corrections, issues, requests, runs, table,
)

registry = Registry()

EDGES = """
edges AS (
  SELECT 'REVIEW_RUN' AS parent_type, CAST(l_orderkey AS VARCHAR) AS parent_id, 'ISSUE' AS child_type,
         CAST(l_partkey AS VARCHAR) AS child_id, 'DERIVED_FROM' AS relationship FROM lineitem
  UNION ALL SELECT 'ISSUE', CAST(l_partkey AS VARCHAR), 'CORRECTION', CAST(l_suppkey AS VARCHAR), 'CORRECTED_BY'
  FROM lineitem)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lineage.edges(lines, "REVIEW_RUN", "l_orderkey", "ISSUE", "l_partkey", "DERIVED_FROM").unionByName(
        lineage.edges(lines, "ISSUE", "l_partkey", "CORRECTION", "l_suppkey", "CORRECTED_BY"))


@registry.add("recorded_edges", "WITH " + EDGES + " SELECT DISTINCT * FROM edges")
def recorded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_edges = _edges(spark, sf_dir)
    return lineage.record_edges(all_edges.where("relationship = 'CORRECTED_BY'"), all_edges)


@registry.add("new_edges", "WITH " + EDGES + " SELECT DISTINCT * FROM edges WHERE relationship = 'DERIVED_FROM'")
def new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_edges = _edges(spark, sf_dir)
    return lineage.new_edges(all_edges.where("relationship = 'CORRECTED_BY'"), all_edges)


@registry.add("edges_of_issue", "WITH " + EDGES + """
SELECT * FROM edges WHERE (parent_type = 'ISSUE' AND parent_id = '1') OR (child_type = 'ISSUE' AND child_id = '1')""")
def edges_of_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edges_of(_edges(spark, sf_dir), "ISSUE", "1")


@registry.add("upstream_nodes", "WITH " + EDGES + """
SELECT DISTINCT parent_type AS entity_type, parent_id AS entity_id FROM edges WHERE child_type = 'ISSUE' AND child_id = '1'
UNION SELECT 'ISSUE', '1'""")
def upstream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.nodes_of(lineage.edges_of(_edges(spark, sf_dir), "ISSUE", "1", "up"))


@registry.add("approval_as_of_staging", "WITH " + REQUESTS + """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS staging_run_id, (
  SELECT arg_max(request_id, (created_at, request_id)) FROM requests q WHERE q.status = 'APPROVED'
    AND q.review_run_id = CAST(o_custkey AS VARCHAR) AND q.created_at <= l_shipdate) AS request_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def approval_as_of_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("staging_run_id"),
        F.col("o_custkey").cast("string").alias("review_run_id"), F.col("l_shipdate").alias("created_at"))
    return lineage.approvals_of_staging(staged, requests(spark, sf_dir)).select("staging_run_id", "request_id")


# The first request of the review that is not earlier than the correction.
COVERED = """
  SELECT c.issue_id, (SELECT arg_max(later.request_id, (-epoch_us(later.requested_at), later.request_id)) FROM requests later
    WHERE later.review_run_id = of_review.review_run_id AND later.requested_at >= c.decided_at) AS request_id
  FROM corrections c JOIN issues of_review USING (issue_id)
  WHERE c.status IN ('ACCEPTED', 'EDITED') AND c.final_value IS NOT NULL"""


@registry.add("corrections_before_request", "WITH " + ISSUES + "," + CORRECTIONS + "," + REQUESTS + """
SELECT * FROM (""" + COVERED + ") WHERE request_id IS NOT NULL")
def corrections_before_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.corrections_of_requests(corrections(spark, sf_dir), issues(spark, sf_dir), requests(spark, sf_dir))


@registry.add("backfilled_edges", "WITH " + ISSUES + "," + CORRECTIONS + "," + REQUESTS + "," + RUNS + """,
found AS (
  SELECT 'DATASET' AS parent_type, dataset_id AS parent_id, 'VALIDATION_RUN' AS child_type, run_id AS child_id,
         'VALIDATED_BY' AS relationship FROM runs
  UNION ALL SELECT 'VALIDATION_RUN', run_id, 'REVIEW_RUN', run_id, 'DERIVED_FROM' FROM runs
  UNION ALL SELECT 'REVIEW_RUN', review_run_id, 'ISSUE', issue_id, 'DERIVED_FROM' FROM issues
  UNION ALL SELECT 'ISSUE', issue_id, 'CORRECTION', issue_id, 'CORRECTED_BY' FROM corrections
  UNION ALL SELECT 'SCHEMA', CAST(c_nationkey AS VARCHAR), 'DATASET', CAST(c_custkey AS VARCHAR), 'DERIVED_FROM'
  FROM customer
  UNION ALL SELECT 'CORRECTION', issue_id, 'APPROVAL_REQUEST', request_id, 'APPROVED_BY' FROM (""" + COVERED + """)
    WHERE request_id IS NOT NULL
  UNION ALL SELECT 'APPROVAL_REQUEST', request_id, 'STAGING_RUN', run_id, 'STAGED_INTO' FROM (
    SELECT run_id, (SELECT arg_max(request_id, (q.created_at, request_id)) FROM requests q WHERE q.status = 'APPROVED'
      AND q.review_run_id = runs.dataset_id AND q.created_at <= runs.created_at) AS request_id FROM runs)
    WHERE request_id IS NOT NULL
  UNION ALL SELECT 'STAGING_RUN', run_id, 'PUBLISH_RUN', dataset_id, 'PUBLISHED_TO' FROM runs)
SELECT DISTINCT * FROM found""")
def backfilled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_runs = runs(spark, sf_dir)
    return lineage.backfill({
        "datasets": table(spark, sf_dir, "customer").select(
            F.col("c_nationkey").alias("schema_id"), F.col("c_custkey").alias("dataset_id")),
        "validation_runs": all_runs,
        "review_runs": all_runs.select("run_id", F.col("run_id").alias("review_run_id")),
        "issues": issues(spark, sf_dir), "corrections": corrections(spark, sf_dir),
        "approval_requests": requests(spark, sf_dir),
        "staging_runs": all_runs.select(
            F.col("run_id").alias("staging_run_id"), F.col("dataset_id").alias("review_run_id"), "created_at"),
        "publish_runs": all_runs.select(
            F.col("run_id").alias("staging_run_id"), F.col("dataset_id").alias("publish_run_id")),
        # Some order lines share what stands for an issue's id.
    }, repeating=("issues", "corrections"))
