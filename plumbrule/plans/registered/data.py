"""Inputs derived from the given tables, once for Spark and once as SQL.

The given tables are clean, so faults are put in by conditions on the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def faulty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(price > 480000, -price).otherwise(price).alias("o_totalprice"), "o_orderdate",
        F.when(price < 30000, F.lit(None)).when(F.col("o_orderstatus") == "P", F.concat(F.lit("  "), priority, F.lit(" ")))
        .otherwise(priority).alias("o_orderpriority"))


FAULTY_ORDERS = """
faulty_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_totalprice > 480000 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_totalprice < 30000 THEN NULL WHEN o_orderstatus = 'P' THEN '  ' || o_orderpriority || ' '
              ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation runs: one per order, a dataset per customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("dataset_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("COMPLETED").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 5000).cast("double"))
        .alias("quality_score"))


RUNS = """
runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
         CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice / 5000) END AS quality_score
  FROM orders)"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation failures: one per order line, a rule assignment per line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("record_ref"), F.col("l_partkey").alias("row_index"),
        F.sha2(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"), 256).alias("source_row_hash"),
        F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("assignment_id"),
        F.when(F.col("l_linenumber") <= 3, "UNIQUENESS").otherwise("RANGE").alias("rule_type"),
        F.when(F.col("l_linenumber") <= 3, "l_suppkey").otherwise("l_quantity").alias("column_name"),
        F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "N", "MEDIUM").otherwise("LOW")
        .alias("severity"),
        F.col("l_quantity").cast("string").alias("failed_value"), F.lit("reason").alias("reason"))


FAILURES = """
failures AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_partkey || '-' || l_suppkey AS record_ref, l_partkey AS row_index,
         sha256(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice) AS source_row_hash,
         'A' || l_linenumber AS assignment_id,
         CASE WHEN l_linenumber <= 3 THEN 'UNIQUENESS' ELSE 'RANGE' END AS rule_type,
         CASE WHEN l_linenumber <= 3 THEN 'l_suppkey' ELSE 'l_quantity' END AS column_name,
         CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         CAST(l_quantity AS VARCHAR) AS failed_value, 'reason' AS reason
  FROM lineitem)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule assignments: one per line number, two assignments per rule."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select(
        F.concat(F.lit("A"), n.cast("string")).alias("assignment_id"),
        F.concat(F.lit("R"), F.floor(n / 2).cast("string")).alias("rule_id"),
        F.concat(F.lit("rule "), F.floor(n / 2).cast("string")).alias("rule_name"),
        F.when(n <= 1, "UNIQUENESS").otherwise("RANGE").alias("rule_type"), n.cast("bigint").alias("version"),
        F.lit("MEDIUM").alias("severity"), F.when(n > 1, "l_quantity").alias("column_name"))


RULES = """
rules AS (
  SELECT 'A' || l_linenumber AS assignment_id, 'R' || (l_linenumber // 2) AS rule_id,
         'rule ' || (l_linenumber // 2) AS rule_name,
         CASE WHEN l_linenumber <= 1 THEN 'UNIQUENESS' ELSE 'RANGE' END AS rule_type,
         CAST(l_linenumber AS BIGINT) AS version, 'MEDIUM' AS severity,
         CASE WHEN l_linenumber > 1 THEN 'l_quantity' END AS column_name
  FROM (SELECT DISTINCT l_linenumber FROM lineitem))"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues: one per order line, a review per order."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("issue_id"),
        F.col("l_orderkey").cast("string").alias("review_run_id"),
        F.col("l_partkey").cast("string").alias("record_ref"),
        F.when(F.col("l_linestatus") == "O", "l_tax").otherwise("l_discount").alias("column_name"),
        F.col("l_discount").cast("string").alias("original_value"),
        F.when(F.col("l_returnflag") == "A", "HIGH").otherwise("LOW").alias("severity"),
        F.lit("PENDING").alias("status"), F.col("l_shipdate").alias("created_at"))


ISSUES = """
issues AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS issue_id,
         CAST(l_orderkey AS VARCHAR) AS review_run_id, CAST(l_partkey AS VARCHAR) AS record_ref,
         CASE WHEN l_linestatus = 'O' THEN 'l_tax' ELSE 'l_discount' END AS column_name,
         CAST(l_discount AS VARCHAR) AS original_value,
         CASE WHEN l_returnflag = 'A' THEN 'HIGH' ELSE 'LOW' END AS severity,
         'PENDING' AS status, l_shipdate AS created_at
  FROM lineitem)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections: one per order line, decided some days after it was opened."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("issue_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax").cast("string")).alias("final_value"),
        F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "N", "EDITED")
        .otherwise("REJECTED").alias("status"),
        F.col("l_suppkey").cast("string").alias("decided_by"),
        F.expr("l_shipdate + make_dt_interval(cast(l_quantity AS int))").alias("decided_at"))


CORRECTIONS = """
corrections AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS issue_id,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_tax AS VARCHAR) END AS final_value,
         CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'N' THEN 'EDITED' ELSE 'REJECTED' END AS status,
         CAST(l_suppkey AS VARCHAR) AS decided_by, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS decided_at
  FROM lineitem)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval requests: one per order, for the review of the customer's number."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.col("o_custkey").cast("string").alias("review_run_id"),
        F.when(F.col("o_orderpriority") < "2", "REJECTED").when(F.col("o_orderpriority") < "3", "PARTIALLY_APPROVED")
        .when(F.col("o_orderpriority") < "4", "PENDING").otherwise("APPROVED").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("requested_at"),
        F.when(F.col("o_orderstatus") != "O", F.expr(
            "o_orderdate + make_dt_interval(0, 0, 0, cast(o_custkey AS decimal(18,6)))")).alias("decided_at"))


REQUESTS = """
requests AS (
  SELECT 'Q' || o_orderkey AS request_id, CAST(o_custkey AS VARCHAR) AS review_run_id,
         CASE WHEN o_orderpriority < '2' THEN 'REJECTED' WHEN o_orderpriority < '3' THEN 'PARTIALLY_APPROVED'
              WHEN o_orderpriority < '4' THEN 'PENDING' ELSE 'APPROVED' END AS status,
         o_orderdate AS created_at, o_orderdate AS requested_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(o_custkey) END AS decided_at
  FROM orders)"""
