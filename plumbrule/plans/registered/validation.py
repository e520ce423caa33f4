"""Rule evaluation on orders, lines, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.operators.stage import revalidate
from plumbrule.operators.validate import Validation, column_stats, validate
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import FAULTY_ORDERS, faulty_orders, table
from plumbrule.spec import KeySpec, RuleSpec

registry = Registry()

ORDER_KEY = KeySpec(("o_orderkey",))
LINE_KEY = KeySpec(("l_orderkey", "l_partkey", "l_suppkey"))

ORDER_RULES = (
    RuleSpec("complete", "COMPLETENESS", ("o_orderpriority",), {"max_null_percentage": 0}, "HIGH"),
    RuleSpec("range", "RANGE", ("o_totalprice",), {"min": 0, "max": 450000}, "MEDIUM"),
    RuleSpec("pattern", "PATTERN", ("o_orderpriority",), {"regex": "^[1-5]-[A-Z ]+$"}, "LOW"),
    RuleSpec("unique", "UNIQUENESS", ("o_custkey",), {"max_duplicate_percentage": 10}, "LOW"),
    RuleSpec("tolerant", "COMPLETENESS", ("o_orderpriority",), {"max_null_percentage": 60}, "CRITICAL"),
    RuleSpec("foreign", "REFERENTIAL_INTEGRITY", ("o_custkey",), {}, "HIGH"),
)

FAILED = """
failed AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_ref, 0 AS rule_ordinal, 'complete' AS assignment_id, 'HIGH' AS severity,
         CAST(NULL AS VARCHAR) AS failed_value FROM faulty_orders WHERE o_orderpriority IS NULL
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'range', 'MEDIUM', CAST(o_totalprice AS VARCHAR)
  FROM faulty_orders WHERE o_totalprice < 0 OR o_totalprice > 450000
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'pattern', 'LOW', o_orderpriority
  FROM faulty_orders WHERE NOT regexp_matches(o_orderpriority, '^(?:^[1-5]-[A-Z ]+$)')
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 3, 'unique', 'LOW', CAST(o_custkey AS VARCHAR)
  FROM faulty_orders WHERE o_custkey IN (SELECT o_custkey FROM faulty_orders GROUP BY 1 HAVING count(*) > 1))"""

PER_ROW = """
per_row AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_ref, count(f.record_ref) AS n,
         count(*) FILTER (f.severity IN ('HIGH', 'CRITICAL')) AS severe,
         sha256(any_value(concat_ws(chr(31), o_custkey, o_orderdate, o_orderkey,
                coalesce(o_orderpriority, chr(0) || 'NULL' || chr(0)), o_orderstatus, o_totalprice))) AS source_row_hash
  FROM faulty_orders o LEFT JOIN failed f ON f.record_ref = CAST(o_orderkey AS VARCHAR) GROUP BY 1)"""


def orders_run(spark: SparkSession, sf_dir: str) -> Validation:
    return validate(faulty_orders(spark, sf_dir), ORDER_RULES, ORDER_KEY, "run")


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _one_rule(df: DataFrame, key: KeySpec, rule: RuleSpec) -> DataFrame:
    return validate(df, [rule], key).failures().select("record_ref", "failed_value", "expected_value", "reason")


@registry.add("validation_results", _with(FAULTY_ORDERS, FAILED, PER_ROW) + """
SELECT record_ref, CASE WHEN n = 0 THEN 'PASSED' WHEN severe > 0 THEN 'FAILED' ELSE 'WARNING' END AS status,
       n AS failure_count, source_row_hash FROM per_row""")
def validation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_run(spark, sf_dir).results().select(
        "record_ref", "status", F.col("failure_count").cast("bigint").alias("failure_count"), "source_row_hash")


@registry.add("validation_failures", _with(FAULTY_ORDERS, FAILED) + """
SELECT record_ref, assignment_id, severity, failed_value FROM failed""")
def validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_run(spark, sf_dir).failures().select("record_ref", "assignment_id", "severity", "failed_value")


@registry.add("stored_failures", _with(FAULTY_ORDERS, FAILED) + """
SELECT record_ref, assignment_id FROM failed""")
def stored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_run(spark, sf_dir).stored_failures().select("record_ref", "assignment_id")


@registry.add("validation_summary", _with(FAULTY_ORDERS, FAILED, PER_ROW) + """
SELECT count(*) AS total_rows, count(*) FILTER (n = 0) AS passed_rows,
       count(*) FILTER (n > 0 AND severe = 0) AS warning_rows, count(*) FILTER (severe > 0) AS failed_rows,
       ((20000 * count(*) FILTER (n = 0) + count(*)) // (2 * count(*))) / 100.0 AS quality_score,
       CAST(sum(n) AS BIGINT) AS failure_count FROM per_row""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_run(spark, sf_dir).summary().select(
        "total_rows", "passed_rows", "warning_rows", "failed_rows", "quality_score", "failure_count")


@registry.add("validation_metrics", _with(FAULTY_ORDERS, FAILED) + """
SELECT 'total_rows' AS metric_name, NULL AS metric_group, count(*) AS metric_value FROM faulty_orders
UNION ALL SELECT 'failure_storage_truncated', NULL, 0
UNION ALL SELECT 'rule_evaluated', unnest(['complete', 'range', 'pattern', 'unique', 'tolerant']), 1
UNION ALL SELECT 'unsupported_rule_type_skipped', 'REFERENTIAL_INTEGRITY', 1""")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_run(spark, sf_dir).metrics().select("metric_name", "metric_group", "metric_value")


@registry.add("rule_completeness", _with(FAULTY_ORDERS) + """
SELECT CAST(o_orderkey AS VARCHAR) AS record_ref, CAST(NULL AS VARCHAR) AS failed_value,
       'NOT NULL' AS expected_value,
       'Column ''o_orderpriority'' is null (max_null_percentage=2.0)' AS reason
FROM faulty_orders WHERE o_orderpriority IS NULL AND (SELECT 100.0 * count(*) FILTER (o_orderpriority IS NULL)
  / count(*) > 2 FROM faulty_orders)""")
def rule_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(faulty_orders(spark, sf_dir), ORDER_KEY, RuleSpec(
        "r", "COMPLETENESS", ("o_orderpriority",), {"max_null_percentage": 2}))


@registry.add("rule_uniqueness", """
SELECT CAST(doc_id AS VARCHAR) AS record_ref, text AS failed_value, 'UNIQUE' AS expected_value,
       'Duplicate value in column ''text''' AS reason
FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def rule_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(table(spark, sf_dir, "documents"), KeySpec(("doc_id",)), RuleSpec("r", "UNIQUENESS", ("text",)))


@registry.add("rule_uniqueness_tolerated", """
SELECT l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey AS record_ref,
       CAST(l_extendedprice AS VARCHAR) AS failed_value, 'UNIQUE' AS expected_value,
       'Duplicate value in column ''l_extendedprice''' AS reason
FROM lineitem WHERE (SELECT 100.0 * (count(l_extendedprice) - count(DISTINCT l_extendedprice)) / count(*) > 0.01
  FROM lineitem) AND l_extendedprice IN (SELECT l_extendedprice FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def rule_uniqueness_tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(table(spark, sf_dir, "lineitem"), LINE_KEY, RuleSpec(
        "r", "UNIQUENESS", ("l_extendedprice",), {"max_duplicate_percentage": 0.01}))


@registry.add("rule_duplicate", """
WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity = 50)
SELECT l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey AS record_ref, CAST(NULL AS VARCHAR) AS failed_value,
       'UNIQUE row' AS expected_value, 'Full-row duplicate' AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM twice) WHERE n > 1""")
def rule_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return _one_rule(lines.unionByName(lines.where("l_quantity = 50")), LINE_KEY, RuleSpec("r", "DUPLICATE"))


@registry.add("rule_range", """
SELECT l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey AS record_ref,
       CAST(l_extendedprice AS VARCHAR) AS failed_value, '[2000, 90000.5]' AS expected_value,
       'Value outside range [2000, 90000.5]' AS reason
FROM lineitem WHERE l_extendedprice < 2000 OR l_extendedprice > 90000.5""")
def rule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(table(spark, sf_dir, "lineitem"), LINE_KEY, RuleSpec(
        "r", "RANGE", ("l_extendedprice",), {"min": 2000, "max": 90000.5}))


@registry.add("rule_pattern", r"""
SELECT CAST(page_id AS VARCHAR) AS record_ref, url AS failed_value,
       'https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+' AS expected_value,
       'Value does not match pattern ''https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+''' AS reason
FROM pages WHERE NOT regexp_matches(url, '^(?:https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+)')""")
def rule_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_rule(table(spark, sf_dir, "pages"), KeySpec(("page_id",)), RuleSpec(
        "r", "PATTERN", ("url",), {"regex": r"https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+"}))


@registry.add("rule_cross_column", """
WITH compared AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS a, CASE WHEN l_tax > 0.07 THEN NULL
  WHEN l_discount < 0.05 THEN l_linenumber ELSE CAST(l_quantity AS INTEGER) END AS b FROM lineitem)
SELECT l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey AS record_ref,
       '[' || a || ', ' || coalesce(CAST(b AS VARCHAR), 'None') || ']' AS failed_value, 'all equal' AS expected_value,
       'Columns [''a'', ''b''] are not all equal' AS reason
FROM compared WHERE a IS DISTINCT FROM b""")
def rule_cross_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("a"),
        F.when(F.col("l_tax") > 0.07, F.lit(None)).when(F.col("l_discount") < 0.05, F.col("l_linenumber"))
        .otherwise(F.col("l_quantity").cast("int")).alias("b"))
    return _one_rule(compared, LINE_KEY, RuleSpec("r", "CROSS_COLUMN", ("a", "b")))


@registry.add("exact_column_stats", """
SELECT 'l_orderkey' AS column_name, count(*) AS total_rows, count(*) - count(l_orderkey) AS null_count,
       count(DISTINCT l_orderkey) AS distinct_count FROM lineitem
UNION ALL SELECT 'l_comment', count(*), count(*) - count(CASE WHEN l_tax > 0.02 THEN l_returnflag END),
       count(DISTINCT CASE WHEN l_tax > 0.02 THEN l_returnflag END) FROM lineitem""")
def exact_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("l_comment"))
    found = column_stats(lines, [], ["l_orderkey", "l_comment"])
    return spark.createDataFrame(
        [(c, s["total"], s["nulls"], s["distinct"]) for c, s in found.items()],
        "column_name string, total_rows bigint, null_count bigint, distinct_count bigint")


@registry.add("staged_revalidation", _with(FAULTY_ORDERS) + """,
cases AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_ref, 'complete' AS assignment_id, o_orderpriority AS shown,
         o_orderpriority IS NULL AS fails, false AS wide FROM faulty_orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'range', CAST(o_totalprice AS VARCHAR),
         o_totalprice < 0 OR o_totalprice > 450000, false FROM faulty_orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'pattern', o_orderpriority,
         coalesce(NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$'), false), false FROM faulty_orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unique', CAST(o_custkey AS VARCHAR), false, true FROM faulty_orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'tolerant', o_orderpriority, o_orderpriority IS NULL, false
  FROM faulty_orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'foreign', CAST(o_custkey AS VARCHAR), false, true FROM faulty_orders)
SELECT record_ref, assignment_id, shown AS checked_value,
       CASE WHEN wide THEN 'REQUIRES_DATASET_REVALIDATION' WHEN fails THEN 'REVALIDATED_FAIL'
            ELSE 'REVALIDATED_PASS' END AS status FROM cases""")
def staged_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revalidate(faulty_orders(spark, sf_dir), ORDER_KEY, ORDER_RULES).select(
        "record_ref", "assignment_id", "checked_value", "status")
