"""Reports and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrule.functions import text
from plumbrule.operators import reports
from plumbrule.operators.evidence.rank import issue_summaries
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import (
    CORRECTIONS, FAILURES, ISSUES, REQUESTS, RULES, RUNS, corrections, failures, issues, requests, rules, runs, table,
)

registry = Registry()


def _at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


@registry.add("quality_trend", "WITH " + RUNS + """
SELECT run_id, dataset_id, CAST(created_at AS VARCHAR) AS created_at, quality_score FROM runs
WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND quality_score IS NOT NULL""")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_trend(runs(spark, sf_dir), _at("1996-01-01"), _at("1998-12-31")).withColumn(
        "created_at", F.col("created_at").cast("string"))


@registry.add("rule_effectiveness", "WITH " + FAILURES + "," + RUNS + "," + RULES + """,
named AS (SELECT rule_id, rule_name, rules.rule_type, failures.severity FROM failures
  JOIN runs USING (run_id) JOIN rules USING (assignment_id)
  WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')
SELECT rule_id, rule_name, rule_type, count(*) AS failure_count, count(*) FILTER (severity = 'HIGH') AS high_count,
  count(*) FILTER (severity = 'LOW') AS low_count,
  CAST(round(CAST(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM named) AS DECIMAL(38, 12)), 8) AS DOUBLE) AS failure_rate
FROM named GROUP BY 1, 2, 3""")
def rule_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.rule_effectiveness(
        failures(spark, sf_dir), runs(spark, sf_dir), rules(spark, sf_dir), _at("1996-01-01"), _at("1998-12-31"))
    return found.select(
        "rule_id", "rule_name", "rule_type", "failure_count",
        F.coalesce(F.try_element_at("severity_breakdown", F.lit("HIGH")), F.lit(0)).cast("bigint").alias("high_count"),
        F.coalesce(F.try_element_at("severity_breakdown", F.lit("LOW")), F.lit(0)).cast("bigint").alias("low_count"),
        text.rounded(F.col("failure_rate"), 8).alias("failure_rate"))


@registry.add("quality_by_dataset", "WITH " + RUNS + """,
latest AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs
  WHERE quality_score IS NOT NULL)
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS dataset_name, quality_score AS latest_quality_score,
  run_id AS latest_run_id, CAST(created_at AS VARCHAR) AS latest_validated_at
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN latest ON dataset_id = CAST(c_custkey AS VARCHAR) AND r = 1
WHERE c_acctbal >= 0 AND r_name IN ('ASIA', 'EUROPE', 'AFRICA', 'AMERICA', 'MIDDLE EAST')""")
def quality_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets, schemas, connections = _hierarchy(spark, sf_dir)
    return reports.quality_by_dataset(datasets, schemas, connections, runs(spark, sf_dir)).withColumn(
        "latest_validated_at", F.col("latest_validated_at").cast("string"))


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datasets = customers, schemas = nations, connections = regions."""
    datasets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_name").alias("dataset_name"),
        F.col("c_nationkey").alias("schema_id"), (F.col("c_acctbal") >= 0).alias("is_active"))
    schemas = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("schema_id"), F.col("n_regionkey").alias("connection_id"))
    connections = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("connection_id"), F.col("r_name").alias("data_source_id"))
    return datasets, schemas, connections


@registry.add("quality_by_dataset_of_source", "WITH " + RUNS + """,
latest AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS r FROM runs
  WHERE quality_score IS NOT NULL)
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, quality_score AS latest_quality_score, run_id AS latest_run_id
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
LEFT JOIN latest ON dataset_id = CAST(c_custkey AS VARCHAR) AND r = 1 WHERE c_acctbal >= 0 AND r_name = 'ASIA'""")
def quality_by_dataset_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_by_dataset(*_hierarchy(spark, sf_dir), runs(spark, sf_dir), "ASIA").select(
        "dataset_id", "latest_quality_score", "latest_run_id")


@registry.add("review_performance", "WITH " + ISSUES + "," + CORRECTIONS + """
SELECT decided_by AS reviewer_id, count(*) AS decision_count,
  CAST(round(CAST(avg(epoch_us(decided_at) - epoch_us(created_at)) / 1e6 AS DECIMAL(38, 8)), 4) AS DOUBLE)
    AS avg_latency_seconds
FROM corrections JOIN issues USING (issue_id)
WHERE decided_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1""")
def review_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_performance(
        corrections(spark, sf_dir), issues(spark, sf_dir), _at("1996-01-01"), _at("1998-12-31")).withColumn(
        "avg_latency_seconds", text.rounded(F.col("avg_latency_seconds"), 4))


@registry.add("approval_metrics", "WITH " + REQUESTS + """
SELECT count(*) AS total_requests, count(*) FILTER (status = 'APPROVED') AS approved_count,
  count(*) FILTER (status = 'REJECTED') AS rejected_count,
  count(*) FILTER (status = 'PARTIALLY_APPROVED') AS partially_approved_count,
  count(*) FILTER (status = 'PENDING') AS pending_count,
  CAST(round(CAST(CAST(count(*) FILTER (status = 'APPROVED') AS DOUBLE) / count(*) AS DECIMAL(38, 12)), 8) AS DOUBLE)
    AS approval_rate,
  CAST(round(CAST(avg(epoch_us(decided_at) - epoch_us(requested_at)) / 1e6 AS DECIMAL(38, 8)), 4) AS DOUBLE)
    AS avg_decision_latency_seconds
FROM requests WHERE requested_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""")
def approval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.approval_metrics(requests(spark, sf_dir), _at("1996-01-01"), _at("1998-12-31"))
    return found.withColumn("approval_rate", text.rounded(F.col("approval_rate"), 8)).withColumn(
        "avg_decision_latency_seconds", text.rounded(F.col("avg_decision_latency_seconds"), 4))


@registry.add("failures_by_severity", "WITH " + FAILURES + """
SELECT severity, count(*) AS failure_count FROM failures WHERE run_id = (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem
  GROUP BY l_orderkey ORDER BY count(*) DESC, l_orderkey LIMIT 1) GROUP BY 1""")
def failures_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failures_by_severity(failures(spark, sf_dir), _largest_run(spark, sf_dir))


def _largest_run(spark: SparkSession, sf_dir: str) -> str:
    return str(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().orderBy(
        F.desc("count"), "l_orderkey").first()["l_orderkey"])


LARGEST = """largest AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id FROM lineitem GROUP BY l_orderkey
  ORDER BY count(*) DESC, l_orderkey LIMIT 1)"""


@registry.add("failure_detail", "WITH " + FAILURES + "," + RULES + """
SELECT f.run_id, record_ref, f.assignment_id, f.severity, failed_value, rule_id, rule_name, version
FROM failures f JOIN rules USING (assignment_id)""")
def failure_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = failures(spark, sf_dir).withColumn("order_run", F.col("run_id")).withColumn("run_id", F.lit("all"))
    return reports.failure_detail(everything, rules(spark, sf_dir), "all").select(
        F.col("order_run").alias("run_id"), "record_ref", "assignment_id", "severity", "failed_value", "rule_id",
        "rule_name", "version")


@registry.add("failure_page", "WITH " + FAILURES + "," + RULES + "," + LARGEST + """
SELECT record_ref, f.assignment_id, f.severity, rule_name FROM failures f JOIN rules USING (assignment_id)
WHERE run_id = (SELECT run_id FROM largest) AND f.column_name = 'l_quantity'
ORDER BY row_index, record_ref, f.assignment_id LIMIT 3 OFFSET 3""")
def failure_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_failures(
        failures(spark, sf_dir), rules(spark, sf_dir), _largest_run(spark, sf_dir), page=2, page_size=3,
        column_name="l_quantity").rows.select("record_ref", "assignment_id", "severity", "rule_name")


@registry.add("failure_total", "WITH " + FAILURES + "," + LARGEST + """
SELECT count(*) AS total FROM failures WHERE run_id = (SELECT run_id FROM largest) AND severity = 'HIGH'""")
def failure_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_failures(
        failures(spark, sf_dir), rules(spark, sf_dir), _largest_run(spark, sf_dir), severity="HIGH").total


@registry.add("evaluated_rules", "WITH " + RULES + "," + LARGEST + """
SELECT DISTINCT assignment_id, rule_id, rule_name, rule_type, version, severity, column_name
FROM lineitem JOIN rules ON assignment_id = 'A' || l_linenumber WHERE l_orderkey = (SELECT CAST(run_id AS BIGINT)
  FROM largest)""")
def evaluated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.lit("rule_evaluated").alias("metric_name"),
        F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("metric_group"),
        F.lit(1).alias("metric_value")).distinct()
    return reports.evaluated_rules(metrics, rules(spark, sf_dir), _largest_run(spark, sf_dir))


@registry.add("enabled_assignments", """
SELECT CAST(o_orderkey AS VARCHAR) AS assignment_id, CAST(c_custkey AS VARCHAR) AS version_id, n_name AS rule_name,
  r_name AS rule_type FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def enabled_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    assignments = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("assignment_id"), F.col("o_custkey").cast("string").alias("version_id"),
        F.col("o_orderstatus").alias("dataset_id"), (F.col("o_totalprice") > 100000).alias("is_enabled"))
    versions = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("version_id"), F.col("c_nationkey").alias("rule_id"),
        F.lit(1).alias("version"), F.lit("{}").alias("definition"), F.lit("LOW").alias("severity"))
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = named.select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"),
                         F.col("r_name").alias("rule_type"))
    return reports.enabled_assignments(assignments, versions, known, "F").select(
        "assignment_id", "version_id", "rule_name", "rule_type")


@registry.add("dataset_listing", """
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS dataset_name FROM customer
WHERE c_acctbal >= 0 AND c_name ILIKE '%OMER#00000001%'""")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets, _, _ = _hierarchy(spark, sf_dir)
    return reports.list_datasets(datasets, search="OMER#00000001", is_active=True).select("dataset_id", "dataset_name")


@registry.add("visible_connections", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-06-01')""")
def visible_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "O").alias("is_active"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deactivated_at"))
    return reports.visible(entities, _at("1997-06-01")).select("o_orderkey")


@registry.add("run_listing", "WITH " + RUNS + """
SELECT run_id, dataset_id, quality_score FROM runs WHERE status = 'COMPLETED'""")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_runs(runs(spark, sf_dir), status="COMPLETED").select("run_id", "dataset_id", "quality_score")


@registry.add("latest_completed_runs", "WITH " + RUNS + """
SELECT dataset_id, arg_max(run_id, (created_at, run_id)) AS run_id, CAST(max(created_at) AS VARCHAR) AS created_at
FROM runs WHERE status = 'COMPLETED' GROUP BY 1""")
def latest_completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_completed_runs(runs(spark, sf_dir)).withColumn("created_at", F.col("created_at").cast("string"))


@registry.add("ranked_scores", "WITH " + RUNS + """
SELECT run_id, dataset_id, recency FROM (SELECT run_id, dataset_id,
  row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS recency
  FROM runs WHERE quality_score IS NOT NULL) WHERE recency <= 3""")
def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked_scores(runs(spark, sf_dir), keep=3).select(
        "run_id", "dataset_id", F.col("recency").cast("bigint").alias("recency"))


@registry.add("issue_summaries", "WITH " + ISSUES + """
SELECT issue_id, review_run_id, severity, status, column_name FROM issues""")
def summaries_of_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_summaries(issues(spark, sf_dir))


@registry.add("suggestion_trace", """
WITH used AS (SELECT l_orderkey, count(*) AS calls, count(*) FILTER (l_returnflag <> 'R') AS successful_calls,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_partkey + l_suppkey END) AS BIGINT) AS total_tokens FROM lineitem GROUP BY 1),
wanted AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 50000 THEN o_orderkey END AS call
  FROM orders)
SELECT CAST(w.o_orderkey AS VARCHAR) AS suggestion_id, w.call IS NOT NULL AS is_llm_backed,
  CASE WHEN w.call IS NULL THEN 'NO_AI_CALL' WHEN o.o_orderkey IS NULL THEN 'BROKEN_LINKAGE' ELSE 'OK' END AS linkage_status,
  o.o_orderpriority AS model, c_name AS prompt_key, coalesce(calls, 0) AS calls,
  coalesce(successful_calls, 0) AS successful_calls, total_tokens
FROM wanted w LEFT JOIN orders o ON o.o_orderkey = w.call AND o.o_totalprice < 400000
LEFT JOIN customer ON c_custkey = o.o_custkey LEFT JOIN used ON l_orderkey = o.o_orderkey""")
def suggestion_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    made = orders.select(
        F.col("o_orderkey").cast("string").alias("suggestion_id"),
        F.when(F.col("o_orderstatus") != "F", "AI").otherwise("RULE_BASED").alias("source"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_orderkey")).alias("ai_suggestion_id"))
    calls = orders.where("o_totalprice < 400000").select(
        F.col("o_orderkey").alias("ai_suggestion_id"), F.lit("provider").alias("provider"),
        F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("prompt_version_id"))
    prompts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("prompt_version_id"), F.col("c_name").alias("prompt_key"), F.lit(1).alias("version_number"))
    usage = lines.select(
        F.col("l_orderkey").alias("ai_suggestion_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("input_tokens"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("output_tokens"))
    return reports.suggestion_trace(made, calls, prompts, usage).select(
        "suggestion_id", "is_llm_backed", "linkage_status", "model", "prompt_key", "calls", "successful_calls",
        "total_tokens")
