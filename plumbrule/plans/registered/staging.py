"""Corrected fields, snapshots, drift, coercion and the corrected copy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.functions.storage import ensure_checkpoint_dir
from plumbrule.operators import stage
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import table
from plumbrule.sources import sinks
from plumbrule.spec import KeySpec

registry = Registry()
ORDER_KEY = KeySpec(("o_orderkey",))

# Corrections of orders: cheap ones get a new priority, and their price when they are open. The original
# value on record is out of date for some customers, and some corrected records no longer exist.
FIXES = """
fixes AS (
  SELECT CAST(CASE WHEN o_totalprice < 5000 THEN -o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS record_ref,
         'o_orderpriority' AS column_name, 'p' || o_orderkey AS issue_id,
         CASE WHEN o_custkey < 300 THEN 'old' ELSE o_orderpriority END AS original_value, '1-URGENT' AS final_value
  FROM orders WHERE o_totalprice < 60000
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice', 't' || o_orderkey, CAST(o_totalprice AS VARCHAR),
         CAST(o_orderkey + 1 AS VARCHAR) || '.5'
  FROM orders WHERE o_totalprice >= 5000 AND o_totalprice < 40000 AND o_orderstatus = 'O')"""


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    priority = orders.where(price < 60000).select(
        F.when(price < 5000, -key - 1).otherwise(key).cast("string").alias("record_ref"),
        F.lit("o_orderpriority").alias("column_name"), F.concat(F.lit("p"), key.cast("string")).alias("issue_id"),
        F.when(F.col("o_custkey") < 300, "old").otherwise(F.col("o_orderpriority")).alias("original_value"),
        F.lit("1-URGENT").alias("final_value"))
    prices = orders.where((price >= 5000) & (price < 40000) & (F.col("o_orderstatus") == "O")).select(
        key.cast("string").alias("record_ref"), F.lit("o_totalprice").alias("column_name"),
        F.concat(F.lit("t"), key.cast("string")).alias("issue_id"), price.cast("string").alias("original_value"),
        F.concat((key + 1).cast("string"), F.lit(".5")).alias("final_value"))
    return priority.unionByName(prices)


@registry.add("field_corrections", """
WITH scope AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_ref, 'f' || l_linenumber AS column_name,
  CASE WHEN l_discount > 0.01 THEN l_returnflag END AS final_value FROM lineitem)
SELECT record_ref, column_name, count(*) AS issue_count, min(final_value) AS final_value,
  CASE WHEN count(*) > count(final_value) THEN 'missing final value' WHEN min(final_value) <> max(final_value)
    THEN 'conflicting final values' END AS problem
FROM scope GROUP BY 1, 2""")
def field_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_ref"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("issue_id"), F.lit("x").alias("original_value"),
        F.when(F.col("l_discount") > 0.01, F.col("l_returnflag")).alias("final_value"))
    return stage.field_corrections(scope).select("record_ref", "column_name", "issue_count", "final_value", "problem")


STAGED = """
per AS (SELECT record_ref, max(final_value) FILTER (column_name = 'o_orderpriority') AS priority,
  max(original_value) FILTER (column_name = 'o_orderpriority') AS old_priority,
  max(final_value) FILTER (column_name = 'o_totalprice') AS price,
  max(original_value) FILTER (column_name = 'o_totalprice') AS old_price, count(*) AS fields FROM fixes GROUP BY 1),
staged AS (SELECT p.*, o.*, CASE WHEN o_orderkey IS NULL THEN 'RECORD_NOT_FOUND'
  WHEN (priority IS NOT NULL AND old_priority IS DISTINCT FROM o_orderpriority)
    OR (price IS NOT NULL AND old_price IS DISTINCT FROM CAST(o_totalprice AS VARCHAR)) THEN 'VALUE_CHANGED'
  ELSE 'UNCHANGED' END AS drift_status
  FROM per p LEFT JOIN orders o ON CAST(o_orderkey AS VARCHAR) = record_ref)"""


@registry.add("staged_records", "WITH " + FIXES + "," + STAGED + """
SELECT record_ref, fields AS corrected_fields, drift_status,
  CASE WHEN drift_status = 'VALUE_CHANGED' THEN 'o_orderpriority' END AS drift_fields,
  CASE WHEN o_orderkey IS NULL THEN '{"o_orderpriority":"' || priority || '"}' ELSE
    '{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') ||
    '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || coalesce(priority, o_orderpriority) ||
    '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' ||
    coalesce('"' || price || '"', CAST(o_totalprice AS VARCHAR)) || '}' END AS row_snapshot FROM staged""")
def staged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.stage_records(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir)).select(
        "record_ref", F.size("corrected_fields").cast("bigint").alias("corrected_fields"), "drift_status",
        F.array_join("drift_fields", ",").alias("drift_fields"), "row_snapshot")


@registry.add("drifted_records", "WITH " + FIXES + "," + STAGED + """
SELECT record_ref, drift_status FROM staged WHERE drift_status <> 'UNCHANGED'""")
def drifted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.drifted_records(stage.stage_records(
        table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir))).select("record_ref", "drift_status")


@registry.add("staging_summary", "WITH " + FIXES + "," + STAGED + """
SELECT count(*) AS record_count, CAST(sum(fields) AS BIGINT) AS field_count,
  bool_or(drift_status <> 'UNCHANGED') AS has_source_drift FROM staged""")
def staging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.staging_summary(stage.stage_records(
        table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir)))


@registry.add("staging_attempts", """
SELECT CAST(o_custkey AS VARCHAR) AS review_run_id, CAST(o_orderkey AS VARCHAR) AS staging_run_id,
  row_number() OVER w AS attempt_number,
  row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))""")
def staging_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("review_run_id"), F.col("o_orderkey").cast("string").alias("staging_run_id"),
        F.col("o_orderdate").alias("created_at"))
    return stage.attempts(made).select(
        "review_run_id", "staging_run_id", F.col("attempt_number").cast("bigint").alias("attempt_number"), "is_current")


CORRECTED = "WITH " + FIXES + """
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(CAST(t.final_value AS DOUBLE), o_totalprice) AS o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, coalesce(p.final_value, o_orderpriority) AS o_orderpriority
FROM orders LEFT JOIN fixes t ON t.record_ref = CAST(o_orderkey AS VARCHAR) AND t.column_name = 'o_totalprice'
LEFT JOIN fixes p ON p.record_ref = CAST(o_orderkey AS VARCHAR) AND p.column_name = 'o_orderpriority'"""


@registry.add("corrected_copy", CORRECTED)
def corrected_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    copied = stage.overlay(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir))
    return copied.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@registry.add("published_copy", CORRECTED)
def published_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected copy, written twice to one place and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    for _ in range(2):
        stage.materialize(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@registry.add("changed_rows", "WITH " + FIXES + """
SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT record_ref FROM fixes)""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.split_changed(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir), True).select("o_orderkey")


@registry.add("unchanged_rows", "WITH " + FIXES + """
SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT record_ref FROM fixes)""")
def unchanged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.split_changed(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir), False).select("o_orderkey")


@registry.add("change_flags", "WITH " + FIXES + """
SELECT o_orderkey, coalesce(string_agg(column_name, ',' ORDER BY column_name), '') AS changed_fields,
  count(column_name) > 0 AS is_changed
FROM orders LEFT JOIN fixes ON record_ref = CAST(o_orderkey AS VARCHAR) GROUP BY 1""")
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.with_change_flag(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir)).select(
        "o_orderkey", F.array_join("changed_fields", ",").alias("changed_fields"), "is_changed")


@registry.add("coerced_values", """
WITH said AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN ' ' || l_partkey || ' '
  WHEN 'N' THEN CAST(l_quantity AS VARCHAR) ELSE CASE l_linenumber WHEN 1 THEN 'yes' WHEN 2 THEN 'F' WHEN 3 THEN 'maybe'
    ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') THEN CAST(trim(v) AS BIGINT) END AS as_integer,
  TRY_CAST(trim(v) AS DOUBLE) AS as_decimal,
  CASE WHEN lower(trim(v)) IN ('true', 't', '1', 'yes', 'y') THEN true
       WHEN lower(trim(v)) IN ('false', 'f', '0', 'no', 'n') THEN false END AS as_boolean,
  CASE WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN trim(v) END AS as_date,
  CASE WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN trim(v) || ' 00:00:00' END AS as_datetime
FROM said""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    said = F.when(flag == "A", F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" "))).when(
        flag == "N", F.col("l_quantity").cast("string")).when(line == 1, "yes").when(line == 2, "F").when(
        line == 3, "maybe").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        stage.coerced(said, T.LongType()).alias("as_integer"), stage.coerced(said, T.DoubleType()).alias("as_decimal"),
        stage.coerced(said, T.BooleanType()).alias("as_boolean"),
        stage.coerced(said, T.DateType()).cast("string").alias("as_date"),
        stage.coerced(said, T.TimestampNTZType()).cast("string").alias("as_datetime"))


@registry.add("uncoercible_corrections", "WITH " + FIXES + """
SELECT record_ref, column_name, final_value FROM (SELECT record_ref, column_name,
  CASE WHEN column_name = 'o_totalprice' AND original_value < '2' THEN 'about ' || final_value ELSE final_value END
    AS final_value FROM fixes) WHERE column_name = 'o_totalprice' AND TRY_CAST(final_value AS DOUBLE) IS NULL""")
def uncoercible_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = (F.col("column_name") == "o_totalprice") & (F.col("original_value") < "2")
    said = _fixes(spark, sf_dir).withColumn("final_value", F.when(
        vague, F.concat(F.lit("about "), "final_value")).otherwise(F.col("final_value")))
    return stage.uncoercible(said, table(spark, sf_dir, "orders").schema).select(
        "record_ref", "column_name", "final_value")


# --- sinks -----------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@registry.add("staging_table", CORRECTED.replace("SELECT o_orderkey,", "SELECT false AS written_again, true AS written_first, "
              "'orders_of_today__run7' AS table_name, o_orderkey,", 1))
def staging_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's corrected rows as a staging table, written twice: the second time changes nothing."""
    rows, base = stage.overlay(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir)), _place(spark, "staging")
    path, first = sinks.write_staging_table(rows, base, "Orders of today", "run-7")
    _, second = sinks.write_staging_table(rows.limit(1), base, "Orders of today", "run-7")
    return spark.read.parquet(path).withColumn("o_orderdate", F.col("o_orderdate").cast("string")).select(
        "*", F.lit(path.rsplit("/", 1)[1]).alias("table_name"), F.lit(first.is_new).alias("written_first"),
        F.lit(second.is_new).alias("written_again"))


@registry.add("appended_log", """
SELECT o_orderstatus AS run_id, o_orderkey AS entity_id, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of a log, one of them appended again by a job that ran twice."""
    orders, path = table(spark, sf_dir, "orders"), _place(spark, "log")
    for status in ("F", "P", "F"):
        batch = orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("entity_id"), F.col("o_totalprice").alias("price"))
        sinks.append_log(batch, path, status)
    return sinks.RunTable(spark, path).read(batch.schema)


@registry.add("exported_lines", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS c_name, c_mktsegment FROM customer""")
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a table, written over an older export and read back."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    path = _place(spark, "lines")
    sinks.export_jsonl(rows.limit(3), path)
    sinks.export_jsonl(rows, path, overwrite=True)
    return spark.read.schema(rows.schema).json(path)


@registry.add("published_run", "WITH " + FIXES + "," + STAGED + """
SELECT CAST(json_extract(row_snapshot, '$.o_orderkey') AS BIGINT) AS o_orderkey, json_extract_string(row_snapshot, '$.o_orderpriority') AS o_orderpriority,
  CASE WHEN (SELECT bool_or(drift_status <> 'UNCHANGED') FROM staged) THEN 'PENDING' ELSE 'PUBLISHED' END AS at_first, 'PUBLISHED' AS then_acknowledged,
  (SELECT count(*) FROM staged) AS row_count
FROM (SELECT CASE WHEN o_orderkey IS NULL THEN '{"o_orderpriority":"' || priority || '"}' ELSE
  '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || coalesce(priority, o_orderpriority) || '"}' END AS row_snapshot FROM staged)""")
def published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing waits while drift is not acknowledged; then the snapshots stand at the target, one per line."""
    staged = stage.stage_records(table(spark, sf_dir, "orders"), ORDER_KEY, _fixes(spark, sf_dir))
    base = _place(spark, "published")
    first = stage.publish(staged, base, "orders", True, True, overwrite=True)
    done = stage.publish(staged, base, "orders", True, True, drift_acknowledged=True, overwrite=True)
    return spark.read.schema("o_orderkey bigint, o_orderpriority string").json(done.target).select(
        "*", F.lit(first.status).alias("at_first"), F.lit(done.status).alias("then_acknowledged"),
        F.lit(done.row_count).cast("bigint").alias("row_count"))


@registry.add("destination_columns", """
SELECT row_number() OVER () AS ordinal_position, column_name, kind AS normalized_data_type, staged AS staging_type FROM (VALUES
  ('o_orderkey', 'INTEGER', 'bigint'), ('o_custkey', 'INTEGER', 'bigint'), ('o_orderstatus', 'STRING', 'string'),
  ('o_totalprice', 'DECIMAL', 'double'), ('o_orderdate', 'DATETIME', 'timestamp_ntz'), ('o_orderpriority', 'STRING', 'string')) AS v(column_name, kind, staged)
WHERE EXISTS (SELECT 1 FROM orders)""")
def destination_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage.destination_metadata(table(spark, sf_dir, "orders")).select(
        F.col("ordinal_position").cast("bigint").alias("ordinal_position"), "column_name", "normalized_data_type", "staging_type")


@registry.add("copied_on_write", "WITH " + FIXES + """
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(CAST(t.final_value AS DOUBLE), o_totalprice) AS o_totalprice,
  coalesce(p.final_value, o_orderpriority) AS o_orderpriority, true AS some_taken_over
FROM orders LEFT JOIN fixes t ON t.record_ref = CAST(o_orderkey AS VARCHAR) AND t.column_name = 'o_totalprice' AND o_orderkey % 100 = 7
LEFT JOIN fixes p ON p.record_ref = CAST(o_orderkey AS VARCHAR) AND p.column_name = 'o_orderpriority' AND o_orderkey % 100 = 7""")
def copied_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of keys that lie in one of about eight files: the others are taken over."""
    orders, source = table(spark, sf_dir, "orders"), _place(spark, "source")
    # One file of keys that end in 07, and seven of others.
    dealt = orders.withColumn("_file", F.when(F.col("o_orderkey") % 100 == 7, 0).otherwise(F.col("o_orderkey") % 7 + 1))
    dealt.repartitionByRange(8, "_file").drop("_file").write.parquet(source)
    ending = F.when(F.length("record_ref") > 1, F.substring("record_ref", -2, 2)).otherwise(F.concat(F.lit("0"), "record_ref"))
    fixes = _fixes(spark, sf_dir).where((ending == "07") & ~F.startswith("record_ref", F.lit("-")))
    made = stage.copy_on_write(spark, source, ORDER_KEY, fixes, _place(spark, "copy"))
    return stage.read_copy(spark, made.path).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.lit(made.taken_over > made.rewritten).alias("some_taken_over"))
