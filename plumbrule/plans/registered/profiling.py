"""Profiles, key discovery, rule detection and column roles of the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.operators import detect
from plumbrule.operators.evidence.roles import applicable_strategies, column_roles
from plumbrule.operators.keys import combo_evidence, confirm_key, discover_keys, evidence_table
from plumbrule.operators.profile import (
    dataset_duplicate_percentage, profile, profile_each, profile_run_summary, steward_summary, top_values, value_counts,
)
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import FAULTY_ORDERS, faulty_orders, table
from plumbrule.spec import KeySpec, SpecError

registry = Registry()

# Columns of the profiled tables with their normalized type, for the SQL.
COLUMNS = {
    "orders": (("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "STRING"),
               ("o_totalprice", "DECIMAL"), ("o_orderdate", "DATETIME"), ("o_orderpriority", "STRING")),
    "lineitem": (("l_orderkey", "INTEGER"), ("l_partkey", "INTEGER"), ("l_suppkey", "INTEGER"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "DECIMAL"), ("l_extendedprice", "DECIMAL"),
                 ("l_discount", "DECIMAL"), ("l_tax", "DECIMAL"), ("l_returnflag", "STRING"),
                 ("l_linestatus", "STRING"), ("l_shipdate", "DATETIME")),
    "documents": (("doc_id", "INTEGER"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"),
                  ("n_chars", "INTEGER")),
    "events": (("event_id", "INTEGER"), ("ts", "DATETIME"), ("user_id", "INTEGER"), ("event_type", "STRING"),
               ("value", "DECIMAL"), ("props", "STRING")),
    "customer": (("c_custkey", "INTEGER"), ("c_name", "STRING"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "DECIMAL"), ("c_mktsegment", "STRING")),
    "part": (("p_partkey", "INTEGER"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INTEGER"), ("p_retailprice", "DECIMAL")),
}


def _column_sql(source: str, name: str, kind: str) -> str:
    numeric, words, times = kind in ("INTEGER", "DECIMAL"), kind == "STRING", kind == "DATETIME"
    d = f"CAST({name} AS DOUBLE)"
    text = f"CAST({name} AS VARCHAR)"
    mode = f"(SELECT {d if numeric else name} FROM {source} WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    fence = (f"(SELECT quantile_cont({d}, 0.25) AS a, quantile_cont({d}, 0.75) AS b FROM {source})")
    pct = "((20000 * ({0}) + count(*)) // (2 * count(*))) / 100.0".format
    repeated = f"greatest(0, count({name}) - count(DISTINCT {name}))"
    null = "CAST(NULL AS {})".format
    six = "CAST(round(CAST({0} AS DECIMAL(38, 10)), 6) AS DOUBLE)".format
    return f"""
SELECT '{name}' AS column_name, '{kind}' AS normalized_data_type, count(*) AS row_count,
  count(*) - count({name}) AS null_count, {pct(f'count(*) - count({name})')} AS null_percentage,
  count(DISTINCT {name}) AS distinct_count, {pct(f'count(DISTINCT {name})')} AS distinct_percentage,
  {repeated} AS duplicate_count, {pct(repeated)} AS duplicate_percentage,
  {f'CAST(min({d}) AS VARCHAR)' if numeric else f'CAST(min({name}) AS VARCHAR)'} AS min_value,
  {f'CAST(max({d}) AS VARCHAR)' if numeric else f'CAST(max({name}) AS VARCHAR)'} AS max_value,
  {six(f'avg({d})') if numeric else null('DOUBLE')} AS mean_value,
  {six(f'quantile_cont({d}, 0.5)') if numeric else null('DOUBLE')} AS median_value,
  {null('VARCHAR') if times else f'CAST({mode} AS VARCHAR)'} AS mode_value,
  {f'min(length({name}))' if words else null('BIGINT')} AS min_length,
  {f'max(length({name}))' if words else null('BIGINT')} AS max_length,
  {f'((200 * CAST(sum(length({name})) AS BIGINT) + count({name})) // (2 * count({name}))) / 100.0' if words
    else null('DOUBLE')} AS avg_length,
  {f'''(SELECT count(*) FROM {source}, {fence} WHERE {d} < a - 1.5 * (b - a) OR {d} > b + 1.5 * (b - a))'''
    if numeric else null('BIGINT')} AS outlier_count,
  {six(f'stddev_pop({d})') if numeric else null('DOUBLE')} AS stddev_value,
  {f'round(sum({d}), 2)' if numeric else null('DOUBLE')} AS sum_value,
  {f"count(*) FILTER (regexp_matches({text}, '^\\s*$'))" if words else '0'} AS blank_count
FROM {source}"""


def _profile_sql(source: str, columns: tuple[tuple[str, str], ...], prefix: str = "") -> str:
    return prefix + " UNION ALL ".join(_column_sql(source, n, k) for n, k in columns)


def _flat(profiles: DataFrame, *more: str) -> DataFrame:
    return profiles.select(
        *more, "column_name", "normalized_data_type", "row_count", "null_count", "null_percentage", "distinct_count",
        "distinct_percentage", "duplicate_count", "duplicate_percentage", "min_value", "max_value", "mean_value",
        "median_value", "mode_value", F.col("min_length").cast("bigint").alias("min_length"),
        F.col("max_length").cast("bigint").alias("max_length"), "avg_length", "outlier_count", "stddev_value",
        F.round("sum_value", 2).alias("sum_value"), F.col("pattern_summary.blank_count").alias("blank_count"))


@registry.add("profile_orders", _profile_sql("faulty_orders", COLUMNS["orders"], "WITH " + FAULTY_ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile(faulty_orders(spark, sf_dir), include_top_values=False))


@registry.add("profile_lineitem", _profile_sql("lineitem", COLUMNS["lineitem"]))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile(table(spark, sf_dir, "lineitem"), include_top_values=False))


@registry.add("profile_documents", _profile_sql("documents", COLUMNS["documents"]))
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile(table(spark, sf_dir, "documents"), include_top_values=False))


@registry.add("profile_events", _profile_sql("events", COLUMNS["events"]))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(profile(table(spark, sf_dir, "events"), include_top_values=False))


def _top_sql(source: str, columns: tuple[tuple[str, str], ...]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{name}' AS column_name, position, value, n FROM (
  SELECT v AS value, n, row_number() OVER (ORDER BY n DESC, v) AS position FROM (
    SELECT substring(CAST({name} AS VARCHAR), 1, 100) AS v, count(*) AS n FROM {source} WHERE {name} IS NOT NULL
    GROUP BY 1)) WHERE position <= 10""" for name, _ in columns)


def _top(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in df.columns])
    return top_values(value_counts(df)).select(
        F.get(names, F.col("c")).alias("column_name"), F.posexplode("value_distribution").alias("at", "v")).select(
        "column_name", (F.col("at") + 1).cast("bigint").alias("position"), F.col("v.value").alias("value"),
        F.col("v.count").alias("n"))


@registry.add("top_values_lineitem", _top_sql("lineitem", COLUMNS["lineitem"]))
def top_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(table(spark, sf_dir, "lineitem"))


@registry.add("top_values_documents", _top_sql("documents", COLUMNS["documents"]))
def top_values_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(table(spark, sf_dir, "documents"))


@registry.add("dataset_duplicates", """
WITH kept AS (SELECT l_suppkey, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)
SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS duplicate_rows,
  ((20000 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept))) + count(*)) // (2 * count(*))) / 100.0
    AS duplicate_percentage FROM kept""")
def dataset_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_duplicate_percentage(table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"))


@registry.add("profile_summary", """
SELECT count(*) AS sample_size, count(*) AS row_count, CAST(6 AS BIGINT) AS columns_profiled,
       true AS is_full_scan FROM orders""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_run_summary(profile(table(spark, sf_dir, "orders"), include_top_values=False), None, True)


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with two columns whose declared type does not fit their values."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").cast("int").alias("flag"), "l_quantity", "l_linestatus",
        F.raise_error(F.col("l_shipdate").cast("string")).cast("int").alias("broken"), "l_tax")


_READABLE = (("l_orderkey", "INTEGER"), ("l_quantity", "DECIMAL"), ("l_linestatus", "STRING"), ("l_tax", "DECIMAL"))


@registry.add("profile_failing_columns", "SELECT *, 'COMPLETED' AS status FROM (" + _profile_sql("lineitem", _READABLE) + """)
UNION ALL BY NAME SELECT unnest(['flag', 'broken']) AS column_name, 'INTEGER' AS normalized_data_type, 'FAILED' AS status""")
def profile_failing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that cannot be read fail by themselves."""
    rows = profile_each(_unreadable(spark, sf_dir), include_top_values=False)
    return _flat(rows, "status")


@registry.add("profile_failing_summary", """
SELECT count(*) AS sample_size, count(*) AS row_count, CAST(4 AS BIGINT) AS columns_profiled, true AS is_full_scan,
  CAST(2 AS BIGINT) AS columns_failed, '4/6 columns profiled, 2 failed' AS error_message FROM lineitem""")
def profile_failing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_run_summary(profile_each(_unreadable(spark, sf_dir), include_top_values=False), None, True)


@registry.add("steward_summary", "SELECT column_name, normalized_data_type, null_percentage, distinct_percentage, "
              "duplicate_percentage, min_length, max_length FROM (" + _profile_sql("customer", COLUMNS["customer"]) + ")")
def steward_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steward_summary(_flat(profile(table(spark, sf_dir, "customer"), include_top_values=False)))


_KEY_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "flag")
_KEY_COMBOS = tuple((c,) for c in _KEY_COLUMNS) + (
    ("l_orderkey", "l_partkey"), ("l_orderkey", "l_suppkey"), ("l_orderkey", "flag"), ("l_partkey", "l_suppkey"),
    ("l_orderkey", "l_partkey", "l_suppkey"), ("l_orderkey", "l_partkey", "flag"))


def _combo_sql(combo: tuple[str, ...]) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in combo)
    return f"""
SELECT '{','.join(combo)}' AS key_columns, CAST({len(combo)} AS BIGINT) AS width,
  CAST((SELECT count(*) FROM keyed) AS BIGINT) AS total_rows_evaluated,
  (SELECT count(*) FROM keyed WHERE NOT ({complete})) AS null_key_rows,
  count(*) AS distinct_key_count, count(*) FILTER (n > 1) AS duplicate_key_groups
FROM (SELECT {', '.join(combo)}, count(*) AS n FROM keyed WHERE {complete} GROUP BY {', '.join(combo)})"""


@registry.add("key_evidence", """
WITH keyed AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag
  FROM lineitem),
found AS (""" + " UNION ALL ".join(_combo_sql(c) for c in _KEY_COMBOS) + """)
SELECT *, CASE WHEN null_key_rows > 0 AND duplicate_key_groups > 0 THEN 'contains_null_values_and_duplicate_values'
  WHEN null_key_rows > 0 THEN 'contains_null_values' WHEN duplicate_key_groups > 0 THEN 'duplicate_values' END AS reason,
  CASE WHEN null_key_rows = 0 AND duplicate_key_groups = 0 THEN 'VERIFIED_UNIQUE' END AS verification_level
FROM found""")
def key_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"))
    return combo_evidence(keyed, _KEY_COMBOS).select(
        F.array_join("key_columns", ",").alias("key_columns"), F.col("width").cast("bigint").alias("width"), "total_rows_evaluated", "null_key_rows",
        "distinct_key_count", "duplicate_key_groups", "reason", "verification_level")


# Order lines with values derived from them: only three columns together tell all rows apart.
_WIDE = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": "l_shipdate",
    "half": "CASE WHEN l_orderkey > 5 THEN l_partkey END", "flags": "l_returnflag || ',' || l_linestatus",
    "quantity": "CAST(l_quantity AS BIGINT)", "price": "l_extendedprice", "mode": "l_suppkey % 7"}
_WIDE_KEYS = [c for c in _WIDE if c != "price"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} AS `{name}`" for name, sql in _WIDE.items()])


def _discovery_sql(names: list[str]) -> str:
    looked = " UNION ALL ".join(
        f"SELECT {w} AS w, '{'+'.join(c)}' AS k, count(*) = count(DISTINCT ({', '.join(c)},)) AND "
        + " AND ".join(f"count({x}) = count(*)" for x in c) + " AS hit FROM wide" for w in (1, 2, 3) for c in combinations(names, w))
    return "WITH wide AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _WIDE.items()) + f""" FROM lineitem),
looked AS ({looked}), first AS (SELECT min(w) AS w FROM looked WHERE hit)
SELECT CASE count(*) WHEN 0 THEN 'NO_CANDIDATE' WHEN 1 THEN 'VERIFIED_UNIQUE' ELSE 'AMBIGUOUS' END AS status,
  CASE count(*) WHEN 1 THEN min(k) END AS recommended, count(*) AS candidates, (SELECT coalesce(w, 3) FROM first) AS widest,
  (SELECT count(*) FROM lineitem) AS total_rows, 'price' AS rejected
FROM looked JOIN first USING (w) WHERE hit"""


@registry.add("discovered_keys", _discovery_sql(_WIDE_KEYS))
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on twelve columns up to width 3."""
    found = discover_keys(_wide(spark, sf_dir))
    return spark.createDataFrame(
        [(found.status, "+".join(found.recommended) if found.recommended else None, len(found.candidates), max(found.widths_searched),
          found.total_rows, ",".join(found.rejected_columns))],
        "status string, recommended string, candidates bigint, widest int, total_rows bigint, rejected string")


@registry.add("key_candidates", """
SELECT 'conv_id+turn' AS key_columns, count(*) AS rows, count(DISTINCT (conv_id, turn)) AS keys, 'EXACT' AS counted,
  CASE WHEN count(*) = count(DISTINCT (conv_id, turn)) THEN 'CANDIDATE' ELSE 'REJECTED' END AS status FROM conversations""")
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was counted exactly of the turns of conversations: texts are free text there and take no part."""
    turns = table(spark, sf_dir, "conversations")
    declared = turns.withMetadata("text", {"normalized_type": "TEXT"})
    found = evidence_table(spark, discover_keys(declared))
    return found.where("counted = 'EXACT'").select(
        F.array_join("key_columns", "+").alias("key_columns"), F.col("total_rows_evaluated").alias("rows"),
        F.col("distinct_key_count").alias("keys"), "counted", "status")


@registry.add("confirmed_key", """
SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderkey+o_custkey', 'o_orderkey (declared)']) AS asked,
  unnest([(SELECT count(*) = count(DISTINCT o_orderkey) FROM orders), false, false, false]) AS confirmed""")
def confirmed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is adopted while it is the verified one, and never in place of a declared one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    asked = [(("o_orderkey",), KeySpec()), (("o_custkey",), KeySpec()), (("o_orderkey", "o_custkey"), KeySpec()),
             (("o_orderkey",), KeySpec(("o_orderkey",)))]

    def adopted(columns: tuple[str, ...], declared: KeySpec) -> bool:
        try:
            return confirm_key(orders, columns, declared) == KeySpec(columns)
        except SpecError:
            return False

    return spark.createDataFrame(
        [("+".join(c) + (" (declared)" if d.is_reliable else ""), adopted(c, d)) for c, d in asked], "asked string, confirmed boolean")


# Contact table derived from customers: names of the columns decide, or the values do.
CONTACTS = """
contacts AS (
  SELECT c_custkey AS customer_id, c_name AS notes, lower(c_mktsegment) || '@example.org' AS reach,
         '+1 555-' || CAST(1000000 + c_nationkey AS VARCHAR) AS line, c_acctbal AS balance,
         c_mktsegment AS mobile_kind, c_nationkey AS region_no, c_nationkey * 2 AS grade FROM customer)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("notes"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("reach"),
        F.concat(F.lit("+1 555-"), (F.col("c_nationkey") + 1000000).cast("string")).alias("line"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("mobile_kind"),
        F.col("c_nationkey").alias("region_no"), (F.col("c_nationkey") * 2).alias("grade"))


_CATEGORIES = (
    "SELECT 'customer_id' AS column_name, 'id' AS category, 0.85 AS confidence, 'UNIQUENESS' AS rule_type, "
    "'{\"max_duplicate_percentage\":0}' AS definition "
    "UNION ALL SELECT 'notes', 'id', 0.80, 'UNIQUENESS', '{\"max_duplicate_percentage\":0}' "
    "UNION ALL SELECT 'reach', 'email', 0.96, 'PATTERN', '{\"regex\":\"^[^@\\\\s]+@[^@\\\\s]+\\\\.[^@\\\\s]+$\"}' "
    "UNION ALL SELECT 'line', 'phone', 0.92, 'PATTERN', '{\"regex\":\"^\\\\+?[0-9][0-9\\\\-\\\\s]{7,18}$\"}' "
    "UNION ALL SELECT 'mobile_kind', 'phone', 0.92, 'PATTERN', "
    "'{\"regex\":\"^\\\\+?[0-9][0-9\\\\-\\\\s]{7,18}$\"}' "
    "UNION ALL SELECT 'balance', CASE WHEN u THEN 'id' ELSE 'numeric' END, CASE WHEN u THEN 0.80 ELSE 0.88 END, "
    "CASE WHEN u THEN 'UNIQUENESS' ELSE 'RANGE' END, CASE WHEN u THEN '{\"max_duplicate_percentage\":0}' ELSE "
    "'{\"min\":' || lo || ',\"max\":' || hi || '}' END FROM (SELECT count(DISTINCT balance) > 0.75 * count(*) AS u, "
    "min(balance) AS lo, max(balance) AS hi FROM contacts) "
    "UNION ALL SELECT 'region_no', 'numeric', 0.80, 'RANGE', '{\"min\":' || CAST(min(region_no) AS DOUBLE) || "
    "',\"max\":' || CAST(max(region_no) AS DOUBLE) || '}' FROM contacts "
    "UNION ALL SELECT 'grade', 'numeric', 0.80, 'RANGE', '{\"min\":' || CAST(min(grade) AS DOUBLE) || ',\"max\":' || "
    "CAST(max(grade) AS DOUBLE) || '}' FROM contacts")


@registry.add("detect_rules", "WITH " + CONTACTS + " SELECT column_name, category, CAST(confidence AS DOUBLE) AS "
              "confidence, rule_type, definition FROM (" + _CATEGORIES + ")")
def detect_contact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_rules(profile(_contacts(spark, sf_dir))).select(
        "column_name", "category", "confidence", "rule_type", "definition")


@registry.add("undecided_columns", """
SELECT count(*) AS considered, least(count(*), 2) AS listed, greatest(count(*) - 2, 0) AS beyond_cap FROM (
  SELECT count(DISTINCT lang) AS d, count(*) AS n FROM documents UNION ALL
  SELECT count(DISTINCT source), count(*) FROM documents UNION ALL
  SELECT count(DISTINCT text), count(*) FROM documents) WHERE d <= 0.75 * n""")
def undecided_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_rules(profile(table(spark, sf_dir, "documents")))
    return detect.undecided_report(found, cap=2).select(
        "considered", F.col("listed").cast("bigint").alias("listed"), F.col("beyond_cap").cast("bigint").alias("beyond_cap"))


@registry.add("merged_proposals", """
SELECT 'lang' AS column_name, 'PATTERN' AS rule_type, '{"regex":"^' || source || '$"}' AS definition,
  CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence FROM documents WHERE doc_id % 3 = 0""")
def merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per document: usable, of an unknown type or column, or not an object."""
    documents = table(spark, sf_dir, "documents")
    found = detect.detect_rules(profile(documents.select("doc_id", "lang", "source"), include_top_values=True))
    head = F.when(F.col("doc_id") % 3 == 0, '"lang","rule_type":"PATTERN"').when(
        F.col("doc_id") % 3 == 1, '"source","rule_type":"GUESS"').otherwise('"ghost","rule_type":"RANGE"')
    answer = F.concat(
        F.lit('```json\n[{"column_name":'), head, F.lit(',"definition":{"regex":"^'), F.col("source"), F.lit('$"},"confidence":'),
        (F.col("n_chars") % 100 / 100).cast("string"), F.lit('},{"column_name":"source","rule_type":"RANGE","definition":"none"}]\n```'))
    merged = detect.merge_proposals(found, detect.parse_rule_proposals(documents.select(answer.alias("text"))))
    return merged.select("column_name", "rule_type", "definition", "confidence")


@registry.add("promotion_outcomes", """
WITH proposed AS (SELECT 'c' || p_partkey AS column_name, p_size, p_partkey % 4 AS kind, p_partkey % 5 AS state FROM part)
SELECT column_name, CASE WHEN state = 0 OR (act = 'PROMOTE' AND kind = 3) THEN CASE WHEN state = 0 THEN 'ACTIVE' ELSE 'PENDING_REVIEW' END
    WHEN act = 'PROMOTE' THEN 'ACTIVE' ELSE 'DISABLED' END AS status,
  CASE WHEN act = 'PROMOTE' AND state <> 0 AND kind <> 3 THEN CASE WHEN kind = 2 THEN 'DATASET_LEVEL' ELSE 'SINGLE_COLUMN' END END AS scope,
  CASE WHEN state = 0 THEN 'not pending review' WHEN act = 'PROMOTE' AND kind = 3 THEN 'cross-column rules need chosen columns' END
    AS refused_reason
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'PROMOTE' ELSE 'DISMISS' END AS act FROM proposed)""")
def promotion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name, kind = F.concat(F.lit("c"), F.col("p_partkey")).alias("column_name"), F.col("p_partkey") % 4
    proposals = part.select(
        name, F.when(kind == 2, "DUPLICATE").when(kind == 3, "CROSS_COLUMN").otherwise("COMPLETENESS").alias("rule_type"),
        F.lit("{}").alias("definition"), F.lit("MEDIUM").alias("severity"),
        F.when(F.col("p_partkey") % 5 == 0, "ACTIVE").otherwise("PENDING_REVIEW").alias("status"))
    decisions = part.select(name, F.when(F.col("p_size") % 2 == 0, "PROMOTE").otherwise("DISMISS").alias("action"))
    return detect.promotion_outcomes(proposals, decisions).select("column_name", "status", "scope", "refused_reason")


@registry.add("current_rule_versions", """
SELECT rule_id, definition, version, version = max(version) OVER (PARTITION BY rule_id) AS is_current FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS rule_id, CAST(o_orderkey AS VARCHAR) AS definition,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS version
  FROM orders)""")
def current_rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("rule_id"), F.col("o_orderkey").cast("string").alias("definition"),
        F.col("o_orderdate").alias("published_at"))
    return detect.current_versions(versions).select(
        "rule_id", "definition", F.col("version").cast("bigint").alias("version"), "is_current")


@registry.add("column_roles", """
WITH stats AS (""" + _profile_sql("part", COLUMNS["part"]) + """)
SELECT column_name, CASE WHEN column_name = 'p_partkey' THEN 'IDENTIFIER'
  WHEN normalized_data_type IN ('INTEGER', 'DECIMAL') THEN
    CASE WHEN distinct_percentage >= 95 AND row_count >= 20 THEN 'IDENTIFIER' ELSE 'MEASURE' END
  WHEN distinct_percentage >= 95 THEN 'IDENTIFIER' ELSE 'DIMENSION' END AS role FROM stats""")
def part_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_roles(profile(table(spark, sf_dir, "part"), include_top_values=False), ("p_partkey",)).select(
        "column_name", "role")


@registry.add("applicable_strategies", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN kind IN ('INTEGER') AND rule IN ('COMPLETENESS', 'UNIQUENESS') THEN 'SEQUENCE'
  WHEN kind IN ('INTEGER') AND rule IN ('RANGE', 'PATTERN') THEN 'RELATIONSHIP'
  WHEN kind = 'STRING' AND rule = 'COMPLETENESS' THEN 'SEQUENCE,TEMPLATE'
  WHEN kind = 'STRING' AND rule = 'UNIQUENESS' THEN 'SEQUENCE'
  WHEN kind = 'STRING' AND rule = 'PATTERN' THEN 'TEMPLATE'
  WHEN kind = 'DATE' AND rule IN ('COMPLETENESS', 'UNIQUENESS') THEN 'TEMPORAL' ELSE '' END AS strategies
FROM (SELECT l_orderkey, l_linenumber, l_partkey,
        CASE l_returnflag WHEN 'A' THEN 'INTEGER' WHEN 'N' THEN 'STRING' ELSE 'DATE' END AS kind,
        CASE WHEN l_linenumber <= 2 THEN 'COMPLETENESS' WHEN l_linenumber <= 4 THEN 'UNIQUENESS'
             WHEN l_linenumber <= 6 THEN 'RANGE' ELSE 'PATTERN' END AS rule FROM lineitem)""")
def strategies_of_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    kind = F.when(flag == "A", "INTEGER").when(flag == "N", "STRING").otherwise("DATE")
    rule = F.when(line <= 2, "COMPLETENESS").when(line <= 4, "UNIQUENESS").when(line <= 6, "RANGE").otherwise("PATTERN")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array_join(F.array_sort(applicable_strategies(kind, rule)), ",").alias("strategies"))
