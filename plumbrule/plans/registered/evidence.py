"""Evidence operators on tables with known relationships, gaps and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrule.functions import text
from plumbrule.operators.evidence import gate, rank
from plumbrule.operators.evidence.relationship import relationship_evidence
from plumbrule.operators.evidence.sequence import sequence_evidence
from plumbrule.operators.evidence.template import template_evidence
from plumbrule.operators.evidence.temporal import parse_instants, temporal_evidence
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import FAILURES, failures, table
from plumbrule.spec import KeySpec

registry = Registry()

# --- relationships -----------------------------------------------------------

BILLS = """
bills AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS bill, l_returnflag, l_linestatus,
         l_extendedprice AS net, l_quantity * 100 AS fee,
         CASE WHEN l_quantity = 50 AND l_discount > 0.08 THEN -1 ELSE l_extendedprice + l_quantity * 100 END AS total
  FROM lineitem)"""


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("bill"), "l_returnflag",
        "l_linestatus", price.alias("net"), (n * 100).alias("fee"),
        F.when((n == 50) & (F.col("l_discount") > 0.08), F.lit(-1.0)).otherwise(price + n * 100).alias("total"))


@registry.add("relationship_sum", "WITH " + BILLS + """,
errors AS (SELECT *, abs(total - (net + fee)) / greatest(abs(total), abs(net + fee), 1e-9) AS err FROM bills),
groups AS (SELECT l_returnflag, l_linestatus, sum(err) AS err_sum, count(*) AS n FROM errors GROUP BY 1, 2)
SELECT bill AS issue_id, 'CANDIDATE' AS status, n - 1 AS group_size, 'sum_consistency' AS relationship_type,
  'net,fee' AS related_columns, CAST(round(CAST(net + fee AS DECIMAL(38, 8)), 4) AS DOUBLE) AS candidate_value,
  CAST(round(CAST(1 - (err_sum - err) / (n - 1) AS DECIMAL(38, 9)), 5) AS DOUBLE) AS fit_quality
FROM errors JOIN groups USING (l_returnflag, l_linestatus) WHERE total < 0""")
def relationship_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = _bills(spark, sf_dir)
    failing = bills.where("total < 0").withColumn("issue_id", F.col("bill"))
    found = relationship_evidence(bills, failing, "total", ["l_returnflag", "l_linestatus"], ["net", "fee"])
    return found.select(
        "issue_id", "status", "group_size", "relationship_type", "related_columns",
        text.rounded(F.col("candidate_value"), 4).alias("candidate_value"),
        text.rounded(F.col("fit_quality"), 5).alias("fit_quality"))


@registry.add("relationship_ratio", """
WITH priced AS (SELECT p_partkey, p_size, CASE WHEN p_retailprice > 998 THEN -1 ELSE 0.2 * p_retailprice END AS tax,
  p_retailprice AS price FROM part),
clean AS (SELECT *, tax / price AS x FROM priced),
whole AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM clean)
SELECT CAST(p_partkey AS VARCHAR) AS issue_id, n - 1 AS group_size,
  CASE WHEN 1 - sqrt(greatest(0, (q - x * x) / (n - 1) - pow((s - x) / (n - 1), 2))) / abs((s - x) / (n - 1)) >= 0.5
       THEN 'CANDIDATE' ELSE 'NO_RELATIONSHIP' END AS status,
  CASE WHEN 1 - sqrt(greatest(0, (q - x * x) / (n - 1) - pow((s - x) / (n - 1), 2))) / abs((s - x) / (n - 1)) >= 0.5
       THEN CAST(round(CAST(price * (s - x) / (n - 1) AS DECIMAL(38, 8)), 4) AS DOUBLE) END AS candidate_value
FROM clean, whole WHERE tax < 0""")
def relationship_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    priced = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(price > 998, F.lit(-1.0)).otherwise(0.2 * price).alias("tax"), price.alias("price"))
    failing = priced.where("tax < 0").withColumn("issue_id", F.col("p_partkey").cast("string"))
    found = relationship_evidence(priced, failing, "tax", [], ["price"], min_fit=0.5, margin=0.0)
    return found.select("issue_id", "group_size", "status",
                        text.rounded(F.col("candidate_value"), 4).alias("candidate_value"))


@registry.add("relationship_summaries", "WITH " + BILLS + """
SELECT bill AS issue_id, 'CANDIDATE' AS status, 'sum_consistency' AS relationship_type,
  CAST(count(*) OVER (PARTITION BY l_returnflag, l_linestatus) - 1 AS VARCHAR) AS group_size, failing
FROM (SELECT *, total < 0 AS failing FROM bills) QUALIFY failing""")
def relationship_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = _bills(spark, sf_dir)
    failing = bills.where("total < 0").withColumn("issue_id", F.col("bill"))
    found = relationship_evidence(bills, failing, "total", ["l_returnflag", "l_linestatus"], ["net", "fee"])
    shown = gate.evidence_summary(found)
    return shown.select("issue_id", *[F.get_json_object("summary", f"$.{k}").alias(k) for k in (
        "status", "relationship_type", "group_size")], F.get_json_object("summary", "$.available").cast("boolean").alias("failing"))


# --- sequences -----------------------------------------------------------------

IDENTIFIERS = """
identifiers AS (
  SELECT 'supplier_gap' AS column_name, s_name AS value FROM supplier WHERE s_suppkey <> 7
  UNION ALL SELECT 'nation_twice', CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'nation_twice', '4' FROM nation WHERE n_nationkey = 4
  UNION ALL SELECT 'region_whole', CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT 'part_words', p_name FROM part
  UNION ALL SELECT 'line_numbers', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'order_keys', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey <> 11
  UNION ALL SELECT 'customer_names', c_name FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 'part_codes', 'P-' || CAST(100 + p_size AS VARCHAR) FROM part WHERE p_size <> 20)"""


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def named(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("column_name"), value.alias("value"))

    nation = F.col("n_nationkey").cast("string")
    parts = [
        named(t("supplier").where("s_suppkey <> 7"), "supplier_gap", F.col("s_name")),
        named(t("nation"), "nation_twice", nation),
        named(t("nation").where("n_nationkey = 4"), "nation_twice", nation),
        named(t("region"), "region_whole", F.col("r_regionkey").cast("string")),
        named(t("part"), "part_words", F.col("p_name")),
        named(t("lineitem"), "line_numbers", F.col("l_linenumber").cast("string")),
        named(t("orders").where("o_orderkey <> 11"), "order_keys", F.col("o_orderkey").cast("string")),
        named(t("customer").where("c_acctbal > 0"), "customer_names", F.col("c_name")),
        named(t("part").where("p_size <> 20"), "part_codes",
              F.concat(F.lit("P-"), (F.col("p_size") + 100).cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registry.add("sequence_evidence", "WITH " + IDENTIFIERS + r""",
parsed AS (SELECT column_name, regexp_extract(value, '^([^0-9-]*)(-?[0-9]+)([^0-9-]*)$', 1) AS prefix,
  TRY_CAST(nullif(regexp_extract(value, '^([^0-9-]*)(-?[0-9]+)([^0-9-]*)$', 2), '') AS BIGINT) AS num,
  length(replace(regexp_extract(value, '^([^0-9-]*)(-?[0-9]+)([^0-9-]*)$', 2), '-', '')) AS width FROM identifiers),
observed AS (SELECT column_name, count(*) AS observed FROM parsed GROUP BY 1),
schemes AS (SELECT column_name, prefix, count(*) AS members, count(DISTINCT num) AS d, min(num) AS lo, max(num) AS hi,
  min(width) AS w0, max(width) AS w1 FROM parsed WHERE num IS NOT NULL GROUP BY 1, 2),
dominant AS (SELECT s.*, observed FROM schemes s JOIN observed USING (column_name) WHERE members >= 0.9 * observed),
distinct_values AS (SELECT DISTINCT p.column_name, num FROM parsed p JOIN dominant d
  ON p.column_name = d.column_name AND p.prefix = d.prefix WHERE num IS NOT NULL),
diffs AS (SELECT column_name, num, num - lag(num) OVER (PARTITION BY column_name ORDER BY num) AS diff
  FROM distinct_values),
modal AS (SELECT column_name, diff AS step, c, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, seen) AS r,
  sum(c) OVER (PARTITION BY column_name) AS transitions
  FROM (SELECT column_name, diff, count(*) AS c, min(num) AS seen FROM diffs WHERE diff IS NOT NULL GROUP BY 1, 2)),
facts AS (SELECT d.*, step, c AS supporting, transitions FROM dominant d JOIN modal m
  ON d.column_name = m.column_name AND r = 1),
slots AS (SELECT f.column_name, any_value((hi - lo + step - 1) // step + 1) AS slots, count(*) AS present,
  sum((num - lo) // step) AS placed FROM facts f JOIN distinct_values v ON v.column_name = f.column_name
  AND (v.num - f.lo) % f.step = 0 GROUP BY 1),
gaps AS (SELECT s.column_name, slots - present AS gap_count, CASE WHEN slots - present = 1 THEN CAST(
    lo + step * (CAST(slots AS HUGEINT) * (slots - 1) // 2 - placed) AS BIGINT) ELSE lo END AS gap
  FROM slots s JOIN facts f ON f.column_name = s.column_name WHERE slots > present),
judged AS (SELECT o.column_name, o.observed, f.*, coalesce(gap_count, 0) AS gaps, gap, members - d AS dups,
  CASE WHEN o.observed < 5 THEN 'INSUFFICIENT_GROUP' WHEN f.column_name IS NULL THEN 'NO_RELATIONSHIP'
    WHEN supporting < 0.5 * transitions THEN 'NO_RELATIONSHIP'
    WHEN gap IS NULL AND members = d THEN 'NO_RELATIONSHIP'
    WHEN coalesce(gap_count, 0) > 1 OR members - d > 1 OR supporting < 3 THEN 'AMBIGUOUS' ELSE 'CANDIDATE' END AS status
  FROM observed o LEFT JOIN facts f ON f.column_name = o.column_name LEFT JOIN gaps g ON g.column_name = o.column_name),
found AS (SELECT *, CASE WHEN gaps = 1 THEN gap ELSE hi + step END AS num FROM judged)
SELECT column_name, status, observed AS observed_values_count,
  CASE WHEN status = 'CANDIDATE' THEN CASE WHEN gaps = 1 THEN 'SEQUENCE_GAP' ELSE 'SEQUENCE_NEXT_VALUE' END END AS strategy,
  CASE WHEN status = 'CANDIDATE' THEN prefix || CASE WHEN num < 0 THEN '-' ELSE '' END ||
    CASE WHEN w0 = w1 THEN lpad(CAST(abs(num) AS VARCHAR), CAST(greatest(w0, length(CAST(abs(num) AS VARCHAR))) AS INTEGER), '0')
         ELSE CAST(abs(num) AS VARCHAR) END END AS candidate_value,
  CASE WHEN status = 'CANDIDATE' THEN supporting END AS supporting_count,
  CASE WHEN status = 'CANDIDATE' THEN CAST(round(CAST(
    CAST(supporting AS DOUBLE) / transitions * least(1.0, d / 10.0) AS DECIMAL(38, 10)), 6) AS DOUBLE) END AS confidence
FROM found""")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_evidence(_identifiers(spark, sf_dir)).select(
        "column_name", "status", "observed_values_count", "strategy", "candidate_value", "supporting_count",
        text.rounded(F.col("confidence"), 6).alias("confidence"))


# --- dates and times -----------------------------------------------------------

MOMENTS = """
moments AS (
  SELECT DISTINCT 'days' AS column_name, CAST(o_orderdate AS DATE) AS moment FROM orders
    WHERE o_orderdate <> TIMESTAMP '1996-05-05'
  UNION ALL SELECT DISTINCT 'months', CAST(date_trunc('month', o_orderdate) AS DATE) + 14 FROM orders
    WHERE date_trunc('month', o_orderdate) <> TIMESTAMP '1997-04-01'
  UNION ALL SELECT DISTINCT 'month_ends', last_day(CAST(l_shipdate AS DATE)) FROM lineitem
    WHERE date_trunc('month', l_shipdate) <> TIMESTAMP '1997-02-01'
  UNION ALL SELECT DISTINCT 'years', CAST(date_trunc('year', o_orderdate) AS DATE) FROM orders
    WHERE year(o_orderdate) <> 1997
  UNION ALL SELECT 'order_days', CAST(o_orderdate AS DATE) FROM orders
  UNION ALL SELECT DISTINCT 'weeks', CAST(date_trunc('week', ts) AS DATE) FROM events)"""


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    events = table(spark, sf_dir, "events")
    day = F.col("o_orderdate").cast("date")
    month = F.trunc(day, "month")
    ship = F.col("l_shipdate").cast("date")

    def named(df: DataFrame, name: str, value: Column, distinct: bool = True) -> DataFrame:
        out = df.select(F.lit(name).alias("column_name"), value.cast("string").alias("value"))
        return out.distinct() if distinct else out

    parts = [
        named(orders.where(day != F.lit("1996-05-05").cast("date")), "days", day),
        named(orders.where(month != F.lit("1997-04-01").cast("date")), "months", F.date_add(month, 14)),
        named(lines.where(F.trunc(ship, "month") != F.lit("1997-02-01").cast("date")), "month_ends", F.last_day(ship)),
        named(orders.where(F.year(day) != 1997), "years", F.trunc(day, "year")),
        named(orders, "order_days", day, distinct=False),
        named(events, "weeks", F.trunc(F.col("ts").cast("date"), "week")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registry.add("temporal_evidence", "WITH " + MOMENTS + """,
kinds AS (
  SELECT column_name, 1 AS kind, CAST(moment - DATE '1970-01-01' AS BIGINT) AS idx FROM moments
  UNION ALL SELECT column_name, 2, year(moment) FROM moments
    WHERE column_name IN (SELECT column_name FROM moments GROUP BY 1 HAVING min(month(moment) * 100 + day(moment)) =
                          max(month(moment) * 100 + day(moment)))
  UNION ALL SELECT column_name, 3, year(moment) * 12 + month(moment) - 1 FROM moments
    WHERE column_name IN (SELECT column_name FROM moments GROUP BY 1
                          HAVING min(day(moment)) = max(day(moment)) OR bool_and(moment = last_day(moment)))),
totals AS (SELECT column_name, count(*) AS observed, count(DISTINCT moment) AS d, min(day(moment)) AS day,
  bool_and(moment = last_day(moment)) AS month_end FROM moments GROUP BY 1),
vals AS (SELECT DISTINCT column_name, kind, idx FROM kinds),
diffs AS (SELECT *, idx - lag(idx) OVER (PARTITION BY column_name, kind ORDER BY idx) AS diff FROM vals),
modal AS (SELECT column_name, kind, diff AS step, c, row_number() OVER (PARTITION BY column_name, kind
    ORDER BY c DESC, first_at) AS r, sum(c) OVER (PARTITION BY column_name, kind) AS transitions
  FROM (SELECT column_name, kind, diff, count(*) AS c, min(idx) AS first_at FROM diffs WHERE diff IS NOT NULL
        GROUP BY 1, 2, 3)),
facts AS (SELECT v.column_name, v.kind, min(idx) AS lo, max(idx) AS hi, any_value(step) AS step, any_value(c) AS c,
  any_value(transitions) AS transitions FROM vals v JOIN modal m ON v.column_name = m.column_name AND v.kind = m.kind
  AND r = 1 GROUP BY 1, 2),
slots AS (SELECT f.column_name, f.kind, any_value(CASE WHEN f.kind = 1 THEN (hi - lo) // step ELSE (hi - lo + step - 1) // step END
    + 1) AS slots, count(*) AS present, sum((idx - lo) // step) AS placed FROM facts f JOIN vals v ON v.column_name = f.column_name
  AND v.kind = f.kind AND (v.idx - f.lo) % f.step = 0 GROUP BY 1, 2),
gaps AS (SELECT s.column_name, s.kind, slots - present AS gap_count, CASE WHEN slots - present = 1 THEN CAST(
    lo + step * (CAST(slots AS HUGEINT) * (slots - 1) // 2 - placed) AS BIGINT) ELSE lo END AS gap
  FROM slots s JOIN facts f ON f.column_name = s.column_name AND f.kind = s.kind WHERE slots > present),
judged AS (SELECT f.*, t.observed, t.d, day, month_end, coalesce(gap_count, 0) AS gaps, gap,
  CASE WHEN f.kind = 1 THEN c ELSE t.d END AS support,
  CASE WHEN f.kind = 1 AND c < 0.5 * transitions THEN 'NO_RELATIONSHIP'
    WHEN coalesce(gap_count, 0) = 0 AND t.observed = t.d THEN 'NO_RELATIONSHIP'
    WHEN coalesce(gap_count, 0) > 1 OR t.observed - t.d > 1 THEN 'AMBIGUOUS'
    WHEN CASE WHEN f.kind = 1 THEN c ELSE t.d END < 3 THEN 'AMBIGUOUS' ELSE 'CANDIDATE' END AS verdict
  FROM facts f JOIN totals t USING (column_name) LEFT JOIN gaps g ON g.column_name = f.column_name AND g.kind = f.kind),
valued AS (SELECT *, CASE WHEN gaps = 1 THEN gap ELSE hi + step END AS pick FROM judged),
dated AS (SELECT *, CASE kind WHEN 1 THEN DATE '1970-01-01' + CAST(pick AS INTEGER) WHEN 2 THEN make_date(pick, 1, day)
  ELSE CASE WHEN month_end THEN last_day(make_date(pick // 12, pick % 12 + 1, 1))
            ELSE make_date(pick // 12, pick % 12 + 1, day) END END AS value FROM valued),
best AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY kind) AS r FROM dated WHERE verdict = 'CANDIDATE')
SELECT t.column_name, CASE WHEN t.observed < 5 THEN 'INSUFFICIENT_GROUP' WHEN b.kind IS NOT NULL THEN 'CANDIDATE'
    ELSE coalesce(f.verdict, 'NO_RELATIONSHIP') END AS status,
  t.observed AS observed_values_count, CASE WHEN t.observed >= 5 THEN CAST(b.value AS VARCHAR) END AS candidate_value,
  CASE WHEN t.observed >= 5 THEN CASE b.kind WHEN 1 THEN 'FIXED_INTERVAL' WHEN 2 THEN 'CALENDAR_YEAR_INTERVAL'
    WHEN 3 THEN 'CALENDAR_MONTH_INTERVAL' END END AS progression_type,
  CASE WHEN t.observed >= 5 THEN CASE WHEN b.gaps = 1 THEN 'TEMPORAL_GAP' WHEN b.kind IS NOT NULL
    THEN 'TEMPORAL_NEXT_VALUE' END END AS strategy,
  CASE WHEN t.observed >= 5 THEN b.support END AS supporting_count
FROM totals t LEFT JOIN best b ON b.column_name = t.column_name AND b.r = 1
LEFT JOIN judged f ON f.column_name = t.column_name AND f.kind = 1""")
def temporals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_evidence(_moments(spark, sf_dir)).select(
        "column_name", "status", "observed_values_count", "candidate_value", "progression_type", "strategy",
        "supporting_count")


_STAMPS = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS VARCHAR)[1:10] AS t FROM orders"""


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written as times: with one offset, with several, with and without one, and not in ISO form."""
    day, odd = F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.col("o_orderkey") % 2 == 1
    forms = {
        "one_offset": F.concat(day, F.lit("T10:30:15.25+05:30")),
        "two_offsets": F.concat(day, F.when(odd, "T10:30:15Z").otherwise("T16:00:15+05:30")),
        "same_offset": F.concat(day, F.when(odd, "T10:30:15Z").otherwise("T10:30:15-00:00")),
        "with_and_without": F.concat(day, F.when(odd, "T10:30:15Z").otherwise("T10:30:15")),
        "slashes": F.date_format(day.cast("date"), "dd/MM/yyyy")}
    return table(spark, sf_dir, "orders").select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), v.alias("value")) for n, v in forms.items()])))


@registry.add("parsed_instants", f"""
WITH days AS ({_STAMPS}),
rows AS (SELECT 'one_offset' AS column_name, t || 'T10:30:15.25+05:30' AS value, d, '+05:30' AS zone, 37815250000 AS tod FROM days
  UNION ALL SELECT 'two_offsets', t || CASE WHEN o_orderkey % 2 = 1 THEN 'T10:30:15Z' ELSE 'T16:00:15+05:30' END, d,
    CASE WHEN o_orderkey % 2 = 1 THEN '+00:00' ELSE '+05:30' END, CASE WHEN o_orderkey % 2 = 1 THEN 37815000000 ELSE 57615000000 END FROM days
  UNION ALL SELECT 'same_offset', t || CASE WHEN o_orderkey % 2 = 1 THEN 'T10:30:15Z' ELSE 'T10:30:15-00:00' END, d, '+00:00', 37815000000 FROM days
  UNION ALL SELECT 'with_and_without', t || CASE WHEN o_orderkey % 2 = 1 THEN 'T10:30:15Z' ELSE 'T10:30:15' END, d,
    CASE WHEN o_orderkey % 2 = 1 THEN '+00:00' ELSE '' END, 37815000000 FROM days
  UNION ALL SELECT 'slashes', strftime(d, '%d/%m/%Y'), NULL, NULL, NULL FROM days)
SELECT column_name, value, CASE WHEN d IS NOT NULL THEN false END AS is_date, zone,
  CAST(date_diff('day', DATE '1970-01-01', d) * 86400000000 + tod AS BIGINT) AS micros, count(*) AS times
FROM rows GROUP BY ALL""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _stamps(spark, sf_dir).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("times"))
    return parse_instants(counted.withColumn("text", F.col("value"))).select(
        "column_name", F.col("text").alias("value"), "is_date", "zone", "micros", "times")


@registry.add("offset_evidence", """
SELECT column_name, CASE column_name WHEN 'slashes' THEN 'INSUFFICIENT_GROUP' ELSE 'AMBIGUOUS' END AS status,
  CAST(0 AS BIGINT) AS observed_values_count, CAST(NULL AS VARCHAR) AS candidate_value
FROM (SELECT unnest(['two_offsets', 'with_and_without', 'slashes']) AS column_name) n
WHERE (SELECT count(DISTINCT o_orderkey % 2) FROM orders) = 2""")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that mix offsets are ambiguous and show no values; text that is not in ISO form counts for nothing."""
    mixed = _stamps(spark, sf_dir).where(F.col("column_name").isin("two_offsets", "with_and_without", "slashes"))
    return temporal_evidence(mixed).select("column_name", "status", "observed_values_count", "candidate_value")


# --- templates -----------------------------------------------------------------


@registry.add("template_evidence", """
WITH reached AS (SELECT c_custkey, c_name, c_mktsegment, count(*) FILTER (c_acctbal >= 0) OVER () AS pairs, c_acctbal
  FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS issue_id, source_column,
  CASE WHEN pairs < 3 THEN 'INSUFFICIENT_GROUP' WHEN source_column = 'c_name' THEN 'CANDIDATE'
       ELSE 'NO_RELATIONSHIP' END AS status,
  CASE WHEN pairs >= 3 AND source_column = 'c_name' THEN 'mail-' || lower(replace(c_name, '#', '.')) || '@example.org'
       END AS candidate_value,
  CASE WHEN pairs >= 3 AND source_column = 'c_name' THEN pairs END AS supporting_count
FROM reached, (SELECT unnest(['c_name', 'c_mktsegment']) AS source_column) WHERE c_acctbal < 0""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.concat(F.lit("mail-"), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.org"))
    reached = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, reach).alias("email"))
    failing = reached.where(F.col("email").isNull()).withColumn("issue_id", F.col("c_custkey").cast("string"))
    return template_evidence(reached, failing, "email", ["c_name", "c_mktsegment"]).select(
        "issue_id", "source_column", "status", "candidate_value", "supporting_count")


# --- ranking, availability, peers --------------------------------------------------

CANDIDATES = """
candidates AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS issue_id, CAST(l_linenumber AS VARCHAR) || CASE WHEN l_tax > 0.04 THEN '.0'
    ELSE '' END AS value, 'S' || l_returnflag AS strategy, 0.5 + l_discount AS confidence, l_suppkey AS supporting_count
  FROM lineitem)"""


@registry.add("ranked_candidates", "WITH " + CANDIDATES + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY confidence DESC, strategy, value,
  supporting_count) AS r FROM candidates),
top AS (SELECT * FROM placed WHERE r = 1),
rivals AS (SELECT c.issue_id, count(*) AS n, count(*) FILTER (t.confidence - c.confidence <= 0.03 + 1e-12
  AND CAST(c.value AS DOUBLE) <> CAST(t.value AS DOUBLE)) AS close FROM candidates c JOIN top t USING (issue_id)
  GROUP BY 1)
SELECT issue_id, n AS candidates, close > 0 AS ambiguous, CASE WHEN close = 0 THEN value END AS recommended_value,
  CASE WHEN close = 0 THEN strategy END AS recommended_strategy,
  CASE WHEN close = 0 THEN round(confidence, 4) END AS confidence
FROM top JOIN rivals USING (issue_id)""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_tax") > 0.04, ".0").otherwise(""))
    candidates = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("issue_id"), value.alias("value"),
        F.concat(F.lit("S"), "l_returnflag").alias("strategy"), (F.col("l_discount") + 0.5).alias("confidence"),
        F.col("l_suppkey").alias("supporting_count"), F.lit(0).cast("bigint").alias("contradicting_count"))
    return rank.rank_candidates(candidates).select(
        "issue_id", F.col("candidates").cast("bigint").alias("candidates"), "ambiguous", "recommended_value",
        "recommended_strategy", "confidence")


@registry.add("evidence_availability", """
WITH asked AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
  WHEN o_orderpriority = '2-HIGH' THEN o_custkey || chr(31) || '-1' WHEN o_orderpriority = '3-MEDIUM'
  THEN o_custkey || chr(31) || chr(0) || 'NULL' || chr(0) WHEN o_orderpriority = '5-LOW' THEN CAST(o_custkey AS VARCHAR)
  ELSE o_custkey || chr(31) || o_orderkey % 7 END AS ref, o_orderstatus = 'P' AS changed FROM orders),
keyed AS (SELECT o_custkey || chr(31) || o_orderkey % 7 AS ref, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, coalesce(n, 0) AS matches,
  CASE WHEN changed THEN 'KEY_CHANGED' WHEN a.ref IS NULL OR NOT contains(a.ref, chr(31)) THEN 'MALFORMED_RECORD_REF'
    WHEN contains(a.ref, 'NULL') THEN 'NULL_KEY_PART' WHEN n IS NULL THEN 'RECORD_NOT_FOUND'
    WHEN n > 1 THEN 'KEY_NOT_UNIQUE' ELSE 'AVAILABLE' END AS availability
FROM asked a LEFT JOIN keyed k ON k.ref = a.ref""")
def evidence_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer, sep = F.col("o_custkey").cast("string"), F.lit(text.UNIT_SEPARATOR)
    slot, priority = F.col("o_orderkey") % 7, F.col("o_orderpriority")
    ref = (F.when(priority == "1-URGENT", F.lit(None)).when(priority == "2-HIGH", F.concat(customer, sep, F.lit("-1")))
           .when(priority == "3-MEDIUM", F.concat(customer, sep, F.lit(text.NULL_SENTINEL)))
           .when(priority == "5-LOW", customer).otherwise(F.concat(customer, sep, slot.cast("string"))))
    asked = orders.select(F.col("o_orderkey").cast("string").alias("issue_id"), ref.alias("record_ref"),
                          (F.col("o_orderstatus") == "P").alias("key_changed"))
    key = KeySpec(("o_custkey", "slot"))
    located = rank.locate_issues(orders.select("o_custkey", slot.alias("slot"), "o_totalprice"), key, asked)
    return located.select("issue_id", "matches", rank.availability(
        key, F.col("key_changed"), F.col("record_ref"), F.col("matches")).alias("availability"))


@registry.add("stale_key_issues", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS issue_id, coalesce(last_changed > o_orderdate, false)
  AS key_changed FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN
  (SELECT o_custkey AS dataset, max(o_orderdate) AS last_changed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  ON dataset = o_custkey""")
def stale_key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    issues = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("issue_id"), F.col("l_orderkey").alias("run_id"))
    changes = orders.where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("changed_at"))
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"),
                         F.col("o_orderdate").alias("created_at"))
    return rank.stale_keys(issues, changes, runs).select("issue_id", "key_changed")


@registry.add("duplicate_peers", "WITH " + FAILURES + """,
repeated AS (SELECT DISTINCT run_id, assignment_id, record_ref, row_index, failed_value FROM failures
  WHERE rule_type = 'UNIQUENESS'),
shared AS (SELECT a.run_id, a.assignment_id, a.record_ref, a.failed_value, b.record_ref AS peer,
  row_number() OVER (PARTITION BY a.run_id, a.assignment_id, a.failed_value, a.record_ref
                     ORDER BY b.row_index, b.record_ref) AS r
  FROM repeated a JOIN repeated b ON a.assignment_id = b.assignment_id AND a.failed_value = b.failed_value
  AND a.run_id = b.run_id AND a.record_ref <> b.record_ref)
SELECT run_id, assignment_id, record_ref, failed_value,
  coalesce(string_agg(peer, ',' ORDER BY r) FILTER (r <= 5), '') AS peers, count(peer) AS peer_count
FROM repeated LEFT JOIN shared USING (run_id, assignment_id, record_ref, failed_value) GROUP BY 1, 2, 3, 4""")
def duplicate_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = failures(spark, sf_dir).where("rule_type = 'UNIQUENESS'").dropDuplicates(
        ["run_id", "assignment_id", "record_ref", "failed_value"])
    return rank.duplicate_peers(unique, 5).select(
        "run_id", "assignment_id", "record_ref", "failed_value", F.array_join("peers", ",").alias("peers"), "peer_count")


# --- external suggestions ------------------------------------------------------------

ANSWERS = """
answers AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AI_HIGH_CONFIDENCE' WHEN '2-HIGH' THEN 'NEEDS_REVIEW'
    WHEN '3-MEDIUM' THEN 'CANNOT_INFER' WHEN '4-NOT SPECIFIED' THEN 'AI_HIGH_CONFIDENCE' ELSE 'WILD_GUESS' END AS said
  FROM orders),
parsed AS (SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, o_totalprice, o_orderkey,
  CASE WHEN said = 'WILD_GUESS' OR o_orderstatus = 'F' THEN 'NEEDS_REVIEW'
       WHEN said = 'AI_HIGH_CONFIDENCE' AND o_orderpriority LIKE '4%' THEN 'NEEDS_REVIEW' ELSE said END AS category,
  CASE WHEN said = 'AI_HIGH_CONFIDENCE' AND o_orderstatus <> 'F' AND o_orderpriority LIKE '1%'
       THEN CAST(o_totalprice AS VARCHAR) END AS suggested_value,
  CASE WHEN said = 'AI_HIGH_CONFIDENCE' AND o_orderstatus <> 'F' AND o_orderpriority LIKE '1%' THEN 0.9 END AS confidence
  FROM answers)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    said = (F.when(priority == "1-URGENT", gate.HIGH).when(priority == "2-HIGH", gate.REVIEW)
            .when(priority == "3-MEDIUM", gate.CANNOT).when(priority == "4-NOT SPECIFIED", gate.HIGH)
            .otherwise("WILD_GUESS"))
    value = F.when(priority == "4-NOT SPECIFIED", F.lit("null")).otherwise(
        F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"')))
    body = F.concat(F.lit('{"category": "'), said, F.lit('", "suggested_value": '), value,
                    F.lit(', "confidence": 0.9, "reasoning": "because"}'))
    answer = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("I think: "), body)).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    responses = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("issue_id"), answer.alias("text"))
    return gate.parse_suggestions(responses)


@registry.add("parsed_suggestions", "WITH " + ANSWERS + """
SELECT issue_id, category, suggested_value, CAST(confidence AS DOUBLE) AS confidence FROM parsed""")
def parsed_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("issue_id", "category", "suggested_value", "confidence")


@registry.add("gated_by_relationship", "WITH " + ANSWERS + """,
evidence AS (SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, CASE WHEN o_custkey % 3 = 0 THEN 'AMBIGUOUS' ELSE 'CANDIDATE'
  END AS status, CASE WHEN o_custkey % 3 = 1 THEN o_totalprice ELSE o_totalprice * 2 END AS value FROM orders
  WHERE o_totalprice < 400000),
judged AS (SELECT p.*, e.status, e.value, category = 'AI_HIGH_CONFIDENCE' AND e.status IS NOT NULL AS claimed,
  coalesce(e.status = 'CANDIDATE' AND abs(CAST(suggested_value AS DOUBLE) - value) <= greatest(0.001 *
    greatest(abs(CAST(suggested_value AS DOUBLE)), abs(value)), 1e-6), false) AS backed
  FROM parsed p LEFT JOIN evidence e USING (issue_id))
SELECT issue_id, CASE WHEN claimed AND NOT backed THEN 'NEEDS_REVIEW' ELSE category END AS category,
  CASE WHEN claimed AND NOT backed THEN NULL WHEN claimed THEN CASE WHEN value = floor(value)
    THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END ELSE suggested_value END AS suggested_value,
  CAST(CASE WHEN claimed AND NOT backed THEN NULL WHEN claimed THEN 0.75 ELSE confidence END AS DOUBLE) AS confidence
FROM judged""")
def gated_by_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, price = F.col("o_custkey"), F.col("o_totalprice")
    evidence = table(spark, sf_dir, "orders").where(price < 400000).select(
        F.col("o_orderkey").cast("string").alias("issue_id"),
        F.when(customer % 3 == 0, "AMBIGUOUS").otherwise("CANDIDATE").alias("status"),
        F.when(customer % 3 == 1, price).otherwise(price * 2).alias("candidate_value"), F.lit(0.75).alias("confidence"))
    return gate.gate_single(_parsed(spark, sf_dir), evidence).select(
        "issue_id", "category", "suggested_value", "confidence")


@registry.add("gated_by_ranking", "WITH " + ANSWERS + """,
ranked AS (SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, CASE WHEN o_custkey % 3 = 1 THEN CAST(o_totalprice AS VARCHAR)
  WHEN o_custkey % 3 = 2 THEN 'other' END AS value FROM orders WHERE o_totalprice < 400000),
judged AS (SELECT p.*, r.issue_id IS NOT NULL AS known, r.value, coalesce(suggested_value = r.value, false) AS same
  FROM parsed p LEFT JOIN ranked r USING (issue_id)),
settled AS (SELECT *, CASE WHEN known AND value IS NULL AND category = 'AI_HIGH_CONFIDENCE' THEN 'NEEDS_REVIEW'
  WHEN value IS NOT NULL AND category = 'AI_HIGH_CONFIDENCE' AND NOT same THEN 'NEEDS_REVIEW'
  WHEN value IS NOT NULL AND category = 'CANNOT_INFER' THEN 'NEEDS_REVIEW' ELSE category END AS final FROM judged)
SELECT issue_id, final AS category, CASE WHEN known THEN value ELSE suggested_value END AS suggested_value,
  CAST(CASE WHEN value IS NOT NULL AND final = 'AI_HIGH_CONFIDENCE' THEN 0.75 WHEN known THEN NULL ELSE confidence END
    AS DOUBLE) AS confidence FROM settled""")
def gated_by_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, price = F.col("o_custkey"), F.col("o_totalprice")
    ranked = table(spark, sf_dir, "orders").where(price < 400000).select(
        F.col("o_orderkey").cast("string").alias("issue_id"),
        F.when(customer % 3 == 1, price.cast("string")).when(customer % 3 == 2, "other").alias("recommended_value"),
        F.lit(0.75).alias("confidence"), F.lit("none").alias("no_candidate_reason"))
    return gate.gate_ranked(_parsed(spark, sf_dir), ranked).select(
        "issue_id", "category", "suggested_value", "confidence")
