"""Issues, suggestions, decisions and approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.operators import decide, generate
from plumbrule.operators.profile import profile
from plumbrule.operators.validate import validate
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import (
    CORRECTIONS, FAILURES, FAULTY_ORDERS, ISSUES, RUNS, corrections, failures, faulty_orders, issues, runs, table,
)
from plumbrule.plans.registered.validation import FAILED, ORDER_KEY, ORDER_RULES
from plumbrule.plans.review import assignment_table, gather_evidence, open_review

registry = Registry()


def _created() -> object:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


# --- issues and suggestions --------------------------------------------------------


@registry.add("created_issues", "WITH " + FAILURES + "," + RUNS + """
SELECT f.run_id AS review_run_id, record_ref, assignment_id, column_name, failed_value AS original_value, severity,
       'PENDING' AS status
FROM failures f JOIN runs r ON r.run_id = f.run_id WHERE r.status = 'COMPLETED'
  AND f.run_id = (SELECT run_id FROM (SELECT l_orderkey, count(*) AS n, CAST(l_orderkey AS VARCHAR) AS run_id FROM lineitem
      JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O' GROUP BY 1) ORDER BY n DESC, l_orderkey LIMIT 1)""")
def created_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_failures, all_runs = failures(spark, sf_dir), runs(spark, sf_dir)
    # The completed run with the most failures.
    largest = all_failures.groupBy("run_id").count().join(
        all_runs.where("status = 'COMPLETED'"), "run_id").orderBy(
        F.desc("count"), F.col("run_id").cast("bigint")).first()["run_id"]
    made = generate.create_issues(all_failures, all_runs, largest, largest, _created())
    return made.select("review_run_id", "record_ref", "assignment_id", "column_name", "original_value", "severity",
                       "status")


def _suggested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = faulty_orders(spark, sf_dir)
    run = validate(orders, ORDER_RULES, ORDER_KEY, "run")
    stats = profile(orders, include_top_values=False)
    done = orders.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("run").alias("run_id"), F.lit("COMPLETED").alias("status"))
    made = generate.create_issues(run.failures(), done, "review", "run", _created())
    return made, assignment_table(orders, ORDER_RULES), stats


STATS = """
mode AS (SELECT o_orderpriority AS mode_value FROM faulty_orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1),
suggested AS (
  SELECT record_ref, 'mode_fill' AS fix_type, mode_value AS suggested_value,
    (SELECT round(least(0.9, greatest(0.1, 1 - ((20000 * count(DISTINCT o_orderpriority) + count(*)) // (2 * count(*)))
      / 100.0 / 100)), 3) FROM faulty_orders) AS confidence FROM failed, mode WHERE assignment_id = 'complete'
  UNION ALL SELECT record_ref, 'range_clamp', CASE WHEN CAST(failed_value AS DOUBLE) < 0 THEN '0' ELSE '450000' END, 0.85
    FROM failed WHERE assignment_id = 'range'
  UNION ALL SELECT record_ref, 'trim_whitespace', trim(failed_value), 0.95 FROM failed WHERE assignment_id = 'pattern'
    AND regexp_matches(trim(failed_value), '^[1-5]-[A-Z ]+$'))"""


@registry.add("suggestions", "WITH " + FAULTY_ORDERS + "," + FAILED + "," + STATS + """
SELECT record_ref, fix_type, suggested_value, CAST(confidence AS DOUBLE) AS confidence FROM suggested""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.suggest(*_suggested(spark, sf_dir)).select("record_ref", "fix_type", "suggested_value", "confidence")


@registry.add("suggestion_counts", "WITH " + FAULTY_ORDERS + "," + FAILED + "," + STATS + """
SELECT (SELECT count(*) FROM failed) AS issues, (SELECT count(*) FROM suggested) AS issues_with_suggestion,
  (SELECT count(*) FROM failed) - (SELECT count(*) FROM suggested) AS issues_without_suggestion,
  (SELECT count(*) FROM suggested) AS suggestions""")
def suggestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.suggestion_counts(*_suggested(spark, sf_dir))


@registry.add("median_suggestions", """
WITH holes AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer),
stats AS (SELECT CAST(round(CAST(quantile_cont(c_acctbal, 0.5) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS m,
  CAST(round(CAST(stddev_pop(c_acctbal) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS s FROM holes)
SELECT CAST(c_custkey AS VARCHAR) AS record_ref, 'median_fill' AS fix_type, CASE WHEN m = floor(m)
  THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END AS suggested_value,
  CAST(round(CAST(least(0.9, greatest(0.1, 1 - s / abs(m))) AS DECIMAL(38, 10)), 3) AS DOUBLE) AS confidence
FROM holes, stats WHERE c_acctbal IS NULL""")
def median_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbrule.spec import KeySpec, RuleSpec

    holes = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    rules = [RuleSpec("complete", "COMPLETENESS", ("c_acctbal",))]
    run = validate(holes, rules, KeySpec(("c_custkey",)), "run")
    done = holes.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("run").alias("run_id"), F.lit("COMPLETED").alias("status"))
    review = open_review(holes, run, profile(holes, include_top_values=False), done, "review", _created())
    return review.suggestions.select("record_ref", "fix_type", "suggested_value", "confidence")


@registry.add("issues_without_suggestion", "WITH " + FAULTY_ORDERS + "," + FAILED + "," + STATS + """
SELECT f.record_ref, assignment_id FROM failed f WHERE NOT EXISTS (SELECT 1 FROM suggested s
  WHERE s.record_ref = f.record_ref AND s.fix_type = CASE f.assignment_id WHEN 'complete' THEN 'mode_fill'
    WHEN 'range' THEN 'range_clamp' WHEN 'pattern' THEN 'trim_whitespace' END)""")
def issues_without_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, rules, stats = _suggested(spark, sf_dir)
    return generate.without_suggestion(made, generate.suggest(made, rules, stats)).select("record_ref", "assignment_id")


@registry.add("suggestions_of_review", "WITH " + ISSUES + "," + CORRECTIONS + """
SELECT i.issue_id, final_value AS suggested_value, original_value FROM issues i JOIN corrections c USING (issue_id)
WHERE review_run_id = (SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem)""")
def suggestions_of_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey")).first()[0]
    offered = corrections(spark, sf_dir).select("issue_id", F.col("final_value").alias("suggested_value"))
    return generate.suggestions_with_issues(offered, issues(spark, sf_dir), str(first)).select(
        "issue_id", "suggested_value", "original_value")


@registry.add("gathered_evidence", """
SELECT CAST(c_custkey AS VARCHAR) AS record_ref, 'customer.' || replace(c_name, '#', '') AS recommended_value,
  'STRING_TEMPLATE' AS recommended_strategy FROM customer WHERE c_acctbal < 0""")
def gathered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbrule.spec import KeySpec, RuleSpec

    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    plain = table(spark, sf_dir, "customer").select(
        "c_custkey", name.alias("c_name"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("customer."), name)).alias("code"))
    key = KeySpec(("c_custkey",))
    run = validate(plain, [RuleSpec("complete", "COMPLETENESS", ("code",))], key, "run")
    stats = profile(plain, include_top_values=False)
    done = plain.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("run").alias("run_id"), F.lit("COMPLETED").alias("status"))
    review = open_review(plain, run, stats, done, "review", _created())
    ranked = gather_evidence(plain, key, review.issues, stats)
    return ranked.join(review.issues.select("issue_id", "record_ref"), "issue_id").select(
        "record_ref", "recommended_value", "recommended_strategy")


# --- decisions ---------------------------------------------------------------------

DECISIONS = """
decisions AS (SELECT CAST(event_id AS VARCHAR) AS event_id, user_id || '-' || props AS issue_id,
  CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'EDIT' WHEN 'purchase' THEN 'CORRECT'
    WHEN 'signup' THEN 'SKIP' ELSE 'REJECT' END AS action,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN 'S' || event_id END AS suggestion_id,
  CASE WHEN value < 20 THEN '  ' ELSE CAST(value AS VARCHAR) END AS value, CAST(user_id AS VARCHAR) AS decided_by,
  ts AS decided_at FROM events),
offers AS (SELECT 'S' || event_id AS suggestion_id, CASE WHEN value < 5 THEN '' ELSE 'v' || value END AS suggested_value,
  CASE WHEN value < 60 THEN 'RULE_BASED' ELSE 'AI' END AS source FROM events),
valued AS (SELECT d.*, source, CASE action WHEN 'ACCEPT' THEN suggested_value WHEN 'EDIT' THEN value WHEN 'CORRECT'
  THEN value END AS given FROM decisions d LEFT JOIN offers o USING (suggestion_id)),
ends AS (SELECT issue_id, min((decided_at, event_id)) AS ended FROM decisions WHERE action IN ('REJECT', 'SKIP')
  GROUP BY 1),
judged AS (SELECT v.*, CASE WHEN (decided_at, v.event_id) > ended THEN 'already rejected or skipped'
  WHEN action NOT IN ('REJECT', 'SKIP') AND trim(coalesce(given, '')) = '' THEN 'blank value' END AS refused_reason
  FROM valued v LEFT JOIN ends e ON e.issue_id = v.issue_id),
folded AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY decided_at DESC, event_id DESC) AS r
  FROM judged WHERE refused_reason IS NULL),
picked AS (SELECT issue_id, arg_max(suggestion_id, (decided_at, event_id)) AS selected_suggestion_id FROM judged
  WHERE refused_reason IS NULL AND action IN ('ACCEPT', 'EDIT') GROUP BY 1)"""


def decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    log = events.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat_ws("-", "user_id", "props").alias("issue_id"),
        F.when(kind == "click", "ACCEPT").when(kind == "view", "EDIT").when(kind == "purchase", "CORRECT")
        .when(kind == "signup", "SKIP").otherwise("REJECT").alias("action"),
        F.when(kind.isin("click", "view", "error"), F.concat(F.lit("S"), F.col("event_id").cast("string")))
        .alias("suggestion_id"),
        F.when(value < 20, "  ").otherwise(value.cast("string")).alias("value"),
        F.col("user_id").cast("string").alias("decided_by"), F.col("ts").alias("decided_at"))
    offers = events.select(
        F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("suggestion_id"),
        F.when(value < 5, "").otherwise(F.concat(F.lit("v"), value.cast("string"))).alias("suggested_value"),
        F.when(value < 60, "RULE_BASED").otherwise("AI").alias("source"))
    return log, offers


@registry.add("folded_decisions", "WITH " + DECISIONS + """
SELECT f.issue_id, given AS final_value, CASE action WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'EDIT' THEN 'EDITED'
    WHEN 'CORRECT' THEN 'EDITED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'SKIPPED' END AS status,
  CASE WHEN action IN ('EDIT', 'CORRECT') THEN 'HUMAN' WHEN action IN ('ACCEPT', 'REJECT') THEN source END AS value_source,
  CASE WHEN action = 'SKIP' THEN 'SKIPPED' ELSE 'RESOLVED' END AS issue_status, suggestion_id, decided_by,
  CAST(decided_at AS VARCHAR) AS decided_at, selected_suggestion_id
FROM folded f LEFT JOIN picked p ON p.issue_id = f.issue_id WHERE r = 1""")
def folded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.fold_decisions(*decisions(spark, sf_dir)).withColumn("decided_at", F.col("decided_at").cast("string"))


@registry.add("refused_decisions", "WITH " + DECISIONS + """
SELECT event_id, issue_id, refused_reason FROM judged WHERE refused_reason IS NOT NULL""")
def refused_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.refused_events(*decisions(spark, sf_dir)).select("event_id", "issue_id", "refused_reason")


@registry.add("selected_suggestions", "WITH " + DECISIONS + """
SELECT suggestion_id, suggestion_id IN (SELECT selected_suggestion_id FROM picked) AS is_selected FROM offers""")
def selected_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, offers = decisions(spark, sf_dir)
    return decide.selected_suggestions(decide.fold_decisions(log, offers), offers).select("suggestion_id", "is_selected")


@registry.add("bulk_outcomes", "WITH " + DECISIONS + """,
final AS (SELECT issue_id, min(decided_at) AS final_at FROM decisions WHERE action IN ('REJECT', 'SKIP') GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, NOT bool_or(coalesce(final_at <= l_shipdate, false)) AS accepted
FROM lineitem LEFT JOIN final ON issue_id = l_partkey || '-' || l_linenumber GROUP BY 1""")
def bulk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = decisions(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    batches = lines.select(
        F.col("l_orderkey").cast("string").alias("batch_id"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("issue_id"), F.lit("SKIP").alias("action"),
        F.col("l_shipdate").alias("decided_at"))
    known = lines.select(F.concat_ws("-", "l_partkey", "l_linenumber").alias("issue_id")).distinct()
    return decide.bulk_outcomes(batches, known, log)


# --- approval --------------------------------------------------------------------------


@registry.add("resolved_scope", "WITH " + ISSUES + "," + CORRECTIONS + """
SELECT review_run_id, count(*) AS issue_count, count(DISTINCT record_ref) AS affected_record_count
FROM issues JOIN corrections c USING (issue_id) WHERE final_value IS NOT NULL AND c.status IN ('ACCEPTED', 'EDITED')
GROUP BY 1""")
def resolved_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.scope_size(decide.resolved_scope(issues(spark, sf_dir), corrections(spark, sf_dir)))


VOTES = """
submitted AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_partkey AS VARCHAR) AS issue_id
  FROM lineitem),
votes AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_partkey AS VARCHAR) AS issue_id,
  CASE WHEN l_tax > 0.06 THEN 'REJECT' ELSE 'APPROVE' END AS decision FROM lineitem WHERE l_discount > 0.02)"""


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    request = F.col("l_orderkey").cast("string").alias("request_id")
    issue = F.col("l_partkey").cast("string").alias("issue_id")
    submitted = lines.select(request, issue).distinct()
    log = lines.where("l_discount > 0.02").select(
        request, F.when(F.col("l_tax") > 0.06, "REJECT").otherwise("APPROVE").alias("decision"), issue)
    return submitted, decide.decided_issues(log)


@registry.add("approval_status", "WITH " + VOTES + """,
per AS (SELECT s.request_id, (SELECT count(*) FROM submitted x WHERE x.request_id = s.request_id AND x.issue_id NOT IN
    (SELECT v.issue_id FROM votes v WHERE v.request_id = x.request_id)) AS remaining,
  (SELECT count(*) FROM votes v WHERE v.request_id = s.request_id) AS decided_issues,
  (SELECT bool_and(decision = 'APPROVE') FROM votes v WHERE v.request_id = s.request_id) AS unanimous
  FROM (SELECT DISTINCT request_id FROM submitted) s)
SELECT request_id, remaining, decided_issues, CASE WHEN decided_issues = 0 THEN 'PENDING' WHEN remaining > 0
  THEN 'PARTIALLY_APPROVED' WHEN unanimous THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM per""")
def approval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.approval_status(*_votes(spark, sf_dir))


@registry.add("remaining_scope", "WITH " + VOTES + """
SELECT request_id, issue_id FROM submitted EXCEPT SELECT request_id, issue_id FROM votes""")
def remaining_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.remaining_scope(*_votes(spark, sf_dir))


@registry.add("outside_scope", "WITH " + VOTES + """
SELECT DISTINCT request_id, issue_id FROM votes""")
def outside_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted, votes = _votes(spark, sf_dir)
    asked = votes.select("request_id", "issue_id").distinct()
    return decide.outside_scope(asked, decide.remaining_scope(submitted, votes))


@registry.add("approved_scope", "WITH " + ISSUES + "," + CORRECTIONS + """
SELECT i.issue_id, record_ref, column_name, original_value, final_value, c.status AS correction_status
FROM issues i LEFT JOIN corrections c USING (issue_id) WHERE severity = 'HIGH'""")
def approved_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues(spark, sf_dir)
    votes = found.select(F.lit("Q1").alias("request_id"), "issue_id", F.when(
        F.col("severity") == "HIGH", "APPROVE").otherwise("REJECT").alias("decision"))
    return decide.approved_scope(found, votes, corrections(spark, sf_dir), "Q1").select(
        "issue_id", "record_ref", "column_name", "original_value", "final_value", "correction_status")
