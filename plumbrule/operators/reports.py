"""Reports and listings over the tables that validation and review produce."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbrule.functions.grouping import join_small, lookup


def _within(c: str, start: Column, end: Column) -> Column:
    return F.col(c).between(start, end)


def _seconds(later: str, earlier: str) -> Column:
    """Difference of two timestamps in seconds, with fractions."""
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / F.lit(1e6)


def check_range(start: object, end: object) -> None:
    if start > end:  # type: ignore[operator]
        raise ValueError("the range starts after it ends")


def quality_trend(runs: DataFrame, start: Column, end: Column, dataset_id: str | None = None) -> DataFrame:
    """Scored runs of a closed time range, oldest first; runs over empty tables have no score."""
    picked = runs.where(_within("created_at", start, end) & F.col("quality_score").isNotNull())
    if dataset_id is not None:
        picked = picked.where(F.col("dataset_id") == dataset_id)
    return picked.select("run_id", "dataset_id", "created_at", "quality_score").orderBy("created_at", "run_id")


def rule_effectiveness(failures: DataFrame, runs: DataFrame, rules: DataFrame, start: Column, end: Column,
                       dataset_id: str | None = None) -> DataFrame:
    """Failures per rule with their severities and share of all failures.

    Failures are counted per (run, assignment, severity) before any join, so
    neither a large run nor a frequently failing rule is shuffled row by row.
    ``rules`` has one row per assignment (assignment_id, rule_id, rule_name, rule_type).
    """
    in_range = runs.where(_within("created_at", start, end))
    if dataset_id is not None:
        in_range = in_range.where(F.col("dataset_id") == dataset_id)
    counted = failures.groupBy("run_id", "assignment_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(in_range.select("run_id"), "run_id").join(
        rules.select("assignment_id", "rule_id", "rule_name", "rule_type"), "assignment_id")
    by_severity = named.groupBy("rule_id", "rule_name", "rule_type", "severity").agg(F.sum("n").alias("n"))
    per_rule = by_severity.groupBy("rule_id", "rule_name", "rule_type").agg(
        F.sum("n").alias("failure_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity_breakdown"))
    whole = by_severity.agg(F.sum("n").alias("_all"))
    return per_rule.withColumn("_all", whole.scalar()).select(
        "rule_id", "rule_name", "rule_type", "failure_count", "severity_breakdown",
        (F.col("failure_count") / F.col("_all")).alias("failure_rate")
    ).orderBy(F.desc("failure_count"), "rule_id")


def latest_scores(runs: DataFrame) -> DataFrame:
    """The newest scored run per dataset, by aggregation rather than a sort per dataset."""
    scored = runs.where(F.col("quality_score").isNotNull())
    return scored.groupBy("dataset_id").agg(F.max(F.struct("created_at", "run_id", "quality_score")).alias("m")).select(
        "dataset_id", F.col("m.quality_score").alias("latest_quality_score"),
        F.col("m.run_id").alias("latest_run_id"), F.col("m.created_at").alias("latest_validated_at"))


def latest_completed_runs(runs: DataFrame) -> DataFrame:
    """The newest completed run per dataset."""
    done = runs.where(F.col("status") == "COMPLETED")
    newest = done.groupBy("dataset_id").agg(F.max(F.struct("created_at", "run_id")).alias("m"))
    return newest.select("dataset_id", F.col("m.run_id").alias("run_id"), F.col("m.created_at").alias("created_at"))


def quality_by_dataset(datasets: DataFrame, schemas: DataFrame, connections: DataFrame, runs: DataFrame,
                       data_source_id: str | None = None) -> DataFrame:
    """Every active dataset with its latest score, NULL when it has none."""
    active = datasets.where("is_active").select("dataset_id", "dataset_name", "schema_id")
    sources = connections.select("connection_id", "data_source_id")
    if data_source_id is not None:
        sources = sources.where(F.col("data_source_id") == data_source_id)
    # A schema may hold a third of all datasets.
    placed = join_small(active, join_small(schemas.select("schema_id", "connection_id"), sources, ["connection_id"]), ["schema_id"])
    return placed.join(latest_scores(runs), "dataset_id", "left").select(
        "dataset_id", "dataset_name", "latest_quality_score", "latest_run_id", "latest_validated_at")


def review_performance(corrections: DataFrame, issues: DataFrame, start: Column, end: Column) -> DataFrame:
    """Decisions per reviewer and the mean seconds from issue to decision."""
    decided = corrections.where(
        F.col("decided_by").isNotNull() & F.col("decided_at").isNotNull() & _within("decided_at", start, end))
    joined = decided.select("issue_id", "decided_by", "decided_at").join(
        issues.select("issue_id", F.col("created_at").alias("opened_at")), "issue_id")
    return joined.groupBy(F.col("decided_by").alias("reviewer_id")).agg(
        F.count(F.lit(1)).alias("decision_count"),
        F.avg(_seconds("decided_at", "opened_at")).alias("avg_latency_seconds")
    ).orderBy(F.desc("decision_count"), "reviewer_id")


def approval_metrics(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """Requests per status, the approved share and the mean decision latency."""
    picked = requests.where(_within("requested_at", start, end))
    status = F.col("status")
    counted = picked.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(status == "APPROVED").alias("approved_count"),
        F.count_if(status == "REJECTED").alias("rejected_count"),
        F.count_if(status == "PARTIALLY_APPROVED").alias("partially_approved_count"),
        F.count_if(status == "PENDING").alias("pending_count"),
        F.avg(_seconds("decided_at", "requested_at")).alias("avg_decision_latency_seconds"))
    return counted.withColumn("approval_rate", F.when(
        F.col("total_requests") > 0, F.col("approved_count") / F.col("total_requests")))


def failures_by_severity(failures: DataFrame, run_id: str) -> DataFrame:
    return failures.where(F.col("run_id") == run_id).groupBy("severity").agg(F.count(F.lit(1)).alias("failure_count"))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: DataFrame


def page_of(df: DataFrame, order: Sequence[str | Column], page: int, page_size: int) -> Page:
    """One page in a total order, and the total count as a one-row frame."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return Page(rows, df.agg(F.count(F.lit(1)).alias("total")))


def failure_detail(failures: DataFrame, rules: DataFrame, run_id: str, severity: str | None = None,
                   column_name: str | None = None, assignment_id: str | None = None) -> DataFrame:
    """Failures of a run with the rule that produced them.

    The rule table is broadcast after a size check; its rows repeat on the
    left far too often to shuffle on.
    """
    picked = failures.where(F.col("run_id") == run_id)
    for name, wanted in (("severity", severity), ("column_name", column_name), ("assignment_id", assignment_id)):
        if wanted is not None:
            picked = picked.where(F.col(name) == wanted)
    about = rules.select("assignment_id", "rule_id", "rule_name", "version")
    return join_small(picked, about, ["assignment_id"])


def list_failures(failures: DataFrame, rules: DataFrame, run_id: str, page: int = 1, page_size: int = 50,
                  **filters: str | None) -> Page:
    detail = failure_detail(failures, rules, run_id, **filters)
    return page_of(detail, ["row_index", "record_ref", "assignment_id"], page, page_size)


def evaluated_rules(metrics: DataFrame, rules: DataFrame, run_id: str) -> DataFrame:
    """The rules a run evaluated, including those without any failure."""
    done = metrics.where((F.col("run_id") == run_id) & (F.col("metric_name") == "rule_evaluated")).select(
        F.col("metric_group").alias("assignment_id"))
    return join_small(done, rules.select(
        "assignment_id", "rule_id", "rule_name", "rule_type", "version", "severity", "column_name"), ["assignment_id"])


def enabled_assignments(assignments: DataFrame, versions: DataFrame, rules: DataFrame, dataset_id: str) -> DataFrame:
    """Enabled assignments of a dataset with their version and rule."""
    mine = assignments.where((F.col("dataset_id") == dataset_id) & F.col("is_enabled"))
    # A frequent version or rule is not gathered in one task.
    with_version = join_small(mine, versions.select("version_id", "rule_id", "version", "definition", "severity"), ["version_id"])
    return join_small(with_version, rules.select("rule_id", "rule_name", "rule_type"), ["rule_id"])


def list_datasets(datasets: DataFrame, schema_id: str | None = None, search: str | None = None,
                  is_active: bool | None = None) -> DataFrame:
    """Datasets by schema, case-insensitive part of the name, and active flag."""
    picked = datasets
    if schema_id is not None:
        picked = picked.where(F.col("schema_id") == schema_id)
    if search:
        plain = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        picked = picked.where(F.col("dataset_name").ilike(f"%{plain}%"))
    if is_active is not None:
        picked = picked.where(F.col("is_active") == is_active)
    return picked.orderBy("dataset_name", "dataset_id")


def visible(entities: DataFrame, cutoff: Column) -> DataFrame:
    """Active entities, and those deactivated at or after the cutoff."""
    return entities.where(F.col("is_active") | F.coalesce(F.col("deactivated_at") >= cutoff, F.lit(False)))


def list_runs(runs: DataFrame, order: Sequence[str | Column] | None = None, **equal: object) -> DataFrame:
    """Rows with the given column values, newest first unless ordered otherwise."""
    picked = runs
    for name, value in equal.items():
        if value is not None:
            picked = picked.where(F.col(name) == value)
    return picked.orderBy(*(order or [F.desc("created_at"), "run_id"]))


def suggestion_trace(suggestions: DataFrame, ai_suggestions: DataFrame, prompts: DataFrame,
                     usage: DataFrame) -> DataFrame:
    """Provenance per suggestion: OK, NO_AI_CALL or BROKEN_LINKAGE, with token totals."""
    totals = usage.groupBy("ai_suggestion_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("input_tokens").isNotNull()).alias("successful_calls"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))
    backed = (F.col("source") == "AI") & F.col("ai_suggestion_id").isNotNull()
    wanted = suggestions.select("suggestion_id", "source", F.when(backed, F.col("ai_suggestion_id")).alias("ai_suggestion_id"))
    calls = ai_suggestions.select("ai_suggestion_id", "provider", "model", "prompt_version_id",
                                  F.lit(True).alias("_found")).join(totals, "ai_suggestion_id", "left")
    known = join_small(calls, prompts.select("prompt_version_id", "prompt_key", "version_number"),
                       ["prompt_version_id"], "left")
    # Most suggestions are not backed by a call; the lookup spreads their NULL keys.
    named = lookup(wanted, known, "ai_suggestion_id", "suggestion_id")
    status = (F.when(F.col("ai_suggestion_id").isNull(), "NO_AI_CALL")
              .when(F.col("_found").isNull(), "BROKEN_LINKAGE").otherwise("OK"))
    return named.select(
        "suggestion_id", "ai_suggestion_id", F.col("ai_suggestion_id").isNotNull().alias("is_llm_backed"),
        status.alias("linkage_status"), "provider", "model", "prompt_key", "version_number",
        F.coalesce("calls", F.lit(0).cast("bigint")).alias("calls"),
        F.coalesce("successful_calls", F.lit(0).cast("bigint")).alias("successful_calls"), "total_tokens")


def ranked_scores(runs: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` newest scored runs per dataset, numbered.

    The filter on the number lets Spark drop older runs before the shuffle.
    """
    order = W.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    ranked = runs.where(F.col("quality_score").isNotNull()).withColumn("recency", F.row_number().over(order))
    return ranked.where(F.col("recency") <= keep)
