"""Reviewer decisions and approval as folds of append-only logs.

Decision events: event_id, issue_id, action (ACCEPT, EDIT, CORRECT, REJECT,
SKIP), suggestion_id, value, decided_by, decided_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.functions.grouping import lookup

# Actions and outcomes.
TERMINAL = ("REJECT", "SKIP")
RESOLVED_STATUSES = ("ACCEPTED", "EDITED")


def _at() -> Column:
    return F.struct("decided_at", "event_id")


def judged_events(events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Each event with its value, and why it is refused (NULL when it counts).

    The first REJECT or SKIP of an issue is final. It is found by aggregation
    and handed to the issue's other events by a skew-safe lookup.
    """
    known = suggestions.select("suggestion_id", "suggested_value", "source")
    # Many events name no suggestion: their NULL keys must not meet in one task.
    joined = lookup(events, known, "suggestion_id", "event_id")
    action = F.col("action")
    value = F.when(action == "ACCEPT", F.col("suggested_value")).when(action.isin("EDIT", "CORRECT"), F.col("value"))
    blank = ~action.isin(*TERMINAL) & text.is_blank(value)
    ends = events.where(action.isin(*TERMINAL)).groupBy("issue_id").agg(F.min(_at()).alias("ended"))
    placed = lookup(
        joined.select(*events.columns, "source", value.alias("final_value"), blank.alias("blank")),
        ends, "issue_id", "event_id", counted_from=events)
    reason = (F.when(_at() > F.col("ended"), "already rejected or skipped")
              .when(F.col("blank"), "blank value"))
    return placed.select(*events.columns, "source", "final_value", reason.alias("refused_reason"))


def fold_decisions(events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One correction per decided issue: the last event that counts."""
    counted = judged_events(events, suggestions).where(F.col("refused_reason").isNull())
    action = F.col("action")
    status = (F.when(action == "ACCEPT", "ACCEPTED").when(action.isin("EDIT", "CORRECT"), "EDITED")
              .when(action == "REJECT", "REJECTED").otherwise("SKIPPED"))
    value_source = (F.when(action.isin("EDIT", "CORRECT"), F.lit("HUMAN")).when(action.isin("ACCEPT", "REJECT"),
                                                                                   F.col("source")))
    shaped = counted.select(
        "issue_id", F.struct(
            "decided_at", "event_id", status.alias("status"), F.col("final_value"), value_source.alias("value_source"),
            F.when(~action.isin("CORRECT", "SKIP"), F.col("suggestion_id")).alias("suggestion_id"), "decided_by"
        ).alias("e"),
        F.when(action.isin("ACCEPT", "EDIT"), F.struct("decided_at", "event_id", "suggestion_id")).alias("s"))
    last = shaped.groupBy("issue_id").agg(F.max("e").alias("e"), F.max("s").alias("s"))
    return last.select(
        "issue_id", F.col("e.final_value").alias("final_value"), F.col("e.value_source").alias("value_source"),
        F.col("e.status").alias("status"), F.col("e.suggestion_id").alias("suggestion_id"),
        F.col("e.decided_by").alias("decided_by"), F.col("e.decided_at").alias("decided_at"),
        F.when(F.col("e.status") == "SKIPPED", "SKIPPED").otherwise("RESOLVED").alias("issue_status"),
        F.col("s.suggestion_id").alias("selected_suggestion_id"))


def refused_events(events: DataFrame, suggestions: DataFrame) -> DataFrame:
    return judged_events(events, suggestions).where(F.col("refused_reason").isNotNull())


def selected_suggestions(corrections: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every suggestion with ``is_selected``; at most one per issue."""
    chosen = corrections.where(F.col("selected_suggestion_id").isNotNull()).select(
        F.col("selected_suggestion_id").alias("suggestion_id"), F.lit(True).alias("is_selected"))
    return suggestions.join(chosen, "suggestion_id", "left").withColumn(
        "is_selected", F.coalesce("is_selected", F.lit(False)))


def bulk_outcomes(batches: DataFrame, issues: DataFrame, events: DataFrame) -> DataFrame:
    """All-or-nothing bulk actions: batch_id, issue_id, action, decided_at -> accepted per batch.

    A batch is refused when an issue is unknown, or final by an event of the log that is not
    later than the batch. The log holds the events of the batches accepted before.
    """
    final = events.where(F.col("action").isin(*TERMINAL)).groupBy("issue_id").agg(F.min("decided_at").alias("_final"))
    known = issues.select("issue_id").distinct().join(final, "issue_id", "left").withColumn("_known", F.lit(True))
    placed = batches.withColumn("_pos", F.xxhash64("batch_id", "issue_id"))
    bad = F.col("_known").isNull() | F.coalesce(F.col("_final") <= F.col("decided_at"), F.lit(False))
    return lookup(placed, known, "issue_id", "_pos").groupBy("batch_id").agg((~F.bool_or(bad)).alias("accepted"))


def resolved_scope(issues: DataFrame, corrections: DataFrame) -> DataFrame:
    """Issues with an accepted or edited value, ready for approval."""
    ready = corrections.where(F.col("final_value").isNotNull() & F.col("status").isin(*RESOLVED_STATUSES)).select(
        "issue_id", "final_value", F.col("status").alias("correction_status"))
    return issues.join(ready, "issue_id")


def scope_size(scope: DataFrame) -> DataFrame:
    """Issues and distinct records per review."""
    return scope.groupBy("review_run_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.countDistinct("record_ref").alias("affected_record_count"))


def decided_issues(decisions: DataFrame) -> DataFrame:
    """(request_id, issue_id, decision), each once, from decisions with one row per issue."""
    return decisions.select("request_id", "decision", "issue_id").distinct()


def remaining_scope(submitted: DataFrame, decided: DataFrame) -> DataFrame:
    """Submitted (request_id, issue_id) pairs without a decision."""
    return submitted.join(decided.select("request_id", "issue_id").distinct(), ["request_id", "issue_id"], "left_anti")


def outside_scope(requested: DataFrame, remaining: DataFrame) -> DataFrame:
    """Requested pairs that may not be decided; a decision is valid when this is empty."""
    return requested.join(remaining, ["request_id", "issue_id"], "left_anti")


def approval_status(submitted: DataFrame, decided: DataFrame) -> DataFrame:
    """Status per request: PENDING, PARTIALLY_APPROVED, APPROVED or REJECTED."""
    left = remaining_scope(submitted, decided).groupBy("request_id").agg(F.count(F.lit(1)).alias("remaining"))
    votes = decided.groupBy("request_id").agg(
        F.bool_and(F.col("decision") == "APPROVE").alias("unanimous"), F.count(F.lit(1)).alias("decided_issues"))
    requests = submitted.select("request_id").distinct()
    joined = requests.join(left, "request_id", "left").join(votes, "request_id", "left").withColumn(
        "remaining", F.coalesce("remaining", F.lit(0).cast("bigint")))
    status = (F.when(F.col("decided_issues").isNull(), "PENDING")
              .when(F.col("remaining") > 0, "PARTIALLY_APPROVED")
              .when(F.col("unanimous"), "APPROVED").otherwise("REJECTED"))
    return joined.select("request_id", status.alias("status"), "remaining",
                         F.coalesce("decided_issues", F.lit(0).cast("bigint")).alias("decided_issues"))


def approved_scope(issues: DataFrame, decided: DataFrame, corrections: DataFrame, request_id: str) -> DataFrame:
    """Approved issues of a request with their corrections (a missing one stays visible as NULL)."""
    approved = decided.where((F.col("request_id") == request_id) & (F.col("decision") == "APPROVE")).select(
        "issue_id").distinct()
    values = corrections.select("issue_id", "final_value", F.col("status").alias("correction_status"))
    return issues.join(approved, "issue_id", "left_semi").join(values, "issue_id", "left")


