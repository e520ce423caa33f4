"""Issues from failures and deterministic correction suggestions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbrule.functions import text
from plumbrule.functions.grouping import join_small
from plumbrule.spec import NUMERIC_TYPES

# Confidence scores and the types a mode can fill.
MODE_TYPES = ("STRING", "TEXT", "BOOLEAN", "DATE", "DATETIME")
LOWEST, HIGHEST, UNKNOWN_SPREAD = 0.1, 0.9, 0.5
CLAMP_CONFIDENCE, TRIM_CONFIDENCE = 0.85, 0.95

SUGGESTION = "struct<fix_type:string,suggested_value:string,confidence:double,reasoning:string>"


def create_issues(failures: DataFrame, runs: DataFrame, review_run_id: str, run_id: str, created_at: Column) -> DataFrame:
    """One PENDING issue per failure of one completed run; none for a run that did not complete.

    Rows that agree in reference and content (full duplicates) are told apart by their position or, without
    one, by an occurrence number, so an issue_id stands for one failure. Equal failures are counted, with map-side
    combining, and numbered by spreading the count out again, so no task orders them.
    """
    completed = runs.where((F.col("run_id") == run_id) & (F.col("status") == "COMPLETED")).select("run_id").distinct()
    of_run = join_small(failures.where(F.col("run_id") == run_id), completed, ["run_id"])
    parts = ["run_id", "record_ref", "source_row_hash", "assignment_id", "row_index"]
    equal = of_run.groupBy(*parts, "rule_type", "column_name", "failed_value", "severity").agg(F.count(F.lit(1)).alias("_n"))
    # One row per different failure of the same reference.
    before = F.sum("_n").over(W.partitionBy(*parts).orderBy("failed_value", "rule_type", "column_name", "severity")) - F.col("_n")
    numbered = equal.withColumn("_before", before).withColumn(
        "_occurrence", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))))
    identity = F.concat_ws(text.UNIT_SEPARATOR, *parts, F.nullif("_occurrence", F.lit(1)))
    return numbered.select(
        F.sha2(identity, 256).alias("issue_id"), F.lit(review_run_id).alias("review_run_id"), "run_id",
        "record_ref", "row_index", "assignment_id", "rule_type", "column_name",
        F.col("failed_value").alias("original_value"), "severity", F.lit("PENDING").alias("status"),
        created_at.alias("created_at"))


def without_suggestion(issues: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Issues that have no suggestion yet."""
    return issues.join(suggestions.select("issue_id").distinct(), "issue_id", "left_anti")


def suggestions_with_issues(suggestions: DataFrame, issues: DataFrame, review_run_id: str) -> DataFrame:
    """Suggestions of one review with the issue they answer."""
    mine = issues.where(F.col("review_run_id") == review_run_id).select(
        "issue_id", "record_ref", "column_name", "original_value", "severity", F.col("status").alias("issue_status"))
    return suggestions.join(mine, "issue_id")


Generator = Callable[[], Column]
_generators: dict[str, list[tuple[str, Generator]]] = {}


def register_generator(rule_type: str, fix_type: str, build: Generator) -> None:
    """Add a generator: ``build`` returns a suggestion struct Column, NULL when it does not apply.

    It may use failed_value, definition (JSON text), normalized_data_type and
    the profile columns mode_value, median_value, stddev_value, distinct_percentage.
    """
    _generators.setdefault(rule_type, []).append((fix_type, build))


def _draft(fix_type: str, value: Column, confidence: Column, reasoning: str) -> Column:
    return F.struct(F.lit(fix_type).alias("fix_type"), value.cast("string").alias("suggested_value"),
                    confidence.cast("double").alias("confidence"), F.lit(reasoning).alias("reasoning"))


def _clamped(c: Column) -> Column:
    return F.round(F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), c)), 3)


def _mode_fill() -> Column:
    usable = (F.col("normalized_data_type").isin(*MODE_TYPES) & F.col("mode_value").isNotNull()
              & F.col("distinct_percentage").isNotNull())
    return F.when(usable, _draft(
        "mode_fill", F.col("mode_value"), _clamped(1 - F.col("distinct_percentage") / 100),
        "most frequent value of the latest profile"))


def _median_fill() -> Column:
    median, spread = F.col("median_value"), F.col("stddev_value")
    usable = F.col("normalized_data_type").isin(*NUMERIC_TYPES) & median.isNotNull() & spread.isNotNull()
    confidence = F.when(median == 0, F.lit(UNKNOWN_SPREAD)).otherwise(_clamped(1 - spread / F.abs(median)))
    return F.when(usable, _draft("median_fill", text.number_text(median), confidence, "median of the latest profile"))


def _range_clamp() -> Column:
    value = text.finite(F.col("failed_value"))
    low_text = F.get_json_object("definition", "$.min")
    high_text = F.get_json_object("definition", "$.max")
    bound = (F.when(value < low_text.try_cast("double"), low_text)
             .when(value > high_text.try_cast("double"), high_text))
    return F.when(bound.isNotNull(), _draft("range_clamp", bound, F.lit(CLAMP_CONFIDENCE), "nearest violated bound"))


def _trim_whitespace() -> Column:
    stripped = text.strip(F.col("failed_value"))
    regex = F.get_json_object("definition", "$.regex")
    anchored = F.concat(F.lit("^(?:"), regex, F.lit(")"))
    usable = (stripped != F.col("failed_value")) & F.regexp_like(stripped, anchored)
    return F.when(usable, _draft("trim_whitespace", stripped, F.lit(TRIM_CONFIDENCE),
                                 "matches once surrounding whitespace is removed"))


register_generator("COMPLETENESS", "mode_fill", _mode_fill)
register_generator("COMPLETENESS", "median_fill", _median_fill)
register_generator("RANGE", "range_clamp", _range_clamp)
register_generator("PATTERN", "trim_whitespace", _trim_whitespace)

_PROFILE = ("normalized_data_type", "mode_value", "median_value", "stddev_value", "distinct_percentage")


def with_context(issues: DataFrame, assignments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Issues with their rule's definition and their column's profile.

    The assignments are broadcast after a size check. A profile has one row
    per column of the dataset, so its size is bounded by the schema.
    """
    rules = assignments.select("assignment_id", "definition")
    stats = profiles.select("column_name", *_PROFILE)
    ruled = join_small(issues, rules, ["assignment_id"], "left")
    return ruled.join(F.broadcast(stats), "column_name", "left").withColumn("failed_value", F.col("original_value"))


def drafts(context: DataFrame) -> DataFrame:
    """Add ``drafts``: all suggestions of every registered generator for the issue's rule type."""
    cells = [F.when(F.col("rule_type") == rule_type, build())
             for rule_type, builders in sorted(_generators.items()) for _, build in builders]
    return context.withColumn("drafts", F.filter(F.array(*cells), lambda d: d.isNotNull()).cast(f"array<{SUGGESTION}>"))


def suggest(issues: DataFrame, assignments: DataFrame, profiles: DataFrame) -> DataFrame:
    """All deterministic suggestions, one row each."""
    made = drafts(with_context(issues, assignments, profiles))
    return made.select("issue_id", "review_run_id", "record_ref", "column_name", "rule_type",
                       F.explode("drafts").alias("d")).select(
        F.sha2(F.concat_ws(text.UNIT_SEPARATOR, "issue_id", "d.fix_type"), 256).alias("suggestion_id"),
        "issue_id", "review_run_id", "record_ref", "column_name", "rule_type", "d.*",
        F.lit("RULE_BASED").alias("source"), F.lit("DETERMINISTIC").alias("category"))


def suggestion_counts(issues: DataFrame, assignments: DataFrame, profiles: DataFrame) -> DataFrame:
    """How many issues got suggestions, how many got none, and how many suggestions there are."""
    made = drafts(with_context(issues, assignments, profiles)).select(F.size("drafts").alias("n"))
    return made.agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("n") > 0).alias("issues_with_suggestion"),
        F.count_if(F.col("n") == 0).alias("issues_without_suggestion"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("suggestions"))
