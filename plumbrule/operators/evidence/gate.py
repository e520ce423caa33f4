"""Parse external correction suggestions and hold them against the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text

# Categories and closeness of an agreeing value.
HIGH, REVIEW, CANNOT = "AI_HIGH_CONFIDENCE", "NEEDS_REVIEW", "CANNOT_INFER"
REL, ABS = 1e-3, 1e-6

_RESPONSE = "struct<category:string,suggested_value:string,confidence:string,reasoning:string>"


def unfenced(c: Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    stripped = text.strip(c)
    inner = text.strip(F.regexp_replace(F.regexp_replace(stripped, "^`+|`+$", ""), "^(?i:json)", ""))
    return F.when(stripped.startswith("```"), inner).otherwise(stripped)


def parse_suggestions(responses: DataFrame, text_column: str = "text") -> DataFrame:
    """(category, suggested_value, confidence, reasoning) per response.

    Anything malformed becomes NEEDS_REVIEW without a value; a value is kept
    only for high confidence.
    """
    body = unfenced(F.col(text_column))
    is_object = body.startswith("{") & body.endswith("}") & F.get_json_object(body, "$").isNotNull()
    parsed = F.from_json(body, _RESPONSE)
    # A JSON string only: numbers and objects are not values.
    raw_value = F.get_json_object(body, "$.suggested_value")
    quoted = body.rlike(r'"suggested_value"\s*:\s*"')
    made = responses.withColumn("_ok", F.coalesce(is_object, F.lit(False))).withColumn("_p", parsed)
    category = F.col("_p.category")
    known = F.coalesce(F.col("_ok") & category.isin(HIGH, REVIEW, CANNOT), F.lit(False))
    value = F.when(quoted & ~text.is_blank(raw_value), raw_value)
    kept = F.when(known & (category == HIGH), value)
    final = F.when(~known, REVIEW).when((category == HIGH) & kept.isNull(), REVIEW).otherwise(category)
    numeric = ~F.coalesce(body.rlike(r'"confidence"\s*:\s*"'), F.lit(True))
    confidence = F.when(numeric, F.col("_p.confidence").try_cast("double"))
    reasoning = F.when(~F.col("_ok"), "the response was not a JSON object").when(
        ~known, "the response used an unknown category").otherwise(
        F.when(~text.is_blank(F.col("_p.reasoning")), F.col("_p.reasoning")))
    return made.select(
        *responses.columns, final.alias("category"), kept.alias("suggested_value"),
        F.when((final == HIGH) & confidence.between(0, 1), confidence).alias("confidence"),
        reasoning.alias("reasoning")).drop(text_column)


def _agree(a: Column, b: Column) -> Column:
    return F.coalesce(text.close(text.finite(a), text.finite(b), REL, ABS), F.lit(False))


def gate_single(suggestions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hold suggestions against one relationship verdict per issue.

    Without evidence, or without a claim of high confidence, nothing changes.
    Otherwise the value must match the candidate, which then replaces it, and
    the confidence is capped.
    """
    facts = evidence.select("issue_id", F.col("status").alias("_status"), F.col("candidate_value").alias("_value"),
                            F.col("confidence").alias("_limit"))
    joined = suggestions.join(facts, "issue_id", "left")
    claimed = (F.col("category") == HIGH) & F.col("_status").isNotNull()
    backed = (F.col("_status") == "CANDIDATE") & _agree(F.col("suggested_value"), F.col("_value"))
    rejected = claimed & ~F.coalesce(backed, F.lit(False))
    return joined.select(
        *[c for c in suggestions.columns if c not in ("category", "suggested_value", "confidence", "reasoning")],
        F.when(rejected, REVIEW).otherwise(F.col("category")).alias("category"),
        F.when(rejected, F.lit(None)).when(claimed, text.number_text(F.col("_value")))
        .otherwise(F.col("suggested_value")).alias("suggested_value"),
        F.when(rejected, F.lit(None)).when(claimed, F.least("confidence", "_limit"))
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(rejected, F.when(F.col("_status") != "CANDIDATE", F.concat(
            F.lit("the evidence found "), F.col("_status"))).otherwise("the value does not match the evidence"))
        .otherwise(F.col("reasoning")).alias("reasoning"))


def gate_ranked(suggestions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hold suggestions against the ranked candidates of their issue.

    No or ambiguous candidate: no value, no high confidence. A candidate that
    the claim contradicts, or that the claim did not see, is kept for review.
    """
    facts = ranked.select("issue_id", F.lit(True).alias("_known"), F.col("recommended_value").alias("_value"),
                          F.col("confidence").alias("_limit"), F.col("no_candidate_reason").alias("_why"))
    joined = suggestions.join(facts, "issue_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    has = known & F.col("_value").isNotNull()
    high = F.col("category") == HIGH
    same = F.coalesce((F.col("suggested_value") == F.col("_value"))
                      | _agree(F.col("suggested_value"), F.col("_value")), F.lit(False))
    category = (
        F.when(known & ~has & high, REVIEW).when(has & high & ~same, REVIEW)
        .when(has & (F.col("category") == CANNOT), REVIEW).otherwise(F.col("category")))
    return joined.withColumn("_category", category).select(
        *[c for c in suggestions.columns if c not in ("category", "suggested_value", "confidence", "reasoning")],
        F.col("_category").alias("category"),
        F.when(has, F.col("_value")).when(known, F.lit(None)).otherwise(F.col("suggested_value"))
        .alias("suggested_value"),
        F.when(has & (F.col("_category") == HIGH), F.least("confidence", "_limit")).when(known, F.lit(None))
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(has & high & ~same, "the value does not match the evidence")
        .when(known & ~has, F.coalesce("reasoning", "_why"))
        .when(has & (F.col("category") == CANNOT), F.coalesce(
            F.col("reasoning"), F.lit("the evidence has a candidate"))).otherwise(F.col("reasoning"))
        .alias("reasoning"))


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """What may be shown of a relationship verdict: aggregates only, rounded."""
    return evidence.select("issue_id", F.to_json(F.struct(
        F.lit(True).alias("available"), "status", "relationship_type", "group_size",
        F.round("fit_quality", 4).alias("fit_quality"), F.round("residual", 6).alias("residual"),
        F.round("coefficient_of_variation", 6).alias("coefficient_of_variation"), "candidate_value",
        F.split("related_columns", ",").alias("related_columns"))).alias("summary"))


def ranked_summary(ranked: DataFrame) -> DataFrame:
    return ranked.select("issue_id", F.to_json(F.struct(
        F.lit(True).alias("available"), "ambiguous", "strategies_with_candidates", "recommended_value",
        "recommended_strategy", "confidence", "supporting_count", "contradicting_count",
        F.col("no_candidate_reason").alias("reason"))).alias("summary"))
