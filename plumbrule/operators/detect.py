"""Rule detection from column profiles: semantic category, proposed rule, promotion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, functions as F

from plumbrule.functions.ordered import number_in_group
from plumbrule.functions.text import name_has_token
from plumbrule.operators.evidence.gate import unfenced
from plumbrule.spec import NUMERIC_TYPES, RULE_TYPES, TEMPORAL_TYPES, RuleSpec, SpecError

# Detection patterns, name tokens and scores.
EMAIL_REGEX = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_REGEX = r"^\+?[0-9][0-9\-\s]{7,18}$"
EMAIL_TOKENS = ("email",)
PHONE_TOKENS = ("phone", "mobile", "contact", "tel")
ID_TOKENS = ("id", "code", "key", "number", "no")
NUMERIC_TOKENS = ("amount", "price", "cost", "balance", "score", "total", "qty", "quantity")
MATCH_RATIO = 0.8
UNIQUE_RATIO = 0.75
MIN_CONFIDENCE = 0.75
MAX_UNDECIDED = 40


def match_ratio(regex: str) -> Column:
    """Share of the known sample values matching from the start, weighted by frequency.

    Uses the top values; without them the minimum, maximum and mode count once each.
    """
    plain = F.filter(F.array("min_value", "max_value", "mode_value"), lambda v: v.isNotNull())
    samples = F.when(
        F.size("value_distribution") > 0, F.col("value_distribution")
    ).otherwise(F.transform(plain, lambda v: F.struct(v.alias("value"), F.lit(1).cast("bigint").alias("count"))))

    def weight(keep: bool) -> Column:
        return F.aggregate(samples, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(
            s["value"].rlike(regex) if keep else F.lit(True), s["count"]).otherwise(F.lit(0).cast("bigint")))

    whole = weight(False)
    return F.when(whole > 0, weight(True) / whole).otherwise(F.lit(0.0))


def semantic_categories(profiles: DataFrame) -> DataFrame:
    """Category, confidence and reasoning per column; the first matching signal wins."""
    name, kind = F.col("column_name"), F.col("normalized_data_type")
    ratio = F.col("distinct_percentage") / 100.0
    by_name = name_has_token(name, ID_TOKENS)
    unique = F.coalesce(ratio > UNIQUE_RATIO, F.lit(False))
    numeric = kind.isin(*NUMERIC_TYPES)

    def found(category: str, confidence: float, reasoning: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"),
                        F.lit(reasoning).alias("reasoning"))

    scored = profiles.withColumn("_email", match_ratio(EMAIL_REGEX)).withColumn("_phone", match_ratio(PHONE_REGEX))
    verdict = (
        F.when(name_has_token(name, EMAIL_TOKENS) | (F.col("_email") > MATCH_RATIO),
               found("email", 0.96, "the name or the values look like email addresses"))
        .when(name_has_token(name, PHONE_TOKENS) | (F.col("_phone") > MATCH_RATIO),
              found("phone", 0.92, "the name or the values look like phone numbers"))
        .when(kind.isin(*TEMPORAL_TYPES), found("date", 0.90, "the column holds dates or times"))
        .when(by_name & (unique | ratio.isNull()), found("id", 0.85, "the name says identifier and values hardly repeat"))
        .when(unique, found("id", 0.80, "values hardly repeat"))
        .when(numeric & name_has_token(name, NUMERIC_TOKENS),
              found("numeric", 0.88, "the name and type say bounded measure"))
        .when(numeric, found("numeric", 0.80, "the column is numeric"))
        .otherwise(found("free_text", 0.55, "no clear signal")))
    return scored.withColumn("_v", verdict).select(*profiles.columns, "_v.*")


def detect_rules(profiles: DataFrame) -> DataFrame:
    """One row per column: its category and, when confident, the rule it implies."""
    low, high = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")
    category = F.col("category")
    usable = low.isNotNull() & high.isNotNull()
    rule_type = F.when(F.col("confidence") >= MIN_CONFIDENCE, (
        F.when(category.isin("email", "phone"), "PATTERN")
        .when(category == "date", "COMPLETENESS")
        .when(category == "id", "UNIQUENESS")
        .when((category == "numeric") & usable, "RANGE")))
    definition = (
        F.when(category == "email", F.to_json(F.struct(F.lit(EMAIL_REGEX).alias("regex"))))
        .when(category == "phone", F.to_json(F.struct(F.lit(PHONE_REGEX).alias("regex"))))
        .when(category == "date", F.lit('{"max_null_percentage":0}'))
        .when(category == "id", F.lit('{"max_duplicate_percentage":0}'))
        .when(category == "numeric", F.to_json(F.struct(low.alias("min"), high.alias("max")))))
    typed = semantic_categories(profiles).withColumn("rule_type", rule_type)
    proposed = F.col("rule_type").isNotNull()
    return typed.select(
        "column_name", "normalized_data_type", "category", "confidence", "reasoning", "rule_type",
        F.when(proposed, definition).alias("definition"), F.when(proposed, F.lit("MEDIUM")).alias("severity"),
        F.when(proposed, F.lit("PENDING_REVIEW")).alias("status"),
        F.when(proposed, F.lit("PATTERN_DETECTED")).alias("origin"))


def undecided(detected: DataFrame) -> DataFrame:
    """Columns without a rule."""
    return detected.where(F.col("rule_type").isNull())


def undecided_report(detected: DataFrame, cap: int = MAX_UNDECIDED) -> DataFrame:
    """How many columns stay undecided, how many of them are listed, how many lie beyond the cap."""
    n = undecided(detected).agg(F.count(F.lit(1)).alias("considered"))
    return n.select("considered", F.least("considered", F.lit(cap)).alias("listed"),
                    F.greatest(F.col("considered") - cap, F.lit(0)).alias("beyond_cap"))


# Shape of an external rule proposal list.
_PROPOSAL = "array<struct<column_name:string,rule_type:string,definition:string,confidence:double,reasoning:string>>"


def parse_rule_proposals(responses: DataFrame, text_column: str = "text") -> DataFrame:
    """External proposals (a JSON array, possibly fenced) as rows; unusable text yields none."""
    parsed = F.from_json(unfenced(F.col(text_column)), _PROPOSAL)
    return responses.select(F.explode(parsed).alias("p")).select("p.*")


def merge_proposals(detected: DataFrame, proposals: DataFrame) -> DataFrame:
    """External proposals for undecided columns: known columns, known types, object definitions only."""
    accepted = proposals.where(
        F.col("rule_type").isin(*RULE_TYPES)
        & F.coalesce(F.trim("definition").rlike(r"(?s)^\{.*\}$"), F.lit(False)))
    return undecided(detected).select("column_name", "normalized_data_type").join(accepted, "column_name").select(
        "column_name", "normalized_data_type", F.lit(None).cast("string").alias("category"), "confidence",
        "reasoning", "rule_type", "definition", F.lit("MEDIUM").alias("severity"),
        F.lit("PENDING_REVIEW").alias("status"), F.lit("AI_RECOMMENDED").alias("origin"))


def promote(proposal: Row | dict, assignment_id: str) -> RuleSpec:
    """Turn a reviewed proposal into an assignment."""
    p = proposal.asDict() if isinstance(proposal, Row) else dict(proposal)
    if p["status"] != "PENDING_REVIEW":
        raise SpecError(f"only a pending proposal can be promoted, not {p['status']}")
    if p["rule_type"] == "CROSS_COLUMN":
        raise SpecError("a cross-column rule needs its columns chosen by hand")
    columns = () if p["rule_type"] == "DUPLICATE" else (p["column_name"],)
    return RuleSpec(assignment_id, p["rule_type"], columns, json.loads(p["definition"] or "{}"),
                    p.get("severity") or "MEDIUM")


def promotion_outcomes(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set form of promote and dismiss: decisions carry column_name and action."""
    pending = F.col("status") == "PENDING_REVIEW"
    promoted = F.col("action") == "PROMOTE"
    refused = (F.when(~pending, "not pending review")
               .when(promoted & (F.col("rule_type") == "CROSS_COLUMN"), "cross-column rules need chosen columns"))
    return proposals.join(decisions, "column_name").select(
        "column_name", "rule_type", "definition", "severity", "action",
        F.when(refused.isNull(), F.when(promoted, "ACTIVE").otherwise("DISABLED"))
        .otherwise(F.col("status")).alias("status"),
        F.when(promoted & refused.isNull(), F.when(F.col("rule_type") == "DUPLICATE", "DATASET_LEVEL")
               .otherwise("SINGLE_COLUMN")).alias("scope"),
        refused.alias("refused_reason"))


def current_versions(versions: DataFrame) -> DataFrame:
    """Number versions per rule by publication time and mark the last one as current."""
    numbered = number_in_group(versions, "rule_id", "published_at", "definition", "version", "_versions")
    return numbered.withColumn("is_current", F.col("version") == F.col("_versions")).drop("_versions")
