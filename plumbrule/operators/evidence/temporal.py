"""Gaps and next values of regular dates and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.functions.text import int_div
from plumbrule.operators.evidence import AMBIGUOUS, CANDIDATE, INSUFFICIENT, NO_RELATIONSHIP
from plumbrule.operators.evidence.progression import (
    MIN_CONSISTENCY, MIN_OBSERVATIONS, MIN_SUPPORT, progression,
)

# Accepted ISO text.
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_TIME = (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)"
            r"(Z|[+-][0-9]{2}:[0-9]{2})?$")
FIXED, YEARLY, MONTHLY = "FIXED_INTERVAL", "CALENDAR_YEAR_INTERVAL", "CALENDAR_MONTH_INTERVAL"

_DAY = 86_400_000_000
_EPOCH = "1970-01-01"


def parse_instants(values: DataFrame) -> DataFrame:
    """(column_name, micros, is_date, zone) of the ISO values; all NULL but the name for other text.

    ``micros`` is wall-clock time; the zone is kept as text because a cast
    would apply the session zone and lose it.
    """
    v = text.strip(F.col("value"))
    day_text = F.when(v.rlike(ISO_DATE), v).otherwise(F.regexp_extract(v, ISO_TIME, 1))
    clock = F.regexp_extract(v, ISO_TIME, 2)
    zone = F.regexp_replace(F.regexp_extract(v, ISO_TIME, 3), "^(Z|-00:00)$", "+00:00")
    whole = values.select(
        "column_name", *[c for c in values.columns if c not in ("column_name", "value")], day_text.try_cast("date").alias("day"), clock.alias("clock"), zone.alias("zone"),
        v.rlike(ISO_DATE).alias("is_date"))
    parts = F.split("clock", "[:.]")
    hour = F.coalesce(F.get(parts, F.lit(0)).try_cast("bigint"), F.lit(0))
    minute = F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(0))
    second = F.coalesce(F.get(parts, F.lit(2)).try_cast("bigint"), F.lit(0))
    micro = F.coalesce(F.rpad(F.get(parts, F.lit(3)), 6, "0").try_cast("bigint"), F.lit(0))
    days = F.datediff("day", F.lit(_EPOCH).cast("date")).cast("bigint")
    valid = F.coalesce(F.col("day").isNotNull() & (hour < 24) & (minute < 60) & (second < 60), F.lit(False))
    at = days * _DAY + ((hour * 60 + minute) * 60 + second) * 1_000_000 + micro
    kept = [c for c in values.columns if c != "value"]
    return whole.select(*kept, *[F.when(valid, c).alias(n) for n, c in (
        ("is_date", F.col("is_date")), ("zone", F.col("zone")), ("micros", at))])


def _day_of(micros: Column) -> Column:
    return F.date_add(F.lit(_EPOCH).cast("date"), F.floor(micros / F.lit(_DAY)).cast("int"))


def _iso(day: Column, tod: Column, is_date: Column, zone: Column) -> Column:
    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    seconds = int_div(tod, F.lit(1_000_000))
    micro = tod % 1_000_000
    clock = F.concat_ws(":", two(int_div(seconds, F.lit(3600))), two(int_div(seconds, F.lit(60)) % 60),
                        two(seconds % 60))
    fraction = F.when(micro != 0, F.concat(F.lit("."), F.lpad(micro.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.when(is_date, day.cast("string")).otherwise(
        F.concat(day.cast("string"), F.lit("T"), clock, fraction, zone))


def temporal_evidence(values: DataFrame, min_observations: int = MIN_OBSERVATIONS,
                      min_support: int = MIN_SUPPORT) -> DataFrame:
    """One verdict per column from (column_name, value) pairs.

    A fixed interval is tried first, then calendar years, then calendar
    months. Distinct instants are ordered range by range.
    """
    # Each distinct text is parsed once. Filters below test aggregates, because a test of a parsed
    # value would be pushed down to the scan and parse every row again.
    parsed = parse_instants(values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("times")))
    tod = F.col("micros") % F.lit(_DAY)
    tod = F.when(tod < 0, tod + F.lit(_DAY)).otherwise(tod)
    distinct = parsed.groupBy("column_name", "micros").agg(
        F.sum("times").alias("n"), F.count("micros").alias("known"), F.bool_and("is_date").alias("is_date"),
        F.min("zone").alias("z0"), F.max("zone").alias("z1"))
    day = _day_of(F.col("micros"))
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    columns = distinct.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("known") > 0, F.col("n"))), F.lit(0)).alias("observed"),
        F.count("micros").alias("d"),
        F.bool_and("is_date").alias("is_date"), F.min("z0").alias("z0"), F.max("z1").alias("z1"),
        (F.min(tod) == F.max(tod)).alias("same_time"), F.min(tod).alias("tod"),
        (F.min(F.dayofmonth(day)) == F.max(F.dayofmonth(day))).alias("same_day"),
        F.bool_and(day == F.last_day(day)).alias("month_end"),
        (F.min(month_day) == F.max(month_day)).alias("same_month_day"),
        F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))
    columns = columns.withColumn("mixed", F.coalesce(F.col("z0") != F.col("z1"), F.lit(False))).withColumn(
        "monthly", F.col("same_time") & (F.col("same_day") | F.col("month_end"))).withColumn(
        "yearly", F.col("same_time") & F.col("same_month_day"))
    usable = columns.where(
        ~F.col("mixed") & (F.col("observed") >= min_observations) & (F.col("d") >= 2))
    # One row per column.
    placed = distinct.where(F.col("known") > 0).select("column_name", "micros").join(
        F.broadcast(usable.select("column_name", "d", "monthly", "yearly")), "column_name")
    series = placed.select("column_name", F.inline(F.filter(F.array(
        F.struct(F.lit(FIXED).alias("kind"), F.col("micros").alias("idx")),
        F.when(F.col("yearly"), F.struct(F.lit(YEARLY).alias("kind"), F.year(day).cast("bigint").alias("idx"))),
        F.when(F.col("monthly"), F.struct(F.lit(MONTHLY).alias("kind"), (
            F.year(day) * 12 + F.month(day) - 1).cast("bigint").alias("idx")))), lambda s: s.isNotNull())))
    facts = progression(series, ["column_name", "kind"], F.col("kind") != FIXED)

    duplicates = F.col("observed") - F.col("d")
    # The columns table has one row per column, so this side is small as well.
    tried = facts.join(columns, "column_name")
    fixed = F.col("kind") == FIXED
    consistency = F.col("supporting") / F.col("transitions")
    support = F.when(fixed, F.col("supporting")).otherwise(F.col("d"))
    is_gap = F.col("gap_count") == 1
    at = F.when(is_gap, F.col("gap")).otherwise(F.col("hi") + F.col("step"))
    last_day_text = _day_of(F.col("last_micros"))
    year_text = F.lpad(at.cast("string"), 4, "0")
    year_day = F.concat(year_text, F.date_format(last_day_text, "-MM-dd")).try_cast("date")
    month_start = F.concat(F.lpad(int_div(at, F.lit(12)).cast("string"), 4, "0"), F.lit("-"),
                           F.lpad((at % 12 + 1).cast("string"), 2, "0"), F.lit("-01")).try_cast("date")
    first_day = F.dayofmonth(_day_of(F.col("first_micros")))
    wanted_day = F.when(F.col("month_end"), F.dayofmonth(F.last_day(month_start))).otherwise(
        F.least(first_day, F.dayofmonth(F.last_day(month_start))))
    month_day_found = F.date_add(month_start, wanted_day - 1)
    found_day = F.when(fixed, _day_of(at)).when(F.col("kind") == YEARLY, year_day).otherwise(month_day_found)
    at_tod = at % F.lit(_DAY)
    found_tod = F.when(fixed, F.when(at_tod < 0, at_tod + F.lit(_DAY)).otherwise(at_tod)).otherwise(F.col("tod"))
    verdict = (
        F.when(fixed & (consistency < MIN_CONSISTENCY), NO_RELATIONSHIP)
        .when(~fixed & (support < min_support), AMBIGUOUS)
        .when((F.col("gap_count") == 0) & (duplicates == 0), NO_RELATIONSHIP)
        .when((F.col("gap_count") > 1) | (duplicates > 1), AMBIGUOUS)
        .when(support < min_support, AMBIGUOUS)
        .when(found_day.isNull(), AMBIGUOUS).otherwise(CANDIDATE))
    rank = F.when(fixed, 1).when(F.col("kind") == YEARLY, 2).otherwise(3)
    judged = tried.select(
        "column_name", "kind", rank.alias("rank"), verdict.alias("verdict"), "step", "gap_count",
        support.alias("support"),
        F.when(fixed, F.col("transitions") - F.col("supporting")).otherwise(F.lit(0)).alias("against"),
        F.when(fixed, consistency).otherwise(F.lit(1.0)).alias("consistency"),
        F.when(is_gap, "TEMPORAL_GAP").otherwise("TEMPORAL_NEXT_VALUE").alias("strategy"),
        _iso(found_day, found_tod, F.col("is_date"), F.col("z0")).alias("value"))
    # At most three attempts per column: the first that is a candidate wins.
    picked = judged.groupBy("column_name").agg(
        F.min(F.when(F.col("verdict") == CANDIDATE, F.struct(
            "rank", "kind", "step", "gap_count", "support", "against", "consistency", "strategy", "value"))).alias("win"),
        F.max(F.when(F.col("rank") == 1, F.col("verdict"))).alias("fixed_verdict"))
    out = columns.join(picked, "column_name", "left")
    status = (
        F.when(F.col("mixed"), AMBIGUOUS).when(F.col("observed") < min_observations, INSUFFICIENT)
        .when(F.col("win").isNotNull(), CANDIDATE).otherwise(F.coalesce("fixed_verdict", F.lit(NO_RELATIONSHIP))))
    best = F.col("status") == CANDIDATE
    unit = (F.when(F.col("win.kind") == YEARLY, " calendar year(s)")
            .when(F.col("win.kind") == MONTHLY, F.concat(F.lit(" calendar month(s) ("), F.when(
                F.col("month_end"), "end-of-month").otherwise("same day-of-month"), F.lit(")")))
            .otherwise(" microseconds"))
    return out.withColumn("status", status).select(
        "column_name", "status",
        F.when(F.col("mixed"), F.lit(0)).otherwise(F.col("observed")).cast("bigint").alias("observed_values_count"),
        F.when(best, F.col("win.strategy")).alias("strategy"),
        F.when(best, F.col("win.kind")).alias("progression_type"),
        F.when(best, F.col("win.value")).alias("candidate_value"),
        F.when(best, F.concat(F.col("win.step").cast("string"), unit)).alias("step_interval"),
        F.when(best, F.col("win.gap_count")).alias("gap_count"), F.when(best, duplicates).alias("duplicate_count"),
        F.when(best, F.col("win.support")).alias("supporting_count"),
        F.when(best, F.col("win.against")).alias("contradicting_count"),
        F.when(best, F.col("win.consistency")).alias("consistency"),
        F.when(best, F.least(F.lit(1.0), F.col("d") / F.lit(2.0 * min_support))).alias("confidence"))
