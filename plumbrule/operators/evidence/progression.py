"""Regular steps in sorted distinct values, shared by sequence and temporal evidence."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbrule.functions.ordered import COARSE, FINE, border_shares, with_range
from plumbrule.functions.text import int_div

# Acceptance limits.
MIN_OBSERVATIONS = 5
MIN_SUPPORT = 3
MIN_CONSISTENCY = 0.5

def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) pairs as text, blank values left out."""
    from plumbrule.functions.text import canonical_of, is_blank

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), canonical_of(df.schema, c).alias("value"))
                      for c in columns])
    return df.select(F.inline(cells)).where(~is_blank(F.col("value")))


def steps(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, diff): the difference of each ``idx`` to the next smaller one of its series.

    A series is ordered in ranges of about equal size, whose borders come from a sketch. The first value of a
    range follows the largest one of the range before it, which is carried over from a table with one row per range.
    ``keys`` name a series; there are few of them (columns and kinds of step).
    """
    keys = list(keys)
    ranges = COARSE * FINE
    borders = values.groupBy(*keys).agg(F.percentile_approx("idx", border_shares(), 10 * ranges).alias("_borders"))
    # One row per series, of bounded width.
    placed = with_range(values.join(F.broadcast(borders), keys).select(*keys, "idx", "_borders"), "_borders", "idx", "_range")
    ends = placed.groupBy(*keys, "_range").agg(F.max("idx").alias("_last"))
    # At most COARSE * FINE rows per series.
    carried = ends.select(*keys, "_range", F.lag("_last").over(W.partitionBy(*keys).orderBy("_range")).alias("_before"))
    before = F.lag("idx").over(W.partitionBy(*keys, "_range").orderBy("idx"))
    return placed.withColumn("_lag", before).join(F.broadcast(carried), [*keys, "_range"]).select(
        *keys, F.col("idx").alias("at"), (F.col("idx") - F.coalesce("_lag", "_before")).alias("diff")).where(
            F.col("diff").isNotNull())


def progression(values: DataFrame, keys: Sequence[str], overshoot: Column) -> DataFrame:
    """Step and gap facts per series of distinct ``idx`` values.

    ``overshoot``: a range that is not a whole number of steps gets one slot
    above its maximum. A single gap is found by arithmetic: the sum of all
    slot positions minus the sum of the present ones.
    """
    keys = list(keys)
    # The most frequent difference; on a tie the one that occurs first.
    modal = (
        steps(values, keys).groupBy(*keys, "diff")
        .agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"))
        .groupBy(*keys).agg(F.max_by("diff", F.struct("c", -F.col("at"))).alias("step"),
                            F.max("c").alias("supporting"), F.sum("c").alias("transitions")))
    ends = values.groupBy(*keys).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"),
                                     F.count(F.lit(1)).alias("distinct_values"))
    facts = ends.join(modal, keys).withColumn("span", F.col("hi") - F.col("lo"))
    whole = F.col("span") % F.col("step") == 0
    facts = facts.withColumn(
        "slots", int_div(F.col("span"), F.col("step")) + 1 + F.when(overshoot & ~whole, 1).otherwise(0))
    offset = F.col("idx") - F.col("lo")
    on_grid = offset % F.col("step") == 0
    filled = values.join(facts.select(*keys, "lo", "step", "slots"), keys).groupBy(*keys).agg(
        F.count_if(on_grid).alias("present"),
        F.sum(F.when(on_grid, int_div(offset, F.col("step")).cast("decimal(20,0)"))).alias("present_sum"))
    out = facts.join(filled, keys).withColumn("gap_count", F.col("slots") - F.col("present"))
    # As decimals: the sum of the slots of a wide range does not fit a bigint. The even factor is halved.
    slots = F.col("slots")
    even = slots % 2 == 0
    half = F.when(even, int_div(slots, F.lit(2))).otherwise(slots).cast("decimal(19,0)")
    rest = F.when(even, slots - 1).otherwise(int_div(slots - 1, F.lit(2))).cast("decimal(19,0)")
    missing = (half * rest - F.col("present_sum")).cast("decimal(38,0)").cast("bigint")
    return out.withColumn("gap", F.when(F.col("gap_count") == 1, F.col("lo") + F.when(
        F.col("gap_count") == 1, missing) * F.col("step")))
