"""Order within keys of any size.

The rows of one key are cut into ranges of about equal size, whose borders are quantiles drawn from a sketch. Only the
``HOT_KEYS`` most frequent keys get borders (no other key can hold more than rows / HOT_KEYS rows), so
the borders, and whatever is carried from one range to the next, are tables of bounded size.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbrule.functions.grouping import HOT_KEYS

#: Ranges of a series: so many groups of so many. Straight-line comparisons with the borders compile, while a
#: lambda over an array of them would be interpreted.
COARSE, FINE = 16, 16
#: A key with fewer rows is one range.
SPLIT_ROWS = 100_000


def border_shares() -> Column:
    ranges = COARSE * FINE
    return F.array(*[F.lit(i / ranges) for i in range(1, ranges)])


def with_range(df: DataFrame, borders: str, value: str, out: str) -> DataFrame:
    """Add the number of borders (an array column) below ``value``; 0 where there are none."""
    def above(places: Sequence[Column]) -> Column:
        return reduce(add, [F.when(F.get(borders, p) < F.col(value), 1).otherwise(0) for p in places])

    coarse = df.withColumn("_coarse", above([F.lit(k * FINE - 1) for k in range(1, COARSE)]))
    fine = above([F.col("_coarse") * FINE + k for k in range(FINE - 1)])
    return coarse.withColumn(out, F.col("_coarse") * FINE + fine).drop("_coarse", borders)


def hot_borders(rows: DataFrame, by: str, at: str) -> DataFrame:
    """(by, _borders): quantiles of ``at`` of the keys that are worth splitting."""
    hot = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > SPLIT_ROWS).orderBy(F.desc("_n")).limit(HOT_KEYS).select(by)
    ranges = COARSE * FINE
    return rows.join(F.broadcast(hot), by).groupBy(by).agg(F.percentile_approx(at, border_shares(), 10 * ranges).alias("_borders"))


def with_key_range(df: DataFrame, borders: DataFrame, by: str, at: str, out: str) -> DataFrame:
    """Add the range of a row's key that ``at`` falls into. At most HOT_KEYS rows of borders are broadcast."""
    return with_range(df.join(F.broadcast(borders), by, "left"), "_borders", at, out)


def number_in_group(df: DataFrame, by: str, time: str, tie: str, out: str, total: str) -> DataFrame:
    """Number rows per ``by`` in the order of (``time``, ``tie``), from 1, and add the group's size.

    Rows are ordered within a range of their group; the count of the ranges before it comes from a table with at most
    HOT_KEYS x 256 rows.
    """
    borders = hot_borders(df.select(F.col(by).alias("_by"), F.col(time).alias("_at")), "_by", "_at")
    keyed = df.withColumn("_by", F.col(by)).withColumn("_at", F.col(time))
    placed = with_key_range(keyed, borders, "_by", "_at", "_range")
    ranges = placed.join(F.broadcast(borders.select("_by")), "_by").groupBy("_by", "_range").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy("_by").orderBy("_range")
    before = ranges.select("_by", "_range", (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(W.partitionBy("_by")).alias("_all"))
    one = W.partitionBy("_by", "_range")
    # Numbered first: the carried counts do not depend on the order of rows.
    numbered = placed.select(
        "*", F.row_number().over(one.orderBy(time, tie)).alias("_inside"), F.count(F.lit(1)).over(one).alias("_own"))
    return numbered.join(F.broadcast(before), ["_by", "_range"], "left").select(
        *df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).alias(out), F.coalesce("_all", "_own").alias(total))


def latest_as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, right_id: str,
                 out: str = "matched_id") -> DataFrame:
    """For each left row the newest right row of the same ``by`` at or before its time.

    No pairs are formed. Both sides are merged on one time line. A frequent key's line is cut into ranges of about equal
    size; each begins with the newest right row of the ranges before it. Equal times prefer the larger id.
    """
    r = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.col(right_id).alias("_id")).where(
        F.col("_by").isNotNull() & F.col("_t").isNotNull())
    times = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_t")).unionByName(r.select("_by", "_t"))
    borders = hot_borders(times.where(F.col("_t").isNotNull()), "_by", "_t")
    hit_type = T.StructType([r.schema["_t"], r.schema["_id"]])
    asked = with_key_range(left.select(
        F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.lit(2).alias("_kind"), F.lit(None).cast(hit_type).alias("_m"),
        F.struct(*left.columns).alias("_row")), borders, "_by", "_t", "_range")
    empty_row = F.lit(None).cast(left.schema)
    known = with_key_range(r.select(
        "_by", "_t", F.lit(1).alias("_kind"), F.struct("_t", "_id").alias("_m"), empty_row.alias("_row")), borders, "_by", "_t", "_range")
    # The newest row of each range of a split key, then of all ranges before: at most HOT_KEYS x 256 rows.
    newest = known.join(F.broadcast(borders.select("_by")), "_by").groupBy("_by", "_range").agg(F.max("_m").alias("_m"))
    ranges = borders.select("_by", F.explode(F.sequence(F.lit(0), F.lit(COARSE * FINE - 1))).alias("_range"))
    before = W.partitionBy("_by").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ranges.join(F.broadcast(newest), ["_by", "_range"], "left").select(
        "_by", "_range", F.last("_m", ignorenulls=True).over(before).alias("_carried"))
    order = W.partitionBy("_by", "_range").orderBy("_t", "_kind", F.col("_m._id").asc_nulls_first())
    matched = asked.unionByName(known).withColumn("_hit", F.last("_m", ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("_kind") == 2)
    found = matched.join(F.broadcast(carried), ["_by", "_range"], "left")
    usable = F.col("_by").isNotNull() & F.col("_t").isNotNull()
    return found.select("_row.*", F.when(usable, F.coalesce("_hit", "_carried")["_id"]).alias(out))
