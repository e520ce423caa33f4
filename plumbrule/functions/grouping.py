"""Skew-safe group lookups.

A per-key value is attached to every row without ever gathering the
rows of one key in one task. Keys are split in two:

* the ``HOT_KEYS`` most frequent keys travel as a broadcast. The broadcast is
  bounded by construction (``HOT_KEYS`` rows of fixed width);
* all other keys use a shuffled join. The first key outside the hot set has
  at most rows / HOT_KEYS rows, so no shuffle partition is dominated by a key.

Rows with a hot or NULL key still pass through the shuffled join (to keep one
output), spread evenly by a salt that no right-hand row carries.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbrule.functions.storage import written

HOT_KEYS = 1024
_SALTS = 1 << 16


def _spread(hot: Column, spread_on: Column) -> Column:
    return F.when(hot, F.pmod(F.xxhash64(spread_on), F.lit(_SALTS)) + 1).otherwise(F.lit(0).cast("bigint"))


def _content(df: DataFrame) -> Column:
    """A salt source from the row itself, the same in whatever order the rows arrive."""
    usable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*usable)


def lookup(left: DataFrame, right: DataFrame, key: str, spread_on: str,
           counted_from: DataFrame | None = None) -> DataFrame:
    """Left join where ``right`` holds at most one row per ``key``.

    The hot keys are counted on the left, where the repetition is, or in
    ``counted_from`` when ``left`` is derived from it by joins that keep its
    rows. Right rows must be of bounded width: at most ``HOT_KEYS`` of them
    are broadcast.
    """
    values = [c for c in right.columns if c != key]
    hot_keys = (
        (left if counted_from is None else counted_from).select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).orderBy(F.desc("_n")).limit(HOT_KEYS).select(key)
    )
    packed = right.select(F.col(key), F.struct(*values).alias("_rv"))
    # An inner join on the distinct hot keys: a semi join would be pushed below an aggregate on the
    # right, which would then be computed twice instead of sharing its exchange.
    hot = packed.join(F.broadcast(hot_keys), key).select(
        F.col(key).alias("_hk"), F.col("_rv").alias("_hv"))
    cold = packed.select(F.col(key).alias("_ck"), F.col("_rv").alias("_cv"),
                         F.lit(0).cast("bigint").alias("_cs"))
    split = (
        left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
        .withColumn("_gs", _spread(F.col("_hk").isNotNull() | F.col(key).isNull(), F.col(spread_on)))
    )
    joined = split.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_gs") == F.col("_cs")), "left")
    picked = F.coalesce("_hv", "_cv")
    return joined.select(*[F.col(c) for c in left.columns],
                         *[picked.getField(v).alias(v) for v in values])


SMALL_ROWS = 100_000
SMALL_BYTES = 32 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    fixed, parts = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
        else:
            fixed += 8
    return reduce(add, parts, F.lit(fixed)).cast("bigint")


def measured(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """The frame, written so that it is computed once, and whether its rows and bytes are few enough for a broadcast."""
    held = written(df)
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(_width(held)).alias("b")).first()
    return held, size["n"] <= max_rows and (size["b"] or 0) <= SMALL_BYTES


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
               max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join a configuration-sized table that has one row per key.

    It is computed and its size is checked first. Up to ``max_rows`` rows and ``SMALL_BYTES`` it is
    broadcast, so frequent keys on the left never shuffle; a larger one goes through the
    salted :func:`lookup`.
    """
    right, small = measured(right, max_rows)
    if small:
        return left.join(F.broadcast(right), keys, how)
    if how not in ("inner", "left"):
        raise ValueError("a large right side supports inner and left joins")
    values = [c for c in right.columns if c not in keys]
    # A struct with a NULL field equals another one: as in the small case a NULL key matches nothing.
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    key = F.when(whole, F.struct(*keys))
    # Callers have columns of their own that say whether something was found.
    packed = right.where(whole).select(key.alias("_jk"), *values, F.lit(True).alias("_jf"))
    joined = lookup(
        left.withColumn("_jk", key).withColumn("_pos", _content(left)),
        packed, "_jk", "_pos")
    if how == "inner":
        joined = joined.where(F.col("_jf"))
    return joined.select(*keys, *[c for c in left.columns if c not in keys], *values)


def keep_matching(df: DataFrame, refs: DataFrame, key: str, matching: bool = True,
                  max_rows: int = SMALL_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is (or is not) among ``refs``.

    A small set of references is broadcast after a size check, so the table
    does not shuffle; a larger one goes through the salted :func:`lookup`.
    """
    wanted, small = measured(refs.select(key).where(F.col(key).isNotNull()).distinct(), max_rows)
    if small:
        return df.join(F.broadcast(wanted), key, "left_semi" if matching else "left_anti")
    marked = lookup(df.withColumn("_pos", _content(df)),
                    wanted.withColumn("_there", F.lit(True)), key, "_pos")
    there = F.coalesce("_there", F.lit(False))
    return marked.where(there if matching else ~there).select(*df.columns)
