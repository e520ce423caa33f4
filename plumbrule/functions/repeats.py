"""Repeated keys of several rules at once.

Keys travel as two 64-bit hashes of their native values (no text is formed), in long form
(rule, hashes): one shuffle with map-side combining counts the keys of all rules. Of these only the
repeated ones matter further. While they are few they are broadcast after being counted, and no row
is shuffled at all. Where they are many, the rows of a single rule pass a broadcast filter of bits of the repeated keys and,
where rows with a key of their own are few, one of bits of their keys; only rows that both let through are shuffled, once.
With more rules, one exchange of (rule, hashes) finds the rows that hold repeated keys for all rules together, and the
verdicts are looked up by row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbrule.functions.grouping import HOT_KEYS, lookup
from plumbrule.functions.storage import written
from plumbrule.functions.text import canonical_of

#: Repeated keys that are broadcast, at 24 bytes each.
BROADCAST_KEYS = 250_000
#: Broadcast words of 64 bits that tell most rows with and without a repeated key apart.
FILTER_WORDS = 1 << 19
_SALTS = 1 << 16
#: Types of at most 8 bytes. Each step of the hash of such a value can be undone, so different values have different hashes.
_SHORT = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
          T.TimestampType, T.TimestampNTZType)


def key_hashes(schema: T.StructType, names: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of the values, NULL for a single NULL column; in wider keys NULL is a value.

    Where the first hash tells all values of a column apart the second is 0, which takes next to no room in a shuffle.
    """
    def native(name: str) -> Column:
        kind = schema[name].dataType
        return canonical_of(schema, name) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.col(name)

    values = [native(n) for n in names]
    if len(names) == 1:
        enough = isinstance(schema[names[0]].dataType, _SHORT)
        second = F.lit(0).cast("bigint") if enough else F.xxhash64(F.lit(1), values[0])
        return tuple(F.when(values[0].isNotNull(), h) for h in (F.xxhash64(values[0]), second))
    # A hash skips NULL, so their places are hashed as well.
    gaps = [F.isnull(n) for n in names if schema[n].nullable]
    return F.xxhash64(*values, *gaps), F.xxhash64(F.lit(1), *values, *gaps)


def _long(df: DataFrame, keys: Mapping[int, Sequence[str]], hashes: Callable[..., tuple[Column, Column]] = key_hashes) -> DataFrame:
    cells = []
    for ordinal, names in keys.items():
        one, two = hashes(df.schema, names)
        cells.append(F.struct(F.lit(ordinal).alias("o"), one.alias("k1"), two.alias("k2")))
    return df.select(F.inline(F.array(*cells)))


def key_counts(df: DataFrame, keys: Mapping[int, Sequence[str]]) -> DataFrame:
    """(o, k1, k2, n): how many rows hold each key of each rule; NULL keys are counted with NULL hashes."""
    return _long(df, keys).groupBy("o", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))


def complete_hashes(schema: T.StructType, names: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of the values, NULL where any of them is."""
    whole = reduce(and_, [F.col(n).isNotNull() for n in names])
    return tuple(F.when(whole, h) for h in key_hashes(schema, names))


def complete_keys(df: DataFrame, keys: Mapping[int, Sequence[str]]) -> DataFrame:
    """(o, k1, k2): the keys without a NULL of each rule, in long form."""
    return _long(df, keys, complete_hashes).where(F.col("k1").isNotNull())


def complete_counts(df: DataFrame, repeating: Mapping[int, Sequence[str]], mostly_unique: Mapping[int, Sequence[str]]) -> DataFrame:
    """(o, k1, k2, n) of keys without a NULL.

    Keys that repeat are combined before the shuffle. Where hardly any does, combining would fill (and spill) a task's
    memory and save nothing, so those are dealt first and counted once.
    """
    parts = []
    if repeating:
        parts.append(complete_keys(df, repeating))
    if mostly_unique:
        parts.append(complete_keys(df, mostly_unique).repartition("o", "k1", "k2"))
    return reduce(DataFrame.unionByName, [p.groupBy("o", "k1", "k2").agg(F.count(F.lit(1)).alias("n")) for p in parts])


def repeated_keys(df: DataFrame, keys: Mapping[int, Sequence[str]]) -> DataFrame:
    """The keys that two rows or more hold, written so that they are found once."""
    counted = key_counts(df, keys)
    return written(counted.where((F.col("n") > 1) & F.col("k1").isNotNull()))


def mark_repeated(rows: DataFrame, repeated: DataFrame, ordinals: Sequence[int], content: Sequence[str]) -> DataFrame:
    """Add ``_repeats``: the rules whose key (``_a<rule>``, ``_b<rule>``) is among the repeated ones.

    ``content`` names columns that tell rows apart; rows that agree in them agree in their keys.
    """
    if repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked, found = rows, []
        for o in ordinals:
            # Counted above.
            keys = F.broadcast(repeated.where(F.col("o") == o).select(
                F.col("k1").alias(f"_a{o}"), F.col("k2").alias(f"_b{o}"), F.lit(o).alias(f"_found{o}")))
            marked = marked.join(keys, [f"_a{o}", f"_b{o}"], "left")
            found.append(F.col(f"_found{o}"))
        return marked.withColumn("_repeats", F.array_compact(F.array(*found))).drop(
            *[f"_{x}{o}" for o in ordinals for x in ("a", "b", "found")])
    if len(ordinals) == 1:
        return _mark_one(rows, repeated, ordinals[0], content)
    placed = rows.withColumn("_row", F.struct(
        F.xxhash64(*content).alias("p1"), F.xxhash64(F.lit(1), *content).alias("p2"))).withColumn(
        # Equal rows are spread by the partition they come from.
        "_deal", F.xxhash64("_row", F.spark_partition_id()))
    entries = placed.select("_row", "_deal", F.inline(F.array(*[
        F.struct(F.lit(o).alias("o"), F.col(f"_a{o}").alias("k1"), F.col(f"_b{o}").alias("k2")) for o in ordinals])))
    hot = repeated.orderBy(F.desc("n")).limit(HOT_KEYS).select("o", "k1", "k2", F.lit(True).alias("_hot"))
    cold = repeated.select("o", "k1", "k2", F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias("_cold"))
    held = (
        entries.join(F.broadcast(hot), ["o", "k1", "k2"], "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col("k1").isNull(), F.pmod("_deal", F.lit(_SALTS)) + 1).otherwise(
            F.lit(0).cast("bigint")))
        .join(cold, ["o", "k1", "k2", "_salt"], "left").where(F.col("_hot") | F.col("_cold")))
    verdicts = held.groupBy("_row").agg(F.sort_array(F.collect_set("o")).alias("_repeats"))
    # At most one entry per rule in a verdict.
    return lookup(placed.drop(*[f"_{x}{o}" for o in ordinals for x in ("a", "b")]), verdicts, "_row", "_deal",
                  counted_from=placed).withColumn("_repeats", F.coalesce("_repeats", F.array().cast("array<int>"))).drop("_row", "_deal")


def _mark_one(rows: DataFrame, repeated: DataFrame, o: int, content: Sequence[str]) -> DataFrame:
    """:func:`mark_repeated` for one rule with many repeated keys.

    Without a row that has a key of its own, every key is a repeated one. Else the repeated keys set bits of at most
    ``FILTER_WORDS`` broadcast words, and single keys set others where they are few enough to leave most of those bits clear.
    A row whose bit is set by one kind only is of that kind and stays where it is; the others are shuffled once, by key, to
    the repeated keys. Fuller words only let more rows through.
    """
    one, two = f"_a{o}", f"_b{o}"
    mine = repeated.where(F.col("o") == o)
    none = F.array().cast("array<int>")
    again = mine.agg(F.sum("n")).first()[0] or 0
    single = rows.agg(F.count(one)).first()[0] - again
    if single == 0:
        return rows.withColumn("_repeats", F.when(F.col(one).isNotNull(), F.array(F.lit(o))).otherwise(none)).drop(one, two)

    def word(k: str) -> Column:
        return F.pmod(k, F.lit(FILTER_WORDS))

    def place(k: str) -> Column:
        return F.pmod(F.shiftright(k, 32), F.lit(64)).cast("int")

    def is_set(bits: str, k: str) -> Column:
        return F.call_function("shiftrightunsigned", F.col(bits), place(k)).bitwiseAND(F.lit(1)) == 1

    # Counting the single keys again shuffles keys, so it has to spare more rows than it counts in vain.
    known = single <= min(32 * FILTER_WORDS, again)
    keys = mine.select("k1", F.lit(True).alias("_many"))
    if known:
        keys = keys.unionByName(rows.where(F.col(one).isNotNull()).groupBy(one, two).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
                                .select(F.col(one).alias("k1"), F.lit(False).alias("_many")))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), place("k1"))
    words = F.broadcast(written(keys.groupBy(word("k1").alias("_word")).agg(
        F.coalesce(F.bit_or(F.when(F.col("_many"), mask)), F.lit(0)).alias("_manys"),
        F.coalesce(F.bit_or(F.when(~F.col("_many"), mask)), F.lit(0 if known else -1)).cast("bigint").alias("_ones"))))
    unsure = is_set("_manys", one) & is_set("_ones", one)
    stays = rows.join(words, word(one) == F.col("_word"), "left").where(~F.coalesce(unsure, F.lit(False))).withColumn(
        "_repeats", F.when(is_set("_manys", one), F.array(F.lit(o))).otherwise(none))
    renamed = [F.col("k1").alias(one), F.col("k2").alias(two)]
    hot = mine.orderBy(F.desc("n")).limit(HOT_KEYS).select(*renamed, F.lit(True).alias("_hot"))
    cold = mine.select(*renamed, F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias("_cold")).join(
        words, (word(one) == F.col("_word")) & unsure, "left_semi")
    held = (
        rows.join(words, (word(one) == F.col("_word")) & unsure, "left_semi").join(F.broadcast(hot), [one, two], "left")
        # Equal rows are spread by the partition they come from.
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(_SALTS)) + 1)
                    .otherwise(F.lit(0).cast("bigint")))
        .join(cold, [one, two, "_salt"], "left")
        .withColumn("_repeats", F.when(F.col("_hot") | F.col("_cold"), F.array(F.lit(o))).otherwise(none)))
    return stays.drop(one, two, "_word", "_manys", "_ones").unionByName(held.drop(one, two, "_hot", "_cold", "_salt"))
