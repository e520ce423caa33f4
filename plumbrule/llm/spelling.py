"""Spelling variants by a bit-sliced position index.

For every (position, letter) a bitset over the vocabulary tells which words have that letter there.
A query word is read letter by letter; bitset operations follow at once, for 64 words an operation,
which words agree so far (no error), which differ in one replaced letter, which hold one letter more
(their positions shifted by one) and which hold one less.

The vocabulary is sharded so that near words meet: one edit leaves the first or the last
``m // 2`` letters of the shorter word (of length m) as they are, so words meet in a shard of their
common first letters or of their common last ones. Letters are hashed to as many shards as
hold about ``SHARD_LETTERS`` each. A shard that common letters make larger is cut into blocks, and
each pair of blocks is a group of its own. A pair counts in its shard of first letters if these
agree, else in that of last letters, so once. Groups return a count and the best near word of
each word, never pairs: bits are ordered by falling count and word, so the lowest set bit is the best.

Defined results: a null text has no words; a null id is written as empty text in the hashed key;
repeated rows count as often as they stand there; ties of count go to the smallest word in
code-point order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions.storage import written

MIN_LENGTH, MIN_COUNT, TIMES, ONE_IN = 7, 2, 10, 31
#: Letters of the words that one shard's index holds.
SHARD_LETTERS = 1 << 14
#: Queries that are read at once.
QUERIES = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "[A-Za-zÀ-ÿ]+"


def words_with_slips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_word: every run of letters that may become a word, with its slip of the pen."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(_RUNS), F.lit(0))
    run = F.col("_run")
    long = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("_run")).where(F.length(run) >= MIN_LENGTH)
    drawn = F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary"))
    at = F.pmod(F.col("_drawn"), F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return long.withColumn("_drawn", drawn).select(
        F.when(F.col("_drawn") % ONE_IN == 0, cut).otherwise(run).alias("_word")).where(F.length("_word") >= MIN_LENGTH)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``MIN_LENGTH`` letters that occur ``MIN_COUNT`` times or more."""
    return words_with_slips(docs, id_col, text_col).groupBy(F.col("_word").alias("word")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


_GROUP = ["_m", "_side", "_slot", "_q", "_i"]


def _grouped(words: DataFrame) -> DataFrame:
    """Every word in the groups in which near words may meet it, with its role there: asks (1), is asked for (2), or both (3)."""
    length, m = F.length("word"), F.col("_m")
    half = F.floor(m / 2).cast("int")
    letters = F.when(F.col("_side") == 0, F.substr("word", F.lit(1), half)).otherwise(F.expr("right(word, cast(_m div 2 as int))"))
    # A word of length m is the longer one of pairs with m - 1 letters, and else the shorter or an equal one.
    entries = (
        words.select("word", "n", F.explode(F.array(length, length - 1)).alias("_m"))
        .where(m >= MIN_LENGTH)
        .select("word", "n", "_m", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side")).withColumn("_letters", letters))
    by_length = words.groupBy(length.alias("_l")).agg((F.count(F.lit(1)) * F.first(length)).alias("_all"))
    # One row per length of words; k different lengths take k * k / 2 letters, so there are few even in a large vocabulary.
    shards = by_length.select(F.explode(F.array(F.col("_l"), F.col("_l") - 1)).alias("_m"), "_all").groupBy("_m").agg(
        (F.floor(F.sum("_all") / SHARD_LETTERS) + 1).alias("_shards"))
    dealt = entries.join(F.broadcast(shards), "_m").withColumn(
        "_slot", F.pmod(F.xxhash64("_letters"), F.col("_shards"))).drop("_letters", "_shards")
    blocks = dealt.groupBy("_m", "_side", "_slot").agg(
        (F.floor(F.count(F.lit(1)) * m / (4 * SHARD_LETTERS)) + 1).cast("int").alias("_blocks"))
    placed = dealt.join(blocks, ["_m", "_side", "_slot"]).withColumn("_block", F.pmod(F.xxhash64("word", F.lit(1)), F.col("_blocks")).cast("int"))
    own = placed.where("_blocks = 1").select("*", F.lit(3).alias("_role"), F.col("_block").alias("_q"), F.col("_block").alias("_i"))
    more = placed.where("_blocks > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    asks = more.select("*", F.lit(1).alias("_role"), F.col("_block").alias("_q"), F.col("_other").alias("_i"))
    asked = more.select("*", F.lit(2).alias("_role"), F.col("_other").alias("_q"), F.col("_block").alias("_i"))
    columns = [*_GROUP, "_role", "word", "n"]
    return own.select(columns).unionByName(asks.select(columns)).unionByName(asked.select(columns))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Words x positions: the letters, 0 beyond the end."""
    raw = "".join(w.ljust(width, "\0") for w in words).encode("latin-1")
    return np.frombuffer(raw, np.uint8).reshape(len(words), width)


class BitIndex:
    """Bitsets over words of lengths ``m`` and ``m + 1``, one for every (position, letter)."""

    def __init__(self, codes: np.ndarray, m: int) -> None:
        n = len(codes)
        self.m, self.parts = m, (n + 63) // 64
        self.row = np.zeros((m + 2, 256), np.int32)
        sets = [np.zeros((1, self.parts), np.uint64)]
        at = 1
        for p in range(m + 1):
            letters = np.unique(codes[:, p])
            letters = letters[letters > 0]
            sets.append(self._bits(codes[:, p][None, :] == letters[:, None]))
            self.row[p, letters] = np.arange(at, at + len(letters))
            at += len(letters)
        self.sets = np.concatenate(sets)
        longer = codes[:, m] > 0
        self.of_length = {m: self._bits(~longer[None, :])[0], m + 1: self._bits(longer[None, :])[0]}

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.parts * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, :packed.shape[1]] = packed
        return out.view(np.uint64)

    def near(self, queries: np.ndarray, length: int, first_letters: bool) -> np.ndarray:
        """For each query of ``length`` letters the bitset of words that one edit makes of it.

        Of pairs whose first ``m // 2`` letters agree, or of those where they do not.
        """
        shape = (len(queries), self.parts)
        same = np.full(shape, ~np.uint64(0))
        replaced, more, less = (np.zeros(shape, np.uint64) for _ in range(3))
        halves = same
        for i in range(length):
            here = self.sets[self.row[i, queries[:, i]]] if i <= self.m else np.uint64(0)
            if length == self.m:
                shifted = self.sets[self.row[i + 1, queries[:, i]]]
                more = (more | same) & shifted
                replaced = (replaced & here) | (same & ~here)
            else:
                shifted = self.sets[self.row[i - 1, queries[:, i]]] if i else np.uint64(0)
                less = (less & shifted) | same
            same = same & here
            if i + 1 == self.m // 2:
                halves = same
        found = (less & self.of_length[self.m]) if length > self.m else (
            (replaced & self.of_length[self.m]) | ((more | same) & self.of_length[self.m + 1]))
        return found & (halves if first_letters else ~halves)


def _lowest(sets: np.ndarray) -> np.ndarray:
    """The lowest set bit of each set."""
    part = (sets != 0).argmax(axis=1)
    x = sets[np.arange(len(sets)), part]
    return part * 64 + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))


def _near(table: pa.Table) -> pa.Table:
    """Of one group: each query word that is near others, with their number and the best of them."""
    side, m = table.column("_side")[0].as_py(), table.column("_m")[0].as_py()
    # UTF-8 and code points order alike.
    table = table.sort_by([("n", "descending"), ("word", "ascending")])
    words, n, role = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("_role").to_numpy()
    codes = _codes(words, m + 1)
    asked, members = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(members):
        index = BitIndex(codes[members], m)
        longer = codes[:, m] > 0
        for length in (m, m + 1):
            mine = asked[longer[asked] == (length > m)]
            for k in range(0, len(mine), QUERIES):
                block = mine[k:k + QUERIES]
                found = index.near(codes[block], length, side == 0)
                count = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                some = np.flatnonzero(count)
                if len(some):
                    out.append((block[some], count[some], members[_lowest(found[some])]))
    asked, count, best = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3))
    return pa.table({
        "_asked": pa.array([words[k] for k in asked], pa.string()), "_near": pa.array(count, pa.int64()),
        "_best": pa.array([words[k] for k in best], pa.string()), "_best_n": pa.array(n[best], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that are near another one."""
    met = _grouped(words).groupBy(*_GROUP).applyInArrow(_near, "_asked string, _near bigint, _best string, _best_n bigint")
    return met.groupBy(F.col("_asked").alias("word")).agg(
        F.sum("_near").alias("n_near"), F.min(F.struct((-F.col("_best_n")).alias("less"), F.col("_best").alias("w"))).alias("_b")).select(
            "word", "n_near", F.col("_b.w").alias("best"), (-F.col("_b.less")).alias("best_n"))


def _with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: the last word that forms lead to. Counts grow tenfold a step, so chains are short; each round doubles the steps."""
    at = written(forms.select("word", F.col("form").alias("_to")).where(F.col("form").isNotNull()))
    while True:
        beyond = at.select(F.col("word").alias("_to"), F.col("_to").alias("_next"))
        moved = written(at.join(beyond, "_to", "left").select("word", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_on")))
        at = moved.select("word", "_to")
        if moved.where("_on").isEmpty():
            return forms.join(at, "word", "left").withColumn("root", F.coalesce("_to", "word")).drop("_to")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word of the vocabulary."""
    words = written(vocabulary(docs, id_col, text_col))
    fits: Column = F.col("best_n") >= TIMES * F.col("n")
    forms = written(words.join(near_words(words), "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n")))
    return _with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
