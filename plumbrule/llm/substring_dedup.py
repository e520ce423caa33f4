"""Repeated passages, by rolling hashes of all windows of words.

Documents are dealt by ranges of their ids into parts of about ``PART_BYTES`` of text; the borders
are quantiles of the ids, weighted by the length of texts. Each part hashes every window of
``width`` words (Rabin-Karp, 64 bits) and sends its distinct hashes, cut into buckets by value and
sorted, as blobs. A bucket tells each part which of its hashes an earlier part holds as well: a bit
each. With these bits and its own windows a part knows the windows that start earlier elsewhere,
merges them into maximal removal intervals, and cuts them out. So a passage that every document
holds is one hash per part, not one per document, and no pairs of documents are formed.

Two different windows share a hash with a probability of 2**-64; among n distinct windows
n**2 / 2**65 such pairs are expected (0.0005 for 130 million).

Defined results: windows are ordered by (id, start); rows without an id come last; rows that share
an id are ordered by a digest of their text, and repeated rows stand one after another, so the
first of them keeps its words; if one id holds more text than a part, its rows are dealt to several.
Null and empty texts have no words; a text of fewer than ``width`` words has no window; words longer
than a part are still one word; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions.storage import written
from plumbrule.llm import words

WIDTH = 20
#: Text of a part, which one task holds; its hashes need about as much again.
PART_BYTES = 4 << 20
#: Parts whose borders the driver and each task may hold (8 MB); of more text, parts are larger.
MOST_PARTS = 1 << 20
#: Text whose windows share a bucket: about two million windows, sorted by one task.
BUCKET_BYTES = 16 << 20
#: A text weighs one, and one more for so many bytes, when borders of parts are drawn.
WEIGHT_BYTES = 4096
_LAST = (1 << 63) - 1


def _quantiles(n: int) -> Column:
    """The n - 1 values that cut weighted ids into n shares."""
    return F.percentile_approx("_id", [k / n for k in range(1, n)], 20 * n)


def part_borders(rows: DataFrame, parts: int) -> list[int]:
    """Upper ends of all parts but the last, in order. An id repeats where its rows fill several parts.

    Found in two steps, so that no aggregate holds more than the root of their number.
    """
    if parts < 2:
        return []
    many = F.array_repeat(F.lit(0), (F.col("_size") / WEIGHT_BYTES).cast("int") + 1)
    weighted = rows.select("_id", F.explode(many)).select("_id")
    first = math.ceil(math.sqrt(parts))
    if first < 8:
        return sorted(weighted.agg(_quantiles(parts).alias("b")).first()["b"])
    outer = sorted(weighted.agg(_quantiles(first).alias("b")).first()["b"])
    ranged = weighted.withColumn("_range", _placed(outer)(F.col("_id"), F.lit(0)))
    inner = ranged.groupBy("_range").agg(_quantiles(math.ceil(parts / first)).alias("b")).collect()
    return sorted([*outer, *(x for r in inner for x in r["b"])])


def _placed(borders: list[int]):
    """The part of an id; rows of an id that fills several parts are dealt to them by the digest of their text."""
    ends = np.array(borders, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, digests: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        low, high = np.searchsorted(ends, x, "left"), np.searchsorted(ends, x, "right")
        return pd.Series((low + digests.to_numpy() % np.maximum(high - low, 1)).astype(np.int32))

    return place


class _Part:
    """The texts of a part in order, and their windows."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.rows = table.select(["_id", "_null", "_digest", "_text"]).sort_by([("_null", "ascending"), ("_id", "ascending"), ("_digest", "ascending")])
        self.data, self.offsets = words.buffers(self.rows.column("_text"))
        self.width = width

    def chunks(self):
        """(first text, last text, words) of bounded runs of texts."""
        for a, b in words.chunks(self.offsets):
            yield a, b, words.cut(self.data, self.offsets[a:b + 1], words.SPACED, words.UNCHANGED)

    def starts(self, cut: words.Words) -> np.ndarray:
        """Numbers of the words at which a window starts."""
        n = len(cut.start)
        ends = np.repeat(cut.first[1:], np.diff(cut.first))
        return np.flatnonzero(np.arange(n) + self.width <= ends)

    def windows(self, cut: words.Words) -> np.ndarray:
        return words.rolling(cut.hash, self.width)[self.starts(cut)]

    def hashes(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.windows(cut) for _, _, cut in self.chunks())])


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _hashed(width: int, buckets: int):
    def hashed(table: pa.Table) -> pa.Table:
        found = np.unique(_Part(table, width).hashes())
        bounds = _bounds(found, buckets)
        some = np.flatnonzero(np.diff(bounds))
        return pa.table({
            "_bucket": pa.array(some, pa.int32()), "_part": pa.array([table.column("_part")[0].as_py()] * len(some), pa.int32()),
            "_hashes": pa.array([_packed(found[bounds[b]:bounds[b + 1]]) for b in some], pa.binary())})

    return hashed


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the differences between them, in as few bytes each as the largest one needs."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    size = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + hashes[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    size = blob[0]
    rest = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, size)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    steps[1:, :size] = rest
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _earlier(table: pa.Table) -> pa.Table:
    """Of one bucket: for each part a bit per hash, set if an earlier part holds it; parts without such a bit are left out."""
    table = table.sort_by("_part")
    parts = table.column("_part").to_pylist()
    blobs = [_unpacked(x) for x in table.column("_hashes").to_pylist()]
    found = np.concatenate(blobs)
    order = np.argsort(found, kind="stable")
    again = np.zeros(len(found), bool)
    again[order[1:]] = found[order[1:]] == found[order[:-1]]
    bounds = np.cumsum([0, *map(len, blobs)])
    some = [k for k in range(len(parts)) if again[bounds[k]:bounds[k + 1]].any()]
    return pa.table({
        "_part": pa.array([parts[k] for k in some], pa.int32()),
        "_bucket": pa.array([table.column("_bucket")[0].as_py()] * len(some), pa.int32()),
        "_bits": pa.array([np.packbits(again[bounds[k]:bounds[k + 1]]).tobytes() for k in some], pa.binary())})


def _spans(covered: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal runs of covered words of each text, as (from, to) within the text."""
    n = len(covered)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], covered[:-1]]) & ~edge[:n]
    after = np.concatenate([covered[1:], [False]]) & ~edge[1:]
    begin, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    text = np.searchsorted(first, begin, "right") - 1
    counts = np.bincount(text, minlength=len(first) - 1)
    pairs = pa.StructArray.from_arrays([pa.array(begin - first[text]), pa.array(end - first[text])], names=["from", "to"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pairs)


def _kept(data: np.ndarray, offsets: np.ndarray, cut: words.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    base, stop = int(offsets[0]), int(offsets[-1])
    last = np.zeros(len(keep), bool)
    kept = np.flatnonzero(keep)
    text = np.searchsorted(cut.first, kept, "right") - 1
    last[kept[np.flatnonzero(np.diff(text, append=-1))]] = True
    out = data[base:stop].copy()
    spaced = keep & ~last
    out[cut.end[spaced] - base] = 0x20
    step = np.zeros(stop - base + 2, np.int32)
    np.add.at(step, cut.start[keep] - base, 1)
    np.add.at(step, cut.end[keep] - base + spaced[keep], -1)
    inside = np.cumsum(step[:-1]) > 0
    counts = np.concatenate([[0], np.cumsum(inside[:stop - base])])
    texts = out[inside[:stop - base]]
    ends = counts[(offsets - base).astype(np.int64)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(texts)]).cast(pa.string())


_OUT = "_id bigint, _n_words bigint, _n_removed bigint, _spans array<struct<from: bigint, to: bigint>>, _kept string"


def _removed(width: int, buckets: int):
    def removed(table: pa.Table, bits: pa.Table) -> pa.Table:
        part = _Part(table, width)
        hashes = part.hashes()
        distinct, place, own = np.unique(hashes, return_index=True, return_inverse=True)
        earlier = np.zeros(len(distinct), bool)
        bounds = _bounds(distinct, buckets)
        for b, flags in zip(bits.column("_bucket").to_pylist(), bits.column("_bits").to_pylist(), strict=True):
            size = int(bounds[b + 1] - bounds[b])
            earlier[bounds[b]:bounds[b + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=size).astype(bool)
        again = earlier[own] | (place[own] != np.arange(len(hashes)))
        at, out = 0, []
        for a, b, cut in part.chunks():
            starts = part.starts(cut)
            starts, at = starts[again[at:at + len(starts)]], at + len(starts)
            step = np.zeros(len(cut.start) + 1, np.int32)
            step[starts] += 1
            step[starts + width] -= 1
            covered = np.cumsum(step[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(covered)])
            rows = part.rows.slice(a, b - a)
            ids, null = rows.column("_id").combine_chunks(), rows.column("_null").to_numpy()
            out.append(pa.table({
                "_id": pa.array(ids.to_numpy(), pa.int64(), mask=null),
                "_n_words": pa.array(np.diff(cut.first)), "_n_removed": pa.array(np.diff(sums[cut.first])),
                "_spans": _spans(covered, cut.first),
                "_kept": _kept(part.data, part.offsets[a:b + 1], cut, ~covered)}))
        return pa.concat_tables(out)

    return removed


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """_id, _n_words, _n_removed, _spans (maximal removal intervals, in words), _kept (the words that stay): a row per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("_id"), F.col(id_col).isNull().alias("_null"),
        F.xxhash64(text).alias("_digest"), text.alias("_text"))
    sizes = written(rows.select("_id", F.octet_length("_text").alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    borders = part_borders(sizes, min(max(1, math.ceil(total / PART_BYTES)), MOST_PARTS))
    # Both uses of the dealt rows share one exchange.
    dealt = rows.withColumn("_part", _placed(borders)("_id", "_digest")).repartition("_part")
    hashes = dealt.groupBy("_part").applyInArrow(_hashed(width, buckets), "_bucket int, _part int, _hashes binary")
    earlier = hashes.groupBy("_bucket").applyInArrow(_earlier, "_part int, _bucket int, _bits binary")
    return dealt.groupBy("_part").cogroup(earlier.groupBy("_part")).applyInArrow(_removed(width, buckets), _OUT)


#: The result of the registered query, by the text of windows in place of hashes.
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + {WIDTH - 1}), ' ') AS win
  FROM cut, unnest(range(1, len(w) - {WIDTH - 2})) AS t(pos)),
heads AS (
  SELECT win, min(row(doc_id, pos)) AS head FROM windows GROUP BY win HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, pos + step AS pos
  FROM windows JOIN heads USING (win), unnest(range({WIDTH})) AS t(step) WHERE head < row(doc_id, pos)),
words AS (
  SELECT doc_id, pos, w[pos] AS word FROM cut, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)"""
