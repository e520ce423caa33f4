"""Near-duplicate embeddings by iterative quantisation.

On a bounded sample (``SAMPLE_ROWS`` distinct vectors with the smallest digests)
rotations are learned under which the vectors' signs lose little and so balance over
them. Where the collection shares a direction, most signs of plain vectors are the same
and buckets are large; signs of centred vectors balance, but differ more often between
near vectors, which takes more tables. Both are measured on the sample, with partners made
exactly at the threshold, and centred codes are taken where they save half of the
comparisons or more (:func:`coded_by`). Either way the same vectors are compared whole. The bits of a vector's code are dealt to tables; two vectors meet in a
table when they agree in all of its bits (multi-index search: codes that differ in
fewer places than there are tables agree in one). The number of bits per table grows
with the logarithm of the number of vectors, so that buckets stay small, and the
number of tables follows from it, so that a pair exactly at the threshold is
missed with a probability of at most ``MISSED``.

Every vector is indexed. What meets is compared with the original vectors in double
precision, block by block as one matrix product. A bucket of more than
``BLOCK_ROWS`` vectors is dealt into blocks, and each pair of blocks is a group of
its own, so no task holds a whole bucket. A pair is counted in the first table in
which it meets. Groups return a count and one edge per vector, never pairs.

Equal vectors are one class with a size, so copies are neither indexed nor compared.

Defined results: vectors that are null, zero, or hold null or non-finite components
link with nothing and are kept; shorter vectors count as padded with zeros; repeated
rows count as vectors of their own (their copies are links); rows without an id are
counted as others' links, have no component, and do not name one; an empty table
gives an empty result; other columns are not read. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbrule.functions.storage import cut_lineage
from plumbrule.llm.components import components

COSINE = 0.95
SAMPLE_ROWS = 4096
BLOCK_ROWS = 2048
MISSED = 0.05
#: Probability that one bit differs at the threshold: a little over the angle's share of a half turn.
BIT_DIFFERS = 0.12
#: Vectors per bucket for which the number of bits is chosen.
BUCKET_ROWS = 16
_ROUNDS = 30
#: Tables whose bits are measured, and the most tables that centred codes may take.
_MEASURED, MOST_TABLES = 8, 128


def tables_for(n: int, missed: float = MISSED, differs: float = BIT_DIFFERS) -> tuple[int, int]:
    """(tables, bits per table) for so many vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))))
    return math.ceil(math.log(missed) / math.log(1 - (1 - differs) ** bits)), bits


def learn(sample: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """A projection (dimensions x bits): one learned rotation after another until there are enough bits."""
    rng = np.random.default_rng(seed)
    parts, dims = [], sample.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        width = min(dims, 64, bits - sum(p.shape[1] for p in parts))
        start = np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :width]
        seen, turn = sample @ start, np.eye(width)
        for _ in range(_ROUNDS):
            signs = np.where(seen @ turn >= 0, 1.0, -1.0)
            u, _s, v = np.linalg.svd(signs.T @ seen)
            turn = (u @ v).T
        parts.append(start @ turn)
    return np.concatenate(parts, axis=1)


def _differing(sample: np.ndarray, centre: np.ndarray, projection: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """For each vector, the share of bits in which a vector at the threshold differs, off towards others of the sample."""
    away = sample[np.random.default_rng(seed).permutation(len(sample))] - sample.mean(axis=0)
    away -= (away * sample).sum(axis=1, keepdims=True) * sample
    away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), np.finfo(np.float64).tiny)
    partner = cosine * sample + math.sqrt(1 - cosine * cosine) * away
    return (((sample - centre) @ projection >= 0) != ((partner - centre) @ projection >= 0)).mean(axis=1)


def _compared_share(keys: np.ndarray) -> float:
    """Share of all pairs that meet in a table, averaged over the tables."""
    n = len(keys)
    counts = [np.unique(keys[:, t], return_counts=True)[1].astype(np.float64) for t in range(keys.shape[1])]
    return float(np.mean([(c * (c - 1)).sum() / (n * (n - 1)) for c in counts]))


def coded_by(sample: np.ndarray, n: int, cosine: float = COSINE) -> tuple[np.ndarray, int, int]:
    """(centre, tables, bits per table) for ``n`` vectors like those of the sample; a centre of zeros is none."""
    origin = np.zeros(sample.shape[1])
    tables, bits = tables_for(n)
    if len(sample) < 2 or not -1 < cosine < 1:
        return origin, tables, bits
    centre = sample.mean(axis=0)
    plain = learn(sample, _MEASURED * bits)
    centred = learn(sample - centre, _MEASURED * bits)
    same = 1 - _differing(sample, centre, centred, cosine)

    def needed(bits: int) -> int | None:
        return next((t for t in range(1, MOST_TABLES + 1) if ((1 - same ** bits) ** t).mean() <= MISSED), None)

    def work(tables: int, bits: int, projection: np.ndarray, centre: np.ndarray) -> float:
        used = projection[:, :_MEASURED * bits]
        share = _compared_share(keys_of(sample, used, centre @ used, _MEASURED, bits))
        return tables * (share * n + BUCKET_ROWS)

    # The longest key that few enough tables can serve.
    fewer, more = next(((b, t) for b in range(bits, 0, -1) if (t := needed(b))), (bits, None))
    if more and 2 * work(more, fewer, centred, centre) <= work(tables, bits, plain, origin):
        return centre, more, fewer
    return origin, tables, bits


def keys_of(unit: np.ndarray, projection: np.ndarray, offsets: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Rows x tables: the bits of each table as one number."""
    signs = (unit @ projection >= offsets).reshape(len(unit), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def _packed(kind: type):
    """Id, digest and components as bytes of ``kind``; null where nothing can link."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for x in batch.column(1):
                v = x.as_py()
                raw = None
                if v and None not in v:
                    a = np.array(v, kind)
                    if np.isfinite(a).all() and a.any():
                        # Trailing zeros say nothing, and -0.0 is 0.0.
                        raw = (np.trim_zeros(a, "b") + kind(0)).tobytes()
                vectors.append(raw)
                digests.append(None if raw is None else md5(raw, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                names=["_id", "_digest", "_vector"])

    return pack


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Unit vectors in double precision."""
    out = np.zeros((len(column), dims))
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_py(), kind)
        out[k, :len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(np.float64).tiny)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _compared(unit: np.ndarray, keys: np.ndarray, weight: np.ndarray, block: np.ndarray, table: int, cosine: float):
    """Links of each row and the smallest row it hangs together with, within one group of blocks."""
    n = len(unit)
    if block[0] == block[-1]:
        left, right = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    else:
        cut = int(np.searchsorted(block, block[-1]))
        left, right = np.nonzero(unit[:cut] @ unit[cut:].T >= cosine)
        right += cut
    new = ~(keys[left, :table] == keys[right, :table]).any(axis=1)
    left, right = left[new], right[new]
    count = np.bincount(left, weight[right], n) + np.bincount(right, weight[left], n)
    label, changed = np.arange(n), len(left) > 0
    while changed:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        changed = bool((label != before).any())
    return count.astype(np.int64), label


def _linker(dims: int, kind: type, projection: np.ndarray, offsets: np.ndarray, tables: int, bits: int, cosine: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive ordered by group; a group may go on in the next batch."""
        rest: pa.Table | None = None

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            group = rows.column("_group").to_numpy()
            bounds = np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(group))
            ids, weight = rows.column("_id").to_numpy(), rows.column("_n").to_numpy().astype(np.float64)
            table, block = rows.column("_table").to_numpy(), rows.column("_block").to_numpy()
            unit = _matrix(rows.column("_vector").combine_chunks(), dims, kind)
            keys = keys_of(unit, projection, offsets, tables, bits)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                count, label = _compared(unit[a:b], keys[a:b], weight[a:b], block[a:b], int(table[a]), cosine)
                some = np.flatnonzero(count)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:b][some]), pa.array(count[some]), pa.array(ids[a:b][label[some]])], names=["a", "n", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            group = rows.column("_group").to_numpy()
            last = len(group) - int((group == group[-1]).sum())
            if last:
                yield from done(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield from done(rest)

    return link


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                      tables_and_bits: tuple[int, int] | None = None) -> DataFrame:
    """``id_col``, n_links, component_id, kept: one row per row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_v"))
    # Vectors travel as they were given; they become doubles where they are compared.
    kind = np.float32 if isinstance(rows.schema["_v"].dataType.elementType, T.FloatType) else np.float64
    units = rows.mapInArrow(_packed(kind), "_id bigint, _digest binary, _vector binary")
    # One row per distinct vector, combined before the shuffle.
    classes = cut_lineage(
        units.where(F.col("_digest").isNotNull()).groupBy("_digest")
        .agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"), F.min("_vector").alias("_vector")))
    classes = classes.withColumn("_key", F.conv(F.substring(F.hex("_digest"), 1, 16), 16, -10).cast("bigint"))
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("_vector")).alias("d")).first()
    dims = (size["d"] or kind().itemsize) // kind().itemsize
    drawn = classes.orderBy("_digest").limit(SAMPLE_ROWS).select("_vector").collect()
    sample = _matrix(pa.array([bytes(r["_vector"]) for r in drawn], pa.binary()), dims, kind)
    centre, tables, bits = (np.zeros(dims), *tables_and_bits) if tables_and_bits else coded_by(sample, size["n"], cosine)
    projection = learn(sample - centre, tables * bits)
    offsets = centre @ projection

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(_matrix(batch.column(2), dims, kind), projection, offsets, tables, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["_id", "_n", "_vector", "_keys"])

    coded = classes.select(F.col("_key").alias("_id"), "_n", "_vector").mapInArrow(
        code, "_id bigint, _n bigint, _vector binary, _keys array<bigint>")
    met = coded.select("_id", "_n", "_vector", F.posexplode("_keys").alias("_table", "_bucket"))
    buckets = (
        coded.select(F.posexplode("_keys").alias("_table", "_bucket")).groupBy("_table", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
        .withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK_ROWS)))
    block = F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1))
    grouped = (
        met.join(buckets, ["_table", "_bucket"]).withColumn("_block", block).withColumn("_other", other)
        .withColumn("_group", F.xxhash64("_table", "_bucket", F.least("_block", "_other"), F.greatest("_block", "_other"))))
    found = cut_lineage(
        grouped.select("_group", "_table", "_block", "_id", "_n", "_vector")
        .repartition("_group").sortWithinPartitions("_group", "_block").mapInArrow(
            _linker(dims, kind, projection, offsets, tables, bits, cosine), "a bigint, n bigint, b bigint"))
    counted = found.groupBy("a").agg(F.sum("n").alias("_links"))
    known = components(found.select("a", "b"))
    placed = (
        classes.select("_key", "_digest", "_rep", "_n").join(counted, F.col("_key") == F.col("a"), "left")
        .join(known, F.col("_key") == F.col("node"), "left")
        .select("_digest", "_rep", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"),
                F.coalesce("component", "_key").alias("_comp")))
    # Components are named after their smallest id, not after the key.
    names = placed.groupBy("_comp").agg(F.min("_rep").alias("_name"))
    named = placed.join(names, "_comp").select("_digest", "_links", "_name")
    return units.select("_id", "_digest").join(named, "_digest", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("_id").isNotNull(), F.coalesce("_name", "_id")).alias("component_id")).withColumn(
            "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
