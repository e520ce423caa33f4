"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good, one from
texts labelled bad. A text is compressed with either; the difference of the two
sizes over their sum is its feature, together with the rate at which the better
dictionary compresses it. A logistic curve, fitted on
labelled texts that were not used for the dictionaries, turns them into the
probability that the label is 1.

The model is fitted on a bounded sample: per label the ``DICTIONARY_ROWS`` rows
with the smallest hash of their id make the dictionary, the next
``CALIBRATION_ROWS`` the curve, as far as their whole texts hold ``SAMPLE_BYTES``. Scores use whole
texts, in blocks of ``BLOCK_BYTES`` bytes.

Defined results: a null or empty text scores as a text of no bytes (the curve at
zero difference); a label that is null or repeated with another value is not
learned from; without labels of both kinds every score is the share of label 1
among the sample, or 0.5 without any; repeated rows are scored each, an empty
table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

DICTIONARY_ROWS, CALIBRATION_ROWS = 400, 2000
#: Text of the fitted rows of one label, which the driver holds; rows beyond are not fitted on, texts are never cut.
SAMPLE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2 << 10
THRESHOLD = 0.7
_LEVEL = 1


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    blocks = [t[i:i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        # Too little text for training: the text itself is the dictionary.
        return b"".join(blocks)[-DICTIONARY_BYTES:]


class Features:
    """Features of texts under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        def compressor(content: bytes):
            if not content:
                return zstandard.ZstdCompressor(level=_LEVEL)
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=_LEVEL)
            return zstandard.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False)

        self.coders = compressor(good), compressor(bad)

    def of(self, text: str) -> tuple[float, float, float, float]:
        raw = text.encode()
        good = bad = 0
        for i in range(0, len(raw), BLOCK_BYTES):
            block = raw[i:i + BLOCK_BYTES]
            good += len(self.coders[0].compress(block))
            bad += len(self.coders[1].compress(block))
        if not raw:
            return 0.0, 0.0, 0.0, 0.0
        difference = (bad - good) / (bad + good)
        ratio = min(good, bad) / len(raw)
        # How well the better dictionary does, whether the difference rests on much text, and outright repetition.
        return difference, ratio, difference * min(1.0, len(raw) / 500), max(0.0, 0.15 - ratio)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _row(f: tuple[float, ...]) -> list[float]:
    return [1.0, 20 * f[0], f[1], 20 * f[2], 20 * f[3]]


def _score(weights: tuple[float, ...], f: tuple[float, ...]) -> float:
    z = sum(w * v for w, v in zip(weights, _row(f), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on labelled rows outside the held-out part. The sample's size does not depend on the data's."""
    agreed = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z").drop("_z")
        .where(~held_out("_id")))
    # The sample holds as many rows of either label; the curve weighs them as they occur.
    occur = {r["_y"]: r["n"] for r in agreed.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.xxhash64("_id")
    n = DICTIONARY_ROWS + CALIBRATION_ROWS
    chosen = None
    for y in (0, 1):
        some = agreed.where(F.col("_y") == y).orderBy(rank, "_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2n narrow rows: a bounded broadcast.
    held = F.sum(F.octet_length("_text")).over(W.partitionBy("_y").orderBy(rank, "_id"))
    sample = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
        .withColumn("_held", held).where(F.col("_held") <= SAMPLE_BYTES).orderBy(rank, "_id").collect())
    by = {y: [r["_text"] for r in sample if r["_y"] == y] for y in (0, 1)}
    cut = {y: min(DICTIONARY_ROWS, (len(t) + 1) // 3) for y, t in by.items()}
    prior = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
    if min(len(by[0]), len(by[1])) < 2:
        share = len(by[1]) / (len(by[0]) + len(by[1])) if sample else 0.5
        logit = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(b"", b"", (logit, 0.0, 0.0, 0.0, 0.0))
    good, bad = (_dictionary([t.encode() for t in by[y][:cut[y]]]) for y in (1, 0))
    features = Features(good, bad)
    rest = [(t, y) for y in (0, 1) for t in by[y][cut[y]:]]
    x = np.array([_row(features.of(t)) for t, _ in rest] + [[1.0, 0.0, 0.0, 0.0, 0.0]])
    y = np.array([float(y) for _, y in rest] + [prior])
    own = {k: occur[k] / max(1, len(by[k]) - cut[k]) for k in (0, 1)}
    weight = np.array([own[k] for _, k in rest] + [1.0])
    return Model(good, bad, tuple(_fit(x, y, weight / weight.mean()).tolist()))


def _scorer(model: Model):
    features = Features(model.good, model.bad)
    return lambda text: _score(model.weights, features.of(text))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, held_out, score, predicted (1 from ``threshold``), one row per row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for batch in batches:
            out = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["_id", "score"])

    return rows.mapInArrow(score, schema).select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores ``threshold`` or more; columns and values stay as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([one(t.as_py() or "") >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
