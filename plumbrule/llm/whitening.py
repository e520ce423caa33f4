"""Whitened embeddings by block matrices.

Components become integers ``x = floor(1024 * c) + 100000``. Their exact sums give the mean; the
centred rows are indexed into an MLlib block matrix, whose transpose is multiplied with it for the
scatter. Its sums are split over the rows (``numMidDimSplits``), so no task sees more than some
blocks. The scatter is as wide as a vector, so its eigenvectors are found on the driver; the
matrix of the first of them, each over the root of its eigenvalue, is multiplied with the same
blocks. Vectors never pass through the driver: it holds one number per dimension and per pair of
dimensions, and the keys of the blocks, of which there are at most ``MOST_BLOCKS``.

Defined results: rows whose vector is null or holds null or non-finite components are dropped and
count nowhere; an empty vector stays, and shorter vectors are padded with zeros; components are
limited to what a double counts exactly (2**53 after scaling); a deviation that exceeds a long is
null; a direction without variance (eigenvalue at rounding level) is explained 0 and whitened
null; rows that repeat an id, or have none, are rows of their own; an empty table gives an empty
result; other columns are not read. Eigenvectors of equal eigenvalues may be any of their space.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions.storage import written
from plumbrule.sources.tables import with_row_index

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Numbers in a block, unless there would be too many blocks.
BLOCK_NUMBERS = 1 << 17
MOST_BLOCKS = 1 << 18
#: Blocks whose products one task sums up.
BLOCKS_PER_SPLIT = 4
_LARGEST = float(1 << 53)


class Fit(NamedTuple):
    """What the driver knows of the fitted vectors: count, sums and extremes by dimension."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v): vectors of finite components, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).alias("_id"), v.alias("_v")).where(F.col("_v").isNotNull() & whole)


def _scaled(dims: int) -> Column:
    """The vector's integers, padded to ``dims``."""
    c = lambda i: F.coalesce(F.get("_v", i), F.lit(0.0)) * SCALE
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.floor(
        F.least(F.greatest(c(i), F.lit(-_LARGEST)), F.lit(_LARGEST))) + SHIFT)


def fit(scaled: DataFrame) -> Fit:
    by_dim = scaled.select(F.posexplode("_x").alias("i", "x")).groupBy("i").agg(
        F.count("x").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    rows = by_dim.orderBy("i").collect()
    return Fit(rows[0]["n"], [int(r["s"]) for r in rows], [r["low"] for r in rows], [r["high"] for r in rows])


def _numbers(values: list, kind: str) -> Column:
    return F.lit([int(v) if kind == "bigint" else float(v) for v in values]).cast(f"array<{kind}>")


def _deviation(known: Fit) -> Column:
    """Sum over dimensions of (n x - S)^2: in longs where it must fit, else in decimals."""
    n, base, rest = known.n, [s // known.n for s in known.sums], [s % known.n for s in known.sums]
    most = sum(max(abs(n * v - s) for v in (low, high)) ** 2 for low, high, s in zip(known.low, known.high, known.sums, strict=True))
    kind = "bigint" if most < 1 << 63 else "decimal(38,0)"
    bases, rests = _numbers(base, "bigint"), _numbers(rest, "bigint")

    factor = "bigint" if kind == "bigint" else "decimal(18,0)"

    def squared(x: Column, i: Column) -> Column:
        part = (F.try_multiply(F.lit(n).cast(factor), (x - bases[i]).cast(factor)) - rests[i].cast(factor)).cast(kind)
        return F.try_multiply(part, part).cast(kind)

    return F.aggregate(F.transform("_x", squared), F.lit(0).cast(kind), F.try_add).try_cast("bigint")


def _centred(known: Fit) -> Column:
    bases = _numbers([s // known.n for s in known.sums], "bigint")
    rests = _numbers([(s % known.n) / known.n for s in known.sums], "double")
    return F.transform("_x", lambda x, i: (x - bases[i]).cast("double") - rests[i])


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, whose sums over the middle dimension are split among tasks."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["_id"].dataType.simpleString()
    dims = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame(
            [], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    # Positions must not be computed twice: the rows are written with them.
    indexed = with_row_index(rows.select("_id", _scaled(dims).alias("_x")), ["_id"], out="_at")
    known = fit(indexed)
    per_block = max(1, BLOCK_NUMBERS // dims, math.ceil(known.n / MOST_BLOCKS))
    splits = math.ceil(math.ceil(known.n / per_block) / BLOCKS_PER_SPLIT)
    ready = indexed.select(F.col("_at").alias("index"), array_to_vector(_centred(known)).alias("vector"))
    centred = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(ready, "vector"), known.n, dims).toBlockMatrix(per_block, dims)
    scatter = _product(centred.transpose(), centred, splits).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * known.n)
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    real = value > max(value[0], 0) * dims * np.finfo(np.float64).eps
    weights = vector / np.sqrt(np.where(real, value, 1.0))
    width = len(value)
    whitening = BlockMatrix(
        spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, width, weights.ravel("F").tolist()))], 1), dims, width)
    projected = callMLlibFunc(
        "getIndexedRows", centred.multiply(whitening).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    both = written(
        indexed.select("_id", "_at", _deviation(known).alias("_deviation"))
        .join(projected.select(F.col("index").alias("_at"), vector_to_array(F.col("vector")).alias("_w")), "_at")
        .select("_id", "_deviation", "_w"))
    error = identity_error(both, [i for i in range(width) if real[i]])
    explained = [float(v / trace) if r else 0.0 for v, r in zip(value, real, strict=True)]
    i = F.col("_i")
    return both.select("_id", "_deviation", F.posexplode("_w").alias("_i", "_c")).select(
        F.col("_id").alias(id_col), (i + 1).alias("component"), F.lit(known.n).cast("bigint").alias("n"),
        F.col("_deviation").alias("deviation"), F.when(F.lit([bool(r) for r in real])[i], F.col("_c")).alias("whitened"),
        _numbers(explained, "double")[i].alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(projected: DataFrame, columns: list[int]) -> float:
    """How far the covariance of the columns of ``_w`` is from the identity, at its worst entry."""
    pairs = [(i, j) for i in columns for j in columns if i <= j]
    if not pairs:
        return 0.0
    w = F.col("_w")
    got = projected.agg(*[F.abs(F.covar_pop(w[i], w[j]) - int(i == j)).alias(f"e{k}") for k, (i, j) in enumerate(pairs)]).first()
    return float(max(got))
