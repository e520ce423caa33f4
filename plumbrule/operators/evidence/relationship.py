"""Numeric relationships between a column and the other measures of its group.

For every group of rows that agree on all dimension columns, one aggregation
with map-side combining collects count, mean and spread of each shape
(constant, ratio, product, sum, difference). Shapes are plain columns of it; where measures
are many, their shapes are dealt to chunks of ``CHUNK`` columns, so a row becomes one row per chunk
and not one per shape. An issue then reads the moments
of its group and takes its own row out again by arithmetic, so issues and
group members are never paired, however large a group is. Moments are kept per
order of magnitude of the target, so taking out a wild value does not cancel
away the digits of the ordinary ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, permutations
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.functions.grouping import keep_matching, lookup
from plumbrule.operators.evidence import AMBIGUOUS, CANDIDATE, INSUFFICIENT, NO_RELATIONSHIP

# Acceptance limits.
MIN_GROUP = 3
MIN_FIT = 0.9
AMBIGUITY_MARGIN = 0.03
_FIT_DIGITS = 9
#: Shapes that are aggregated side by side, as columns.
CHUNK = 32


@dataclass(frozen=True)
class Shape:
    kind: str
    related: tuple[str, ...]


def shapes_of(measures: Sequence[str]) -> list[Shape]:
    """Every relationship to test, in order of preference on equal fit."""
    used = list(measures)
    return (
        [Shape("constant_within_group", ())]
        + [Shape("ratio_consistency", (m,)) for m in used]
        + [Shape("product_consistency", p) for p in combinations(used, 2)]
        + [Shape("sum_consistency", p) for p in combinations(used, 2)]
        + [Shape("difference_consistency", p) for p in permutations(used, 2)])


# Shapes are written as SQL over the target ``t`` and the measures ``v0``, ``v1``, ...: with many measures there
# are several hundred, and text is much faster to build than that many Column objects.


def _derived(shape: Shape, at: dict[str, str]) -> str:
    sign = {"product_consistency": "*", "sum_consistency": "+", "difference_consistency": "-"}[shape.kind]
    return f"({at[shape.related[0]]} {sign} {at[shape.related[1]]})"


def _observation(shape: Shape, at: dict[str, str]) -> str:
    """What is averaged: the target, target / measure, or the relative error of a derived value."""
    if shape.kind == "constant_within_group":
        return "t"
    if shape.kind == "ratio_consistency":
        return f"t / nullif({at[shape.related[0]]}, 0.0D)"
    d = _derived(shape, at)
    return f"abs(t - {d}) / CASE WHEN t IS NULL OR {d} IS NULL THEN NULL ELSE greatest(abs(t), abs({d}), 1e-9D) END"


def _prediction(shape: Shape, at: dict[str, str]) -> str:
    """The value itself for derived shapes, what the fitted mean is multiplied with for the others."""
    if shape.kind == "constant_within_group":
        return "1.0D"
    if shape.kind == "ratio_consistency":
        return f"nullif({at[shape.related[0]]}, 0.0D)"
    return _derived(shape, at)


def _array(parts: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(parts) + ")")


def _numbers(df: DataFrame, target: str, measures: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    return df.select(*keep, text.finite(F.col(target)).alias("t"), *[
        text.finite(F.col(m)).alias(f"v{i}") for i, m in enumerate(measures)])


def _magnitude(target: Column) -> Column:
    """Order of magnitude of the target in steps of 2^8; NULL and 0 have their own."""
    return F.coalesce(F.floor(F.log2(F.abs(target)) / 8).cast("int"), F.when(target == 0, -9998).otherwise(-9999))


def group_moments(df: DataFrame, target: str, measures: Sequence[str], shapes: Sequence[Shape],
                  group_key: Column) -> DataFrame:
    """One row per group: its size and its moments per magnitude class and shape.

    A class holds an array of (i, n, mean, m2) with one entry per shape. Both
    the number of shapes and the number of classes (about 270, the exponent
    range of a double) are bounded whatever the group's size.
    """
    at = {m: f"v{i}" for i, m in enumerate(measures)}
    width = min(CHUNK, len(shapes))
    chunks = [shapes[k:k + width] for k in range(0, len(shapes), width)]
    chunks[-1] = [*chunks[-1], *[None] * (width - len(chunks[-1]))]
    columns = [[f"CAST({_observation(s, at) if s else 'NULL'} AS DOUBLE) AS x{k}" for k, s in enumerate(c)] for c in chunks]
    numbers = _numbers(df, target, measures, [group_key.alias("_group")]).withColumn("_class", _magnitude(F.col("t")))
    if len(chunks) == 1:
        observed = numbers.selectExpr("_group", "_class", "0 AS _chunk", *columns[0])
    else:
        cells = ", ".join(f"struct({k} AS _chunk, {', '.join(c)})" for k, c in enumerate(columns))
        observed = numbers.selectExpr("_group", "_class", f"inline(array({cells}))")
    finite = observed.select("_group", "_class", "_chunk", *[text.finite(F.col(f"x{k}")).alias(f"x{k}") for k in range(width)])
    zero = F.lit(0.0)
    per_chunk = finite.groupBy("_group", "_class", "_chunk").agg(F.count(F.lit(1)).alias("size"), *[
        c for k in range(width) for c in (
            F.count(f"x{k}").alias(f"n{k}"), F.avg(f"x{k}").alias(f"mean{k}"), F.var_pop(f"x{k}").alias(f"var{k}"))])
    moments = F.array(*[
        F.struct((F.col("_chunk") * width + k).alias("i"), F.col(f"n{k}").alias("n"), F.coalesce(f"mean{k}", zero).alias("mean"),
                 F.coalesce(F.col(f"var{k}") * F.col(f"n{k}"), zero).alias("m2")) for k in range(width)])
    in_order = F.array_sort(F.collect_list(F.struct("_chunk", moments.alias("part"))))
    per_class = per_chunk.groupBy("_group", "_class").agg(
        F.max("size").alias("size"), F.flatten(F.transform(in_order, lambda c: c["part"])).alias("moments"))
    return per_class.groupBy("_group").agg(
        F.sum("size").alias("size"), F.collect_list(F.struct("_class", "moments")).alias("classes"))


def relationship_evidence(
    df: DataFrame, failing: DataFrame, target: str, dimensions: Sequence[str], measures: Sequence[str],
    min_group: int = MIN_GROUP, min_fit: float = MIN_FIT, margin: float = AMBIGUITY_MARGIN,
) -> DataFrame:
    """A replacement for ``target`` per failing row.

    ``failing`` holds the current source row of each issue (all columns of
    ``df`` plus issue_id), exactly one per issue; that row is in ``df`` once
    and is left out of its own evidence. Groups of different issues are
    computed once.
    """
    dims = [d for d in dimensions if d != target]
    used = [m for m in measures if m != target]
    shapes = shapes_of(used)
    at = {m: f"v{i}" for i, m in enumerate(used)}
    key = text.digest(text.exact_text(df.schema, dims)) if dims else F.lit("whole table")
    # Only the groups that hold a failing row are summarised.
    keyed = keep_matching(df.withColumn("_group", key), failing.select(key.alias("_group")), "_group")
    moments = group_moments(keyed, target, used, shapes, F.col("_group"))
    issues = _numbers(failing, target, used, [F.col("issue_id"), key.alias("_group")]).select(
        "issue_id", "_group", _magnitude(F.col("t")).alias("own_class"),
        F.transform(_array([_observation(s, at) for s in shapes]), text.finite).alias("own"),
        _array([_prediction(s, at) for s in shapes]).alias("base"))
    joined = lookup(issues, moments, "_group", "issue_id")

    scaled = _array([str(s.kind in ("constant_within_group", "ratio_consistency")).lower() for s in shapes])

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def without_own(m: Column, x: Column) -> Column:
        n = m["n"] - 1
        mean = (m["mean"] * m["n"] - x) / F.greatest(n, F.lit(1))
        m2 = F.greatest(F.lit(0.0), m["m2"] - F.pow(x - mean, 2) * n / m["n"])
        return F.when(n > 0, F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))).otherwise(none)

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        whole = F.greatest(n, F.lit(1)).cast("double")
        return F.struct(
            n.alias("n"),
            F.when(b["n"] == 0, a["mean"]).when(a["n"] == 0, b["mean"])
            .otherwise(a["mean"] + gap * b["n"] / whole).alias("mean"),
            F.when((a["n"] == 0) | (b["n"] == 0), a["m2"] + b["m2"])
            .otherwise(a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / whole).alias("m2"))

    def of_group(i: Column) -> Column:
        x = F.get("own", i)

        def add(acc: Column, c: Column) -> Column:
            m = F.get(c["moments"], i)
            mine = (c["_class"] == F.col("own_class")) & x.isNotNull()
            whole = F.struct(m["n"].alias("n"), m["mean"].alias("mean"), m["m2"].alias("m2"))
            return merged(acc, F.when(mine, without_own(m, x)).otherwise(whole))

        m = F.aggregate("classes", none, add)
        return F.struct(m["n"].alias("n"), m["mean"].alias("mean"), m["m2"].alias("m2"),
                        F.get(scaled, i).alias("scaled"), F.get("base", i).alias("base"), i.alias("i"))

    def tested(s: Column) -> Column:
        spread = F.abs(F.sqrt(s["m2"] / s["n"]) / s["mean"])
        error = F.when(s["scaled"], spread).otherwise(s["mean"])
        value = F.when(s["scaled"], s["mean"] * s["base"]).otherwise(s["base"])
        fit = F.round(F.greatest(F.lit(0.0), 1 - error), _FIT_DIGITS)
        usable = (s["n"] >= min_group) & ~(s["scaled"] & (s["mean"] == 0)) & text.finite(value).isNotNull()
        return F.when(usable, F.struct(
            fit.alias("fit"), (-s["i"]).alias("order"), value.alias("value"), s["n"].alias("n"),
            error.alias("residual")))

    known = F.filter(F.transform(
        F.transform(F.sequence(F.lit(0), F.lit(len(shapes) - 1)), of_group), tested), lambda t: t.isNotNull())
    accepted = F.filter("known", lambda t: t["fit"] >= min_fit)
    rival = F.exists("accepted", lambda t: ((F.col("top.fit") - t["fit"]) <= margin + 1e-12)
                     & ~text.close(t["value"], F.col("top.value"), 0.01, 1e-6))
    # array_max orders by fit, then by the earliest shape.
    ranked = (
        joined.withColumn("size", F.coalesce(F.col("size"), F.lit(1)) - 1)
        .withColumn("known", known).withColumn("accepted", accepted)
        .withColumn("top", F.array_max("accepted")))
    status = (F.when(F.col("size") < min_group, INSUFFICIENT)
              .when(F.size("accepted") == 0, NO_RELATIONSHIP)
              .when(rival, AMBIGUOUS).otherwise(CANDIDATE))
    kinds = F.array(*[F.lit(s.kind) for s in shapes])
    related = F.array(*[F.lit(",".join(s.related)) for s in shapes])
    best = F.col("status") == CANDIDATE
    at = (-F.col("top.order")).cast("int")
    return ranked.withColumn("status", status).select(
        "issue_id", F.lit(target).alias("target_column"), "status", F.col("size").cast("bigint").alias("group_size"),
        F.when(best, F.get(kinds, at)).alias("relationship_type"),
        F.when(best, F.get(related, at)).alias("related_columns"),
        F.when(best, F.col("top.value")).alias("candidate_value"),
        F.when(best, F.col("top.n")).alias("supporting_count"),
        F.when(best, F.col("top.fit")).alias("fit_quality"),
        F.when(best, F.col("top.residual")).alias("residual"),
        F.when(best & F.get(scaled, at), F.col("top.residual")).alias("coefficient_of_variation"),
        F.when(best, F.col("top.fit") * F.least(F.lit(1.0), F.col("top.n") / F.lit(2.0 * min_group)))
        .alias("confidence"),
        F.size("known").alias("shapes_tested"))
