"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbrule.functions.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b), the component named after its smallest node.

    Each round points every node at the smallest of its neighbours and itself,
    follows two pointers, and keeps the edges between nodes that still differ;
    the longest path shrinks by a factor, so rounds grow with its logarithm.
    Minima are combined before they shuffle, and a star's centre is one row per
    task. Edges with a null end or equal ends are ignored. Written rounds go to
    the checkpoint folder.
    """
    left = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b")
    both = written(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps = []
    while not both.isEmpty():
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        far = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        to = written(near.join(far, "p").select("a", "q"))
        steps.append(to)
        moved = (
            both.join(to.withColumnRenamed("q", "x"), "a")
            .join(to.select(F.col("a").alias("b"), F.col("q").alias("y")), "b")
            .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        both = written(moved)
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0].select(F.col("a").alias("node"), F.col("q").alias("component"))
    for to in steps[1:]:
        out = (
            out.join(to.select(F.col("a").alias("component"), "q"), "component", "left")
            .select("node", F.coalesce("q", "component").alias("component")))
    return written(out)
