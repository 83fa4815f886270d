"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, release, spread_join


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge up, to a node that has none."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("n")).select("n.*")
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (a, b).

    Large-star and small-star rounds alternate until only stars are left, which takes about
    the logarithm of the longest path. Neighbours are never gathered into lists: each step
    is a minimum per node, combined before the shuffle, and a join in which nodes with very
    many neighbours are broadcast. Edges with a null end or from a node to itself connect
    nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = cut(e, "edges")
    total = e.count()
    for _ in range(max_rounds):
        if _settled(e):
            break
        # larger neighbours of b move to the smallest of its neighbourhood
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("b"), F.least("u", "m").alias("m"), "n")
        large = spread_join(e, low, ["b"], "n", total).select("a", "m").where("a <> m")
        # a node has few smaller neighbours; it and they move to the smallest of those
        small = large.withColumn("low", F.min("m").over(Window.partitionBy("a")))
        moved = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("m").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.*")
        new = cut(moved.where("a <> b").distinct(), "edges")
        release(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct()), "components")
    release(e)
    return out
