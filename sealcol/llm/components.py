"""Connected components of an edge list, by alternating large and small stars, a written table after each round.

Nodes are of any ordered type; edges with a null end and edges of a node with itself are left out, repeated edges count once,
and no edges give no rows. The hub of a star is one key of a join of two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones; small: the lesser ones and itself) are hung on its least neighbour."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = flipped if small else edges.union(flipped)  # small: a is the greater end
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = around.join(least.repartition("a").hint("merge"), "a")
    out = joined.filter(F.col("b") != F.col("m")) if small else joined.filter(F.col("b") > F.col("a"))
    out = out.select(F.col("m").alias("a"), "b")
    if small:
        out = out.union(least.filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node it is connected to) of every node of edges (a, b); nodes of any ordered type.

    Rounds are of the order of the logarithm of the largest component. Stops when a round changes nothing.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark["n"] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        now = materialise(_star(_star(now, small=False), small=True), "edges")
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
