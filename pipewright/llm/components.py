"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node.

    Every round is two pre-aggregated minima and two joins, so a hub's edges never meet
    in one task; stars are reached in a number of rounds logarithmic in the longest path.
    No edges give no rows; self-loops and repeated edges change nothing.
    """
    now = scratch.keep(f"{name}-0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen, i = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen, i = mark, i + 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        fresh = scratch.keep(f"{name}-{i}", small)
        scratch.drop(f"{name}-{i - 1}")
        now = fresh
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select("b", "b").distinct())
