"""Connected components of a link table, by alternating stars, each round a written table. A table that is settled from the start takes no round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. Every u points its neighbours (the larger or the smaller ones) and itself to its least neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v")


def _settled(links: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, which has no smaller one itself; a round would change nothing."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return nodes.where("up > 1 or (up > 0 and least = 0)").isEmpty()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link between different nodes; the root is the least node of its component."""
    now = shared.written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(now):
            break
        # Written in between: the small star reads the large one's links twice.
        large = shared.written(shared.compact(_star(now, True), now), "stars")
        later = shared.written(shared.compact(_star(large, False).distinct(), now), "links")
        shared.drop(now)
        shared.drop(large)
        now = later
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
