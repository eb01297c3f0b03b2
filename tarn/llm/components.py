"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import durable, release


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which is no u itself: another round would change nothing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("upper")))
    return ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper")).where("lower + upper > 1 and lower > 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge to another, with the smallest node that it reaches.

    Each round does a large-star and a small-star step, so the rounds grow with the logarithm of the
    longest path. Only partial minima are shuffled by node; no neighbourhood is ever gathered. Null ends
    and loops are ignored; repeated edges count once; an empty list gives an empty result.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    now = durable(now)
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # written, because the small star reads it twice
        large = durable(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = durable(small.where("u <> v").distinct())
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
