"""Joins: interval and as-of joins with an equality key for the planner, precedence joins, shared-neighbour pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import durable


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, seconds: int, how: str = "inner") -> DataFrame:
    """Rows of equal keys with left_ts <= right_ts <= left_ts + seconds.

    Time is cut into buckets of that width; a left row looks into its own and the next, so the join is an equality
    join on (keys, bucket) with a residual, and a key with a third of all rows is spread over its buckets.
    """
    sec = lambda c: F.unix_timestamp(c)
    cells = F.array(F.floor(sec(left_ts) / seconds), F.floor(sec(left_ts) / seconds) + 1)
    x = left.withColumn("__b", F.explode(cells))
    y = right.withColumn("__b", F.floor(sec(right_ts) / seconds))
    y = y.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in y.columns if c != "__b"], F.col("__b").alias("__rb"))
    on = (F.col("__b") == F.col("__rb")) & (F.col(right_ts) >= F.col(left_ts)) & (sec(right_ts) - sec(left_ts) <= seconds)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return x.join(y, on, how).drop("__b", "__rb", *[f"__{k}" for k in keys])


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its keys at or before its time, null without one.

    Both sides are stacked and swept once per key, so nothing is multiplied. Of right rows of one time the last by value counts.
    """
    x = left.withColumn("__t", F.col(left_ts)).withColumn("__s", F.lit(1))
    y = right.select(*keys, F.col(right_ts).alias("__t"), F.struct(*values).alias("__v")).withColumn("__s", F.lit(0))
    both = x.unionByName(y, allowMissingColumns=True)
    sweep = Window.partitionBy(*keys).orderBy("__t", "__s", "__v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(sweep)).where("__s = 1")
    return out.select(*left.columns, *[F.col("__v")[v].alias(v) for v in values])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def shared_pairs(edges: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """Pairs of groups (g1 < g2) with at least `least` members in common, and how many.

    Edges are made distinct first. Members of many groups give many pairs; limit the degree beforehand where that is meant.
    """
    e = edges.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    x, y = e.select(F.col("g").alias("g1"), "m"), e.select(F.col("g").alias("g2"), "m")
    return x.join(y, "m").where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


#: Pairs of one key that one part of it makes, and left rows that it has at least.
PART_PAIRS, PART_ROWS = 1_000_000, 1000


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join on columns that both sides have, for keys that make many pairs out of few rows.

    A key with many pairs is cut into parts: its left rows are dealt over them, its right rows are in each. So no task makes all pairs of a key, and pairs are not shuffled.
    """
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    parts = F.least(F.ceil(F.col("__l") * F.col("__r") / PART_PAIRS), F.ceil(F.col("__l") / PART_ROWS)).cast("int")
    sizes = durable(counted(left, "__l").join(counted(right, "__r"), list(keys)).select(*keys, parts.alias("__parts")))
    x = left.join(sizes, list(keys)).withColumn("__part", F.pmod(F.xxhash64(*left.columns), "__parts").cast("int")).drop("__parts")
    y = right.join(sizes, list(keys)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few rows stay dealt over all tasks
    on = [*keys, "__part"]
    return x.repartition(n, *on).join(y.repartition(n, *on).hint("merge"), on).drop("__part")


def least_of(right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the smallest value of each key, so that a precedence join meets a row a key, however many have it. Null keys and values, which never match, are left out."""
    return right.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def precedence_join(left: DataFrame, attempts: Sequence[tuple[str, DataFrame, Column]], key: str, value: str) -> DataFrame:
    """(key, value, via): each left row's match of the first attempt, in order, that has one; of several, the smallest value."""
    parts = [left.join(right, on).select(key, F.col(value), F.lit(name).alias("via"), F.lit(k).alias("rank")) for k, (name, right, on) in enumerate(attempts)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy(key).agg(F.min(F.struct("rank", value, "via")).alias("m")).select(key, f"m.{value}", "m.via")


def merge_tables(base: DataFrame, extra: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with its nulls filled from extra and a source tag, then the rows of extra whose key base lacks."""
    e = extra.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    tagged = base.join(e, F.col(key) == F.col("__k"), "left")
    filled = tagged.select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], F.when(F.col("__k").isNull(), "base").otherwise("both").alias("source"))
    return filled.unionByName(extra.join(base, key, "left_anti").select(key, *columns, F.lit("extra").alias("source")))
