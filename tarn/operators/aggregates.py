"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import durable


def order_statistics(counted: DataFrame, value: str, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """(keys, name, v): the value at each wanted rank (keys, name, rank from 0) of its group, from (keys, value, c) with a row for each different value.

    The rows are sorted into ranges over all tasks, so a group of any size is split. Counts by range say in which range each rank lies and how far
    into it; only those ranges are summed up, each for itself. A group's counts by range are as many as there are tasks, at most.
    """
    ranged = durable(counted.select(*keys, value, "c").repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("size"))
    order = Window.partitionBy(*[F.col(k) for k in keys], F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("size").over(order), F.lit(0)))
    place = (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size"))
    wanted = ranks.join(parts, list(keys)).where(place) if keys else ranks.join(F.broadcast(parts), place)  # a row a task
    wanted = durable(wanted.select(*keys, "part", "name", (F.col("rank") - F.col("below")).alias("rank")))
    own = [*keys, "part"]
    inside = ranged.join(F.broadcast(wanted.select("part").distinct()) if not keys else wanted.select(*own).distinct(), own, "left_semi")
    upto = F.sum("c").over(Window.partitionBy(*own).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).join(wanted, own).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return found.select(*keys, "name", F.col(value).cast("double").alias("v"))


def distribution(df: DataFrame, value: str, keys: Sequence[str] = (), percentiles: Sequence[int] = (75, 90, 95, 99), least: int = 10) -> DataFrame:
    """n, mean, sample deviation, median, nearest-rank percentiles (0-based index n * p / 100, cut) and maximum; nulls below `least` rows.

    Equal values are counted first; order statistics come from counted ranges, so no group has to fit a task. A null key is a group of its own.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    if keys:  # nulls, which joins would lose, are told from values by a struct
        group = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.col(k).isNull().alias(f"no_{k}") for k in keys])
        counted = counted.withColumn("__group", group)
    counted = durable(counted)
    group = ["__group"] if keys else []
    v = F.col(value).cast("double")
    n = F.sum("c")
    mean = F.sum(v * F.col("c")) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(v * v * F.col("c")) - n * mean * mean, n - 1)))
    stats = durable(counted.groupBy(*group, *keys).agg(n.alias("n"), mean.alias("mean"), spread.alias("stdev"), F.max(v).alias("max")))
    rank = {f"p{p}": F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in percentiles} | {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    ranks = stats.select(*group, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in rank.items()])).alias("x")).select(*group, "x.*")
    at = order_statistics(counted, value, group, ranks).groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in rank])
    out = stats.join(at, group) if keys else stats.join(F.broadcast(at))
    out = out.withColumn("median", (F.col("low") + F.col("high")) / 2)
    shown = ["mean", "stdev", "median", *[f"p{p}" for p in percentiles], "max"]
    return out.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in shown])


def weighted_mean(score: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(weight))


def precision_recall(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts and precision, recall, F1 of two sets of ids; null where a denominator is 0."""
    p = predicted.select(key).distinct().withColumn("p", F.lit(1))
    a = actual.select(key).distinct().withColumn("a", F.lit(1))
    n = p.join(a, key, "full").agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    out = n.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def flow_nodes(edges: DataFrame, src: str, dst: str, amount: str) -> DataFrame:
    """Per node: counts and sums in and out, net, and role: sink (in > 1.5 out), source (out > 1.5 in), pass_through (ratio 0.8 to 1.2), mixed."""
    out = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("n_out"), F.sum(amount).cast("double").alias("v_out"))
    into = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("n_in"), F.sum(amount).cast("double").alias("v_in"))
    both = out.join(into, "node", "full").na.fill(0)
    ratio = F.try_divide("v_out", "v_in")
    role = F.when(F.col("v_in") > 1.5 * F.col("v_out"), "sink").when(F.col("v_out") > 1.5 * F.col("v_in"), "source").when(ratio.between(0.8, 1.2), "pass_through").otherwise("mixed")
    return both.select("node", "n_in", "n_out", "v_in", "v_out", (F.col("v_in") - F.col("v_out")).alias("net"), role.alias("role"))


def histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
