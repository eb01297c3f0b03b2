"""Sinks: table merges as DataFrames of the new state, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """target with those rows whose key it lacks, of equal keys the first by order."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1")
    return target.unionByName(first.join(target, list(keys), "left_anti").select(*target.columns))


def insert_or_replace(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """target with each key's last row by order, rows standing before the target's own."""
    both = target.withColumn("__p", F.lit(0)).withColumn("__o", F.lit(None).cast(dict(rows.dtypes)[order])).unionByName(rows.select(*target.columns, F.lit(1).alias("__p"), F.col(order).alias("__o")))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__p"), F.desc("__o")))
    return both.withColumn("__n", last).where("__n = 1").select(*target.columns)


def count_upsert(target: DataFrame, rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, attempts, value): attempts of target plus one a row; the value of the last row."""
    new = rows.groupBy(key).agg(F.count("*").alias("__n"), F.max_by(value, order).alias("__v"))
    return target.join(new, key, "full").select(key, (F.coalesce("attempts", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("attempts"), F.coalesce("__v", value).alias(value))


def coalesce_merge(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New non-null values win; source tells where a key comes from: old, new or both."""
    n = rows.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    x = target.join(n, F.col(key) == F.col("__k"), "full")
    source = F.when(F.col("__k").isNull(), "old").when(F.col(key).isNull(), "new").otherwise("both")
    return x.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in columns], source.alias("source"))


def replace_by_prefix(old: DataFrame, new: DataFrame, column: str, prefix: str) -> DataFrame:
    """old without the rows whose column starts with prefix, then new."""
    return old.where(~F.startswith(F.col(column), F.lit(prefix))).unionByName(new, allowMissingColumns=True)


def nested(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with their children as a sorted array of structs, for JSON export."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in children.columns if c != key]))).alias(name))
    return parents.join(lists, key, "left")


def export(df: DataFrame, path: str, form: str) -> None:
    """Writes json, csv (with a heading), xml (rows as <row>) or parquet."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    if form == "xml":
        writer = writer.option("rowTag", "row").option("rootTag", "rows")
    writer.format(form).save(path)


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def job_states(jobs: DataFrame, updates: DataFrame, most: int = 3) -> DataFrame:
    """(job, stage, status, retries): jobs after their updates (job, at, ok); a failure is pending again until `most` retries are used."""
    u = updates.groupBy("job").agg(F.max_by("ok", "at").alias("ok"), F.count_if(~F.col("ok")).alias("failures"))
    x = jobs.join(u, "job", "left").withColumn("retries", F.col("retries") + F.coalesce("failures", F.lit(0)))
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(F.col("retries") < most, "pending").otherwise("failed")
    return x.select("job", "stage", status.alias("status"), "retries")
