"""Centroid clustering by sort-means: exact Lloyd rounds in whole numbers.

In each round the other centroids are ordered by their distance from each centroid. A vector's scan starts at its centroid of the last
round, takes the others in that order, and stops at the first that lies strictly beyond twice the vector's distance from where it began:
by the triangle inequality neither that one nor any after it can be as near. All is in 64-bit integers, so ties are ties.

A round is one pass without a shuffle: it writes the vectors with their new centroids, and a row of sums a task and cluster, from which
the driver makes the next centroids (k rows of as many numbers as a vector has). The round before is then deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import free_name, new_dir, ready, remove

#: Vectors that a step holds.
STEP = 8192
#: Components reach so far at most; then squared distances of up to 64 components fit a long.
REACH = 1 << 27
ROUND = "vec_id long, v array<int>, cluster int, n long, sums array<long>"


def whole_vectors(points: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors with exactly `dims` components, none null or non-finite, as floor(scale * x).

    Null ids and repeated rows stay. A finite component beyond 2^27 / scale is an error, as its squared distance would not fit a long.
    """
    raw = F.col(vector_col).cast("array<double>")
    good = (F.size(raw) == dims) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = lambda x: F.when(F.abs(x * scale) < REACH, F.floor(x * float(scale)).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return points.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(raw, value).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 of salt and id; of equal ids the smaller vector, null ids last."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, and a quarter of those squared distances, rounded up."""
    gaps = np.stack([_squares(centroids, c) for c in centroids])
    np.fill_diagonal(gaps, -1)
    order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    return order, -(-np.take_along_axis(gaps, order, axis=1) // 4)


def assign(x: np.ndarray, start: np.ndarray, centroids: np.ndarray, order: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, of equally near ones the smaller number."""
    near = _squares(x, centroids[start])
    best, dist = start.copy(), near.copy()
    for a in np.unique(start).tolist():
        rows = np.flatnonzero(start == a)
        for c, least in zip(order[a].tolist(), quarter[a].tolist(), strict=True):
            rows = rows[near[rows] >= least]  # else the gap is strictly beyond twice the distance
            if not len(rows):
                break
            found = _squares(x[rows], centroids[c])
            nearer = (found < dist[rows]) | ((found == dist[rows]) & (c < best[rows]))
            best[rows[nearer]], dist[rows[nearer]] = c, found[nearer]
    return best, dist


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), STEP):
            yield batch.slice(a, STEP)


def _round(given):
    """Vectors with their new clusters, then a row of sums for each cluster that the task met."""

    def run(batches):
        centroids = given.value
        order, quarter = orders(centroids)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        names = ["vec_id", "v", "cluster", "n", "sums"]
        for batch in _parts(batches):
            x = _matrix(batch.column("v"))
            best, _ = assign(x, batch.column("cluster").to_numpy().astype(np.int64), centroids, order, quarter)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(counts))
            yield pa.record_batch([batch.column("vec_id"), batch.column("v").cast(ints), pa.array(best.astype(np.int32)), none(len(x), pa.int64()), none(len(x), longs)], names=names)
        met = np.flatnonzero(counts)
        yield pa.record_batch([none(len(met), pa.int64()), none(len(met), ints), pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), longs)], names=names)

    return run


def _last(given):
    def run(batches):
        centroids = given.value
        order, quarter = orders(centroids)
        for batch in _parts(batches):
            best, dist = assign(_matrix(batch.column("v")), batch.column("cluster").to_numpy().astype(np.int64), centroids, order, quarter)
            yield pa.record_batch([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


def _next(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid the exact floor of its vectors' mean; without vectors as it was."""
    out = centroids.copy()
    sums = rows.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place")
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.place] = int(r.total) // int(r.n)
    return out


def cluster(points: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector, the centroids that it was measured against).

    Vectors of another length, or with a null or non-finite component, are left out. Repeated rows each get a row and count as often;
    null ids are clustered like others, but start a centroid only when fewer than k have ids. With fewer than k vectors each
    is a centroid. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    spark: SparkSession = ready(points.sparkSession)
    vectors = whole_vectors(points, id_col, vector_col, dims, scale)
    centroids = first_centroids(vectors, k, salt)
    now = vectors.withColumn("cluster", F.lit(0))
    if not len(centroids):
        return now.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    folder = new_dir(spark, "sortmeans")
    for step in range(rounds):
        now.mapInArrow(_round(spark.sparkContext.broadcast(centroids)), ROUND).write.parquet(f"{folder}/{step}")
        written = spark.read.schema(ROUND).parquet(f"{folder}/{step}")
        centroids = _next(written.where("n is not null"), centroids)
        if step:
            remove(spark, f"{folder}/{step - 1}")
        now = written.where("n is null").select("vec_id", "v", "cluster")
    kind = "vec_id long, cluster int, distance long"
    now.mapInArrow(_last(spark.sparkContext.broadcast(centroids)), kind).write.parquet(f"{folder}/last")
    if rounds:
        remove(spark, f"{folder}/{rounds - 1}")
    return spark.read.schema(kind).parquet(f"{folder}/last"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256; k rows are summed, collected and broadcast."""
    spark = assigned.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}
    every = sum(inertia.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    mark = free_name(assigned)
    rows = spark.createDataFrame([(c, x, every, digest(c)) for c, x in inertia.items()], f"{mark} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(rows), F.col("cluster") == F.col(mark)).drop(mark)
