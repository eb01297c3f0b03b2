"""The shared folder in which loops cut their lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one for local masters; an error on a cluster."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers get 500 rows at a time, as Spark's default of 10,000 whole texts would be held several times over. Another setting of the session stands."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "500")


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Into how many parts `rows` rows are dealt, so that a part stays of one size as tables grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


class Stages:
    """Tables that a long loop writes to the shared folder and reads back, so that its plans keep no memory of earlier rounds.

    A checkpoint would keep the constraints that Spark has inferred, which double from round to round where the same tables are joined again and again.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.paths = spark, scratch(spark, name), {}
        self.n = 0

    def put(self, df: DataFrame, slot: str) -> DataFrame:
        """df, written and read back; what the slot held before the last put is deleted."""
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        self.paths.setdefault(slot, []).append(path)
        while len(self.paths[slot]) > 2:
            self._remove(self.paths[slot].pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, keep: str) -> None:
        """Deletes all tables but those of one slot."""
        for slot in [s for s in self.paths if s != keep]:
            for path in self.paths.pop(slot):
                self._remove(path)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
