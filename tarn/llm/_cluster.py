"""What every operator here needs of the cluster: the shared folder, and the package on the workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one for local masters; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(context, "_tarn_shared", None) or tempfile.mkdtemp(prefix="tarn-")
        context._tarn_shared = folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def new_dir(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder, as a URI."""
    folder = shared_dir(spark).rstrip("/")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return f"{folder}/tarn-{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder made by new_dir that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    ease(df.sparkSession)
    return out


def free_name(*tables: DataFrame) -> str:
    """A name that no column of the tables has or begins with, in any case of its letters."""
    taken = [c.lower() for t in tables for c in t.columns]
    return next(x for k in range(len(taken) + 1) if not any(c.startswith(x := f"__tarn{k}_") for c in taken))


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started, and keeps Arrow batches of texts small.

    Operators work on a megabyte of text at a time, so Spark's default of 10,000 rows a batch would only hold texts in memory, several
    times over in the executor and its worker. Another setting of the session stands.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def blocks_for(items: int, each: int) -> int:
    """How many hash blocks hold about `each` items apiece."""
    return max(1, -(-int(items or 0) // each))


def trim() -> None:
    """Returns this process's freed memory to the system, which the C library else keeps."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def give_back() -> None:
    """The same for the driver, after collecting its garbage."""
    gc.collect()
    trim()


def trim_jvm(spark: SparkSession) -> str:
    """Returns the driver's JVM's freed native memory to the system, which the C library else keeps, some of it for each thread that ran an exchange; what the JVM says to that, "" if it cannot."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = named(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # by the interface, as the class behind it is not open
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return named("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values) or ""
    except Py4JError:
        return ""  # another JVM or C library


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more, which else stay until the driver happens to collect its garbage, and returns the driver's freed memory."""
    give_back()
    spark._jvm.System.gc()
    trim_jvm(spark)


#: The share of the heap's bound beyond which the driver collects its garbage after a step.
FULL_HEAP = 0.5


def ease(spark: SparkSession) -> None:
    """Keeps what the driver holds from growing with the steps: plans and their threads leave garbage, and a heap that has grown does not shrink unless it is collected."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > FULL_HEAP * heap.maxMemory():
        release(spark)
    else:
        trim_jvm(spark)
