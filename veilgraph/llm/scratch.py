"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch where the session leaves Spark's own number: batches of texts stay at some MB on both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
SETTING, CLEAN_UP = "spark.checkpoint.dir", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> None:
    """Sends the package to the workers and keeps Arrow batches small."""
    ship(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)


def let_go() -> None:
    """In a Python worker at the end of a task, and in the driver: hands freed memory back, as the process outlives tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """The driver and the executors hand back the memory that earlier work has grown; the Python workers of what follows need the room.

    A JVM keeps what its heap once took until a full collection; each of as many small tasks as the cluster has cores asks
    its JVM for one, which as a rule reaches every executor. Results never hang on it.
    """
    gc.collect()  # what Python lets go here the driver's JVM does too, a moment later
    let_go()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    spark._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing and everything runs on one machine (tests, a laptop), a temporary folder is made
    and put into the session's settings, so that it is chosen once; a cluster without the setting is refused.
    """
    ready(spark)
    known = spark.conf.get(SETTING, None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{SETTING} must name a folder that the whole cluster shares")
        known = "file://" + tempfile.mkdtemp(prefix="veilgraph-")
        spark.conf.set(SETTING, known)
    return known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veilgraph/{label}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession):
    """While it holds, Spark deletes the shuffle files of a write when the write has ended."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stash` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/veilgraph/" in name and name.split("veilgraph/")[0].rstrip("/").endswith(root.split(":")[-1].lstrip("/").rstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
