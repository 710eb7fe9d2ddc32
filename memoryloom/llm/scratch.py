"""Shared scratch space: intermediate tables that must outlive an executor."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def release() -> None:
    """Hand what this worker has freed back to the system: idle workers stay alive beside those at work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes of an Arrow batch between the executors and their workers, where the session leaves Spark's larger default.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with release() at the end of each task, and with batches of bounded size: the session's
    limit is lowered to BATCH_BYTES where it is Spark's default; a limit that a user has set stays."""
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_BATCH_SETTING) == str(64 << 20):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a single machine (tests), else an
    error, as executors of a cluster share no local folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_memoryloom_dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="memoryloom-")
        sc._memoryloom_dir = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/memoryloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and gives the planner a known size.

    The shuffle files of the finished job are released at once, so that an operator of many steps needs the disk of
    its largest step and not the sum of all.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memoryloom_path = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that no result reads any more."""
    for df in frames:
        path = getattr(df, "_memoryloom_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
