"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; else an error, as
    executors of a cluster share no local folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_memoryloom_folder", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc._memoryloom_folder = "file://" + tempfile.mkdtemp(prefix="memoryloom-")
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed once, however often it is read, with its size
    known to the planner; a lost executor costs a rerun of its tasks and decides nothing anew."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/memoryloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
