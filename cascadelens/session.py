"""Session settings and the few run-time services every operator shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cascadelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling; `master` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    `spark.checkpoint.dir` is read from the session and wins; a folder of our own is set only
    where none is named, which is the case in tests and on a single machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cascadelens-checkpoints"))
    return context.getCheckpointDir()


_scratch: list[str] = []


def clear_scratch() -> None:
    """Remove the tables that this process wrote with `via_table`; DataFrames read from them end with it."""
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    while _scratch and gateway is not None:
        path = gateway.jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        with contextlib.suppress(Exception):
            path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


atexit.register(clear_scratch)


def spread(df: DataFrame) -> DataFrame:
    """`df`, in at least as many partitions as there are cores.

    A scan of a few row groups has as few tasks; where costly work follows, its rows are dealt out first.
    A table of many row groups has enough partitions, and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder (survives the loss of any executor)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables written and read again."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Column pruning and filters still reach the copy, which a checkpointed RDD would not allow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _scratch.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
