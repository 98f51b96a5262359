"""Intermediate results in storage that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[tempfile.TemporaryDirectory] = []
#: Whether a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The driver's heap is collected where it takes more than one part in so many of what it may take.
_HEAP = 3


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a local one only where that is unset and everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
    if not base:
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="fernglass-"))
        base = _own[0].name
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages and retries start from the files, so a
    lost executor never means computing the whole lineage again.

    Nothing goes back behind the files, so the shuffles that led to them are removed; otherwise they would stay on the
    executors' disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _shrink(spark)
    return spark.read.schema(df.schema).parquet(path)


def _shrink(spark: SparkSession) -> None:
    """Give back what the plans and tasks of ended jobs took of the driver's memory: a heap that has grown stays so until
    a full collection, and the next job's garbage comes on top of it."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * _HEAP > runtime.maxMemory():
        jvm.java.lang.System.gc()
