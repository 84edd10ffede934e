"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent on one machine, as in tests, a folder of our own
    is set; a cluster without it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def _place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading it again.

    Written files outlive lost executors, unlike local checkpoints and caches.
    They are deleted by ``discard``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, held = _place(spark, path)
    files.deleteOnExit(held)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in frames:
        files, held = _place(df.sparkSession, df.written_to)
        files.delete(held, True)


def clear(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing holds any more; else they stay until the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
