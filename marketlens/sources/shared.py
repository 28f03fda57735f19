"""The folder that driver and executors share, and rows settled in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would be another folder on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: later plans start there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, for any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    """Removes what is at the path, if anything."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)
