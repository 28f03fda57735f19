"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the directory, by Spark's reader, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
