"""JSON files as tables: whole-file scans with a declared schema, overwrites, and nested maps as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """The rows of JSON files; a path that is not there is an empty table, unreadable fields are null."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(rows: DataFrame, path: str) -> None:
    """Replace what is at the path."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested_history(files: DataFrame) -> DataFrame:
    """product_id, day, store_id, price from maps of maps of maps. files: prices map<string,map<string,map<string,double>>>."""
    by_product = files.select(F.explode("prices").alias("product_id", "days"))
    by_day = by_product.select("product_id", F.explode("days").alias("day", "stores"))
    return by_day.select("product_id", F.to_date("day").alias("day"), F.explode("stores").alias("store_id", "price"))
