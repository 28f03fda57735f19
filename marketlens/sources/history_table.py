"""Price history as a table partitioned by day.

An upsert rewrites only the days that it has rows for (dynamic partition
overwrite), retention drops whole days without reading them, and a range of days
reads only their partitions.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.rows import dealt
from marketlens.operators import history
from marketlens.sources.shared import file_system

SCHEMA = "product_id long, store_id long, price double, day date"


class HistoryTable:
    """product_id, store_id, price by day, under a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, keep_days: int = history.RETAIN_DAYS):
        self.spark, self.path, self.schema, self.keep_days = spark, path.rstrip("/"), schema, keep_days

    def days(self) -> list[date]:
        """The days that are there, from the names of the partitions: no file is read."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        return sorted(date.fromisoformat(n.removeprefix("day=")) for n in names if n.startswith("day="))

    def read(self) -> DataFrame:
        """All rows; a filter on day prunes partitions."""
        if not self.days():
            return self.spark.createDataFrame([], self.schema).select("product_id", "day", "store_id", "price")
        return self.spark.read.schema(self.schema).parquet(self.path).select("product_id", "day", "store_id", "price")

    def upsert(self, new: DataFrame, as_of: date, tasks: int | None = None) -> list[date]:
        """New prices replace those of the same product, day and store; days out of retention are not written, and dropped where they are. Returns the days rewritten.

        Of repeated keys in ``new`` the lowest price counts (null after all
        others). A failed job leaves the table as it was: files are staged and
        put in place when all are written. tasks: to how many tasks the join is
        dealt out; Spark decides without it.
        """
        key = ("product_id", "day", "store_id")
        oldest = as_of - timedelta(days=self.keep_days)
        new = dealt(new.filter(F.col("day") >= F.lit(oldest)), tasks, *key).groupBy(*key).agg(F.min("price").alias("price"))
        touched = [r.day for r in new.select("day").distinct().collect()]  # no more than keep_days and those ahead
        if touched:
            rows = history.upsert(dealt(self.read().filter(F.col("day").isin(touched)), tasks, *key), new)
            # a day may be large: rebalance splits it into files of even size, and joins small ones
            rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        self.prune(as_of)
        return sorted(touched)

    def prune(self, as_of: date) -> list[date]:
        """Drops the partitions older than keep_days, and names them."""
        oldest = as_of - timedelta(days=self.keep_days)
        gone = [day for day in self.days() if day < oldest]
        for day in gone:
            fs, at = file_system(self.spark, f"{self.path}/day={day.isoformat()}")
            fs.delete(at, True)
        return gone

    def range(self, as_of: Column | date, days: int, product_id: int | None = None) -> DataFrame:
        """The rows of the last 1 to keep_days days, of one product if given."""
        rows = history.retain(self.read(), F.lit(as_of), max(1, min(self.keep_days, days)))
        return rows if product_id is None else rows.filter(F.col("product_id") == product_id)
