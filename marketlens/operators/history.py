"""Price history: (product_id, day, store_id, price), kept for 90 days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETAIN_DAYS = 90


def retain(history: DataFrame, as_of: Column, days: int = RETAIN_DAYS) -> DataFrame:
    """Days not older than `days`; on a table partitioned by day this prunes partitions."""
    return history.filter(F.col("day") >= F.date_sub(as_of, days))


def upsert(history: DataFrame, new: DataFrame) -> DataFrame:
    """New prices replace those of the same product, day and store; the rest stays."""
    key = ["product_id", "day", "store_id"]
    return history.join(new, key, "left_anti").unionByName(new.select(*history.columns))


def range_scan(history: DataFrame, product_id: int, days: int, as_of: Column) -> DataFrame:
    """One product's rows of the last 1 to 90 days."""
    return retain(history.filter(F.col("product_id") == product_id), as_of, max(1, min(RETAIN_DAYS, days)))


def pivot_by_store(history: DataFrame, store_ids: list[int]) -> DataFrame:
    """A row per product and day, a column per listed store; no extra job to find the stores."""
    return history.groupBy("product_id", "day").agg(*[F.min(F.when(F.col("store_id") == s, F.col("price"))).alias(f"store_{s}") for s in store_ids])


def by_day(history: DataFrame) -> DataFrame:
    """A row per product and day with prices, a map from store to price; any number of stores."""
    return history.groupBy("product_id", "day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("store_id", "price")))).alias("prices"))


def global_minimum(history: DataFrame, stores: DataFrame) -> DataFrame:
    """The lowest positive price of each product over enabled stores: first day, then first store of equals."""
    enabled = stores.filter(F.coalesce("enabled", F.lit(True))).select("store_id")
    low = F.min(F.struct("price", "day", "store_id")).alias("m")
    return history.filter("price > 0").join(enabled, "store_id", "left_semi").groupBy("product_id").agg(low).select("product_id", "m.price", "m.day", "m.store_id")


def last_recorded(history: DataFrame) -> DataFrame:
    return history.filter("price is not null").groupBy("store_id").agg(F.max("day").alias("last_day"))
