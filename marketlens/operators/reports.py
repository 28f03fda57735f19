"""Operational roll-ups: coverage, health, statistics, trends and the featured set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL, PAGE = 24, 8


def live_state(state: DataFrame) -> DataFrame:
    return state.filter("status <> 'discontinued' and lowest_price is not null").withColumn("store_count", F.coalesce("store_count", F.lit(1)))


def coverage_rows(state: DataFrame, products: DataFrame) -> DataFrame:
    """Live products that are in the catalogue, with their store count."""
    return live_state(state).join(products, F.col("product_id") == F.col("id")).select("id", "brand", "family", "category", "store_count", "lowest_price")


def store_coverage(rows: DataFrame) -> DataFrame:
    """How many products each store count has, with the totals over all."""
    by = rows.groupBy("store_count").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("store_count") >= 2).alias("multi_store"), F.count_if(F.col("store_count") == 1).alias("single_store"))
    return by.crossJoin(total)  # one row


def coverage_detail(rows: DataFrame, limit: int = 500, most: int | None = None) -> DataFrame:
    """The least covered products first, 1 to 5000 of them."""
    rows = rows if most is None else rows.filter(F.col("store_count") <= most)
    return rows.orderBy("store_count", "brand", "family", "id").limit(max(1, min(5000, limit)))


def health(stores: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Every enabled store with its last price day; ok if that is under a day old."""
    seen = history.filter("price is not null").groupBy("store_id").agg(F.max("day").alias("last_day"))
    ok = F.coalesce(F.datediff(as_of, F.col("last_day")) < 1, F.lit(False))
    return stores.filter(F.coalesce("enabled", F.lit(True))).join(seen, "store_id", "left").select("store_id", "store_name", "last_day", ok.alias("ok"))


def overall_health(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("last_day").alias("last_update"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.count(F.lit(1)).alias("stores"))


def admin_stats(products: DataFrame, state: DataFrame, errors: DataFrame, mappings: DataFrame, now: Column) -> DataFrame:
    """One row of counters from four tables, each aggregated on its own."""
    return (
        products.agg(F.count(F.lit(1)).alias("total_products"))
        .crossJoin(state.agg(F.count_if(F.col("status") == "discontinued").alias("discontinued")))
        .crossJoin(mappings.agg(F.count_if(F.col("status") == "pending").alias("pending_mappings")))
        .crossJoin(errors.agg(F.count_if(F.col("occurred_at") > now - F.expr("INTERVAL 24 HOURS")).alias("recent_errors")))
    )


def trend_candidates(products: DataFrame, coverage: DataFrame, k: int = 50) -> DataFrame:
    """The k products with most stores, by their count of good prices."""
    n = F.coalesce("store_count", F.lit(0))
    return products.join(coverage.withColumnRenamed("product_id", "id"), "id", "left").select("id", "family", n.alias("store_count")).orderBy(F.desc("store_count"), "id").limit(k)


def featured_by_trend(products: DataFrame, trends: DataFrame, k: int = PAGE) -> DataFrame:
    score = F.coalesce("score", F.lit(0))
    return products.join(trends.withColumnRenamed("product_id", "id"), "id", "left").select("id", "family", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def featured_rotation(products: DataFrame, rolled: DataFrame, day: Column) -> DataFrame:
    """A page of 8 that turns daily through the 24 products with stock and most stores."""
    stock, n = F.coalesce("any_stock", F.lit(False)), F.coalesce("store_count", F.lit(0))
    pool = products.join(rolled.withColumnRenamed("product_id", "id"), "id", "left").select("id", "family", stock.alias("in_stock"), n.alias("store_count"))
    pool = pool.orderBy(F.desc("in_stock"), F.desc("store_count"), "id").limit(POOL)
    place = F.row_number().over(Window.orderBy(F.desc("in_stock"), F.desc("store_count"), "id")) - 1  # over at most POOL rows
    first = F.dayofyear(day) % (POOL // PAGE) * PAGE
    return pool.withColumn("place", place).filter((F.col("place") >= first) & (F.col("place") < first + PAGE))


def weighted_run_time(samples: DataFrame, key: str, last: int = 10) -> DataFrame:
    """Mean of the last samples with weights 1 to n, the newest heaviest. samples: key, at, id, value."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id")))
    own = samples.withColumn("back", newest).filter(F.col("back") <= last)
    weight = F.count(F.lit(1)).over(Window.partitionBy(key)) - F.col("back") + 1
    return own.withColumn("w", weight).groupBy(key).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("estimate"), F.count(F.lit(1)).alias("samples"))
