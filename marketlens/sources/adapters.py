"""The driver's star schema seen as the price-intelligence domain.

Every adapter is a projection or one aggregation of a scan, so filters on its
columns reach parquet. ``as_of`` is always the last day in the data, never the
wall clock.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.rows import dealt
from marketlens.sources.tables import table


def _day() -> Column:
    return F.col("l_shipdate").cast("date")


def products(spark: SparkSession, d: str) -> DataFrame:
    """id, family, brand, category, subcategory, list_price, model_number, search_terms."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("family"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.when(size <= 10, "Compact").when(size <= 30, "Standard").otherwise("Large").alias("subcategory"),
        F.col("p_retailprice").alias("list_price"), size.cast("string").alias("model_number"),
        F.array("p_name", F.concat_ws(" ", "p_brand", "p_name")).alias("search_terms"),
    )


def stores(spark: SparkSession, d: str) -> DataFrame:
    """store_id, store_name, enabled: a small dimension."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), (F.col("s_acctbal") >= 0).alias("enabled"))


def in_stock() -> Column:
    """Three states: open lines are in stock, unreturned finished ones unknown, the rest not."""
    return F.when(F.col("l_linestatus") == "O", True).when(F.col("l_returnflag") == "N", None).otherwise(False)


def observations(spark: SparkSession, d: str) -> DataFrame:
    """product_id, store_id, day, price, in_stock, order_id, line: every offer ever seen."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"), _day().alias("day"), F.col("l_extendedprice").alias("price"),
        in_stock().alias("in_stock"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
    )


def offers(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """The current offer of each product and store: latest day, then lowest price, order and line.

    One maximum over a struct: one shuffle, of a row per key and task. Spark keeps structs in sorted aggregation, so a
    task sorts its rows by key. tasks: to how many tasks the observations are dealt out first.
    """
    latest = F.max(F.struct("day", (-F.col("price")).alias("p"), (-F.col("order_id")).alias("o"), (-F.col("line")).alias("l"), "price", "in_stock")).alias("m")
    return dealt(observations(spark, d), tasks, "product_id", "store_id").groupBy("product_id", "store_id").agg(latest).select("product_id", "store_id", "m.price", "m.day", "m.in_stock")


def history(spark: SparkSession, d: str) -> DataFrame:
    """product_id, day, store_id, price: the lowest price of each day."""
    return observations(spark, d).groupBy("product_id", "day", "store_id").agg(F.min("price").alias("price"))


def last_day(spark: SparkSession, d: str) -> date:
    """The last day in the data; one aggregate over one column."""
    return table(spark, d, "lineitem").agg(F.max(_day())).first()[0]


def as_of(spark: SparkSession, d: str) -> Column:
    """The last day in the data as a literal."""
    return F.lit(last_day(spark, d))


def catalogue_state(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """product_id, lowest_price, store_count, last_seen, status. tasks: to how many tasks the observations are dealt out first, by product and store, as a product may have many."""
    found = dealt(observations(spark, d), tasks, "product_id", "store_id").groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.count_distinct("store_id").alias("store_count"), F.max("day").alias("last_seen"))
    return found.withColumn("status", F.lit("discovered"))


def alerts(spark: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """product_id, subscriber, threshold, last_notified: one per product and customer. tasks: to how many tasks its join and its sums are dealt out."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("subscriber"), F.col("o_orderdate").alias("at"))
    seen = dealt(observations(spark, d).select("order_id", "product_id", "price"), tasks, "order_id").join(dealt(orders, tasks, "order_id"), "order_id")
    return dealt(seen, tasks, "product_id", "subscriber").groupBy("product_id", "subscriber").agg(
        F.floor(F.max("price")).cast("long").alias("threshold"), F.max("at").alias("last_notified")
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def scraper_errors(spark: SparkSession, d: str) -> DataFrame:
    """id, store_id, message, occurred_at."""
    return events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 6).alias("store_id"), F.col("props").alias("message"), F.col("ts").alias("occurred_at"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """service, id, at, status: 'down' for an error event, else 'up'."""
    return events(spark, d).select(F.col("user_id").alias("service"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "down").otherwise("up").alias("status"))


def trends(spark: SparkSession, d: str) -> DataFrame:
    """product_id, score: mean interest, halves rounded up."""
    key = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).filter(key.isNotNull()).groupBy(key.alias("product_id")).agg(F.floor(F.avg("value") + 0.5).cast("long").alias("score"))


