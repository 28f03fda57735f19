"""Offer predicates, summaries and flags.

Offers have product_id, store_id, price and in_stock; flags are nullable
booleans, where absent means false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, LEAST_OFFERS = -0.4, 0.6, 3
STALE_HOURS, FRESH_HOURS = 24, 2
#: Arrays that the stores are dealt into for a grid of products and stores.
STORE_BLOCKS = 64


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


#: The notions of a valid price stay apart on purpose; each caller has its own.
PREDICATES = {
    "v1": lambda: F.col("price").isNotNull(),
    "v2": lambda: F.coalesce(F.col("price") > 0, F.lit(False)),
    "v3": lambda: F.col("price").isNotNull() & ~flag("suspicious"),
    "v4": lambda: F.col("price").isNotNull() & ~flag("suspicious") & ~flag("overpriced"),
    "v5": lambda: F.col("price").isNotNull() & ~flag("suspicious") & ~flag("overpriced") & ~flag("stale"),
    "v6": lambda: F.coalesce(F.col("price") > 0, F.lit(False)) & F.coalesce(F.col("enabled"), F.lit(True)),
}


def flag_outliers(offers: DataFrame) -> DataFrame:
    """Adds suspicious and overpriced: more than 40 % below or 60 % above the mean of the product's positive prices, of which there must be 3."""
    product = Window.partitionBy("product_id")
    positive = F.when(F.col("price") > 0, F.col("price"))
    off = F.when((F.col("price") > 0) & (F.count(positive).over(product) >= LEAST_OFFERS), (F.col("price") - F.avg(positive).over(product)) / F.avg(positive).over(product))
    return offers.withColumns({"suspicious": F.coalesce(off < LOW, F.lit(False)), "overpriced": F.coalesce(off > HIGH, F.lit(False))})


def mark_stale(offers: DataFrame, refreshed_at: Column, as_of: Column) -> DataFrame:
    """Adds stale: a price whose record is 24 hours old or older."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(refreshed_at.cast("timestamp"))
    return offers.withColumn("stale", F.col("price").isNotNull() & (age >= STALE_HOURS * 3600))


def price_summary(offers: DataFrame) -> DataFrame:
    """product_id, lowest_price, store_count over prices that are not suspicious; no row where none is left."""
    return offers.filter(PREDICATES["v3"]()).groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.count(F.lit(1)).alias("store_count"))


def best_store(offers: DataFrame) -> DataFrame:
    """The cheapest store of each product over prices without flags; of equal prices the last store."""
    best = F.max(F.struct((-F.col("price")).alias("p"), "store_id", "price")).alias("b")  # ids may be texts
    return offers.filter(PREDICATES["v4"]()).groupBy("product_id").agg(best).select("product_id", F.col("b.price").alias("best_price"), F.col("b.store_id").alias("best_store"))


def offer_rollup(offers: DataFrame) -> DataFrame:
    """Best price, stores with a price, and whether any store has stock (over all offers)."""
    has = PREDICATES["v1"]()
    return offers.groupBy("product_id").agg(
        F.min(F.when(has, F.col("price"))).alias("best_price"), F.count_if(has).alias("store_count"), F.bool_or(F.coalesce("in_stock", F.lit(False))).alias("any_stock")
    )


def missing_stores(keys: DataFrame, stores: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The columns of keys and store_id: a row for every enabled store that a key has no row of in ``found`` (key, store_id).

    The stores lie in STORE_BLOCKS arrays, which are broadcast; a key's own
    stores are taken from each and the rest is unfolded, so the rows that come
    out are neither shuffled nor sorted, however many they are. A store that is
    listed twice is one store; a null key has no row in found.
    """
    blocks = stores.filter("enabled").groupBy(F.pmod(F.xxhash64("store_id"), F.lit(STORE_BLOCKS))).agg(F.collect_set("store_id").alias("_block"), F.max(F.col("store_id").isNull()).alias("_null"))
    blocks = blocks.select(F.when(F.col("_null"), F.concat("_block", F.array(F.lit(None)))).otherwise(F.col("_block")).alias("_block"))
    own = found.groupBy(key).agg(F.collect_set("store_id").alias("_own"))
    rows = keys.join(own, key, "left").withColumn("_own", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)))
    return rows.crossJoin(F.broadcast(blocks)).select(*keys.columns, F.explode(F.array_except("_block", "_own")).alias("store_id"))


def with_missing_stores(products: DataFrame, stores: DataFrame, offers: DataFrame) -> DataFrame:
    """A row per product and enabled store; a store without an offer gets an error row."""
    keys, enabled = products.select("product_id"), stores.filter("enabled").select("store_id").distinct()
    found = keys.join(offers.join(enabled, "store_id", "left_semi"), "product_id").select("product_id", "store_id", "price", "in_stock", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("price", "in_stock")]
    return found.unionByName(missing_stores(keys, stores, found, "product_id").select("product_id", "store_id", *none, F.lit("not_found").alias("error")))


def product_summary(products: DataFrame, offers: DataFrame, state: DataFrame) -> DataFrame:
    """Products with best price, store count and stock; the catalogue state fills in where there is no offer."""
    rolled = offer_rollup(offers).withColumnRenamed("product_id", "id")
    known = state.filter("status <> 'discontinued' and lowest_price is not null").select(F.col("product_id").alias("id"), "lowest_price", F.col("store_count").alias("state_stores"))
    out = products.join(rolled, "id", "left").join(known, "id", "left")
    return out.select(
        "id", "family", "brand", "category", "subcategory", F.coalesce("best_price", "lowest_price").alias("best_price"),
        F.when(F.col("best_price").isNotNull(), F.col("store_count")).otherwise(F.coalesce("state_stores", F.lit(0))).alias("store_count"), F.coalesce("any_stock", F.lit(False)).alias("in_stock"),
    )


def offer_listing(products: DataFrame, offers: DataFrame, state: DataFrame, refreshed: DataFrame) -> DataFrame:
    """product_summary with store_ids, the stores with a price (cheapest first), and refreshed_at of the product's record.

    refreshed: product_id, refreshed_at. A product without a price has no store.
    """
    priced = offers.filter(PREDICATES["v1"]()).groupBy(F.col("product_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("price", "store_id"))), lambda o: o["store_id"]).alias("store_ids"))
    last = refreshed.groupBy(F.col("product_id").alias("id")).agg(F.max("refreshed_at").alias("refreshed_at"))
    out = product_summary(products, offers, state).join(priced, "id", "left").join(last, "id", "left")
    kind = dict(priced.dtypes)["store_ids"]
    return out.withColumn("store_ids", F.coalesce("store_ids", F.array().cast(kind)))


def cheapest_marker(offers: DataFrame) -> DataFrame:
    """Adds cheapest: whether the price is the product's lowest."""
    return offers.withColumn("cheapest", F.coalesce(F.col("price") == F.min("price").over(Window.partitionBy("product_id")), F.lit(False)))


def flagged(offers: DataFrame, products: DataFrame) -> DataFrame:
    """A row per flag that is set, with the product's name or else its id."""
    rows = offers.select("product_id", "store_id", "price", F.explode(F.array_compact(F.array(F.when(flag("suspicious"), F.lit("suspicious")), F.when(flag("overpriced"), F.lit("overpriced"))))).alias("reason"))
    names = products.select(F.col("id").alias("product_id"), "family")
    return rows.join(names, "product_id", "left").select("product_id", "store_id", "price", "reason", F.coalesce("family", F.col("product_id").cast("string")).alias("name"))
