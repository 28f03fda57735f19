"""Live price query and refresh batch as joins: cached where fresh, else computed, validated, flagged and saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.lexicon import Words
from marketlens.functions.rows import dealt
from marketlens.operators import fusion, history, matching, pricing, state

NOT_FOUND, UNAVAILABLE, FAILED = "not_found", "variant_unavailable", "search_failed"


def variant_key(product_id: Column, colour: Column, storage: Column) -> Column:
    """The key of a price record: the product, or product, colour and size in lower case where one of these is asked for."""
    asked = (F.coalesce(colour, F.lit("")) != "") | (F.coalesce(storage, F.lit("")) != "")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(asked, F.concat_ws(":", product_id.cast("string"), low(colour), low(storage))).otherwise(product_id.cast("string"))


def variant_error(error: Column, is_variant: Column) -> Column:
    """Of a query for a variant 'not found' means that the variant is not to be had."""
    return F.when(is_variant & (error == NOT_FOUND), UNAVAILABLE).otherwise(error)


def is_fresh(refreshed_at: Column, as_of: Column) -> Column:
    """Whether a record is under FRESH_HOURS old."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(refreshed_at.cast("timestamp"))
    return age < pricing.FRESH_HOURS * 3600


def price_query(requests: DataFrame, records: DataFrame, live: DataFrame, stores: DataFrame, as_of: Column, lex: Words = Words()) -> DataFrame:
    """Prices of each request from its record where that is fresh, else from what the stores gave.

    requests: key, search_terms, force; records and live: key, store_id, price,
    in_stock, matched_name, product_url, error, and for records suspicious,
    overpriced and refreshed_at. Cached rows are marked stale and then validated,
    their flags are kept; computed rows are validated and then flagged. A store
    that gave nothing becomes an error row.
    """
    fresh = records.filter(is_fresh(F.col("refreshed_at"), as_of)).select("key").distinct()
    cached = requests.filter(~F.coalesce("force", F.lit(False))).join(fresh, "key", "left_semi")
    old = pricing.mark_stale(cached.select("key", "search_terms").join(records, "key"), F.col("refreshed_at"), as_of)
    old = matching.nullify_bad_matches(old, lex).select("key", "store_id", "price", "in_stock", "error", pricing.flag("suspicious").alias("suspicious"), pricing.flag("overpriced").alias("overpriced"), "stale", F.lit(True).alias("from_cache"))
    open_ = requests.join(cached.select("key"), "key", "left_anti").select("key", "search_terms")
    enabled = stores.filter("enabled").select("store_id").distinct()
    found = open_.join(live.join(enabled, "store_id", "left_semi"), "key")
    # rows without a price count for no flag, so the stores that gave nothing need not pass the window
    new = pricing.flag_outliers(matching.nullify_bad_matches(found, lex).withColumnRenamed("key", "product_id")).withColumnRenamed("product_id", "key")
    new = new.select("key", "store_id", "price", "in_stock", "error", "suspicious", "overpriced", F.lit(False).alias("stale"), F.lit(False).alias("from_cache"))
    none = [F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ("price", "in_stock")]
    failed = pricing.missing_stores(open_.select("key"), stores, found, "key")
    failed = failed.select("key", "store_id", *none, F.lit(FAILED).alias("error"), *[F.lit(False).alias(c) for c in ("suspicious", "overpriced", "stale", "from_cache")])
    new = new.unionByName(failed)
    return old.unionByName(new)


def price_upsert(records: DataFrame, new: DataFrame, as_of: Column, key: str = "key") -> DataFrame:
    """New rows replace the whole record of their key and get the time; other records stay."""
    stamped = new.withColumn("refreshed_at", as_of).select(*records.columns)
    return records.join(new.select(key).distinct(), key, "left_anti").unionByName(stamped)


def reportable_errors(offers: DataFrame) -> DataFrame:
    """Offers whose error is more than that nothing was found."""
    return offers.filter(F.col("error").isNotNull() & ~F.col("error").isin(NOT_FOUND, UNAVAILABLE))


def mapping_candidates(offers: DataFrame) -> DataFrame:
    """Offers that tell which store product they are and how sure the match is."""
    return offers.filter("store_product_id is not null and confidence is not null")


def refresh(offers: DataFrame, tables: dict[str, DataFrame], as_of: Column, tasks: int | None = None) -> dict[str, DataFrame]:
    """One refresh of all products as one job: every table that a refresh changes, and the alerts that are due.

    offers: product_id, store_id, price, in_stock, error, store_product_id,
    confidence, suspicious, overpriced. tables: history, state, mappings, alerts.
    tasks: to how many tasks each join is dealt out; Spark decides without it.
    """
    day = as_of.cast("date")
    observed = offers.select("product_id", day.alias("day"), "store_id", "price").groupBy("product_id", "day", "store_id").agg(F.min("price").alias("price"))
    alert, mapping = ("product_id", "subscriber"), ("store_id", "store_product_id")
    summary = dealt(pricing.price_summary(offers), tasks, "product_id")
    found = mapping_candidates(offers).select("store_id", "store_product_id", "product_id", "confidence", F.col("product_id").alias("ord"))
    due = state.due_alerts(dealt(tables["alerts"], tasks, "product_id"), summary.select("product_id", "lowest_price"), as_of.cast("timestamp_ntz"))
    return {
        "history": history.retain(history.upsert(tables["history"], observed), day),
        "state": state.merge_state(dealt(tables["state"], tasks, "product_id"), summary, day),
        "errors": reportable_errors(offers).select("store_id", F.lit("scrape_failed").alias("error_type"), F.col("error").alias("message"), "product_id"),
        "mappings": state.merge_mappings(dealt(tables["mappings"], tasks, *mapping), dealt(found, tasks, *mapping)),
        "due": due,
        "alerts": state.mark_alerts(dealt(tables["alerts"], tasks, *alert), dealt(due.select(*alert), tasks, *alert), as_of.cast("timestamp_ntz")),
    }


def discovery_merge(existing: DataFrame, fresh: DataFrame, key: str = "fusion_key") -> DataFrame:
    """The catalogue after a discovery run: fresh products replace their ids, then each group of one key keeps its survivor.

    Groups are by this one key only. Products: id, family, image_url,
    enriched_at, specs, has_variant, search_terms, storage_options and the key.
    """
    return fusion.fused(fusion.merge_fresh(existing, fresh), key)
