"""Ranked catalogue search, facets, filters, sorts and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 40


def parse_query(query: str) -> tuple[str, list[str]]:
    q = query.lower().strip()
    return q, q.split()


def _field_hit(word: str) -> Column:
    """A word must lie inside one field; the search terms count as one text."""
    fields = [F.lower("family"), F.lower("brand"), F.lower(F.coalesce("model_number", F.lit(""))), F.lower(F.concat_ws(" ", "search_terms"))]
    hit = F.lit(False)
    for field in fields:
        hit = hit | field.contains(word)
    return hit


def search(products: DataFrame, query: str) -> DataFrame:
    """Products that hold every word, with score: phrase, words, prefix and share of the name found, less its length."""
    q, words = parse_query(query)
    if not words:
        return products.withColumn("score", F.lit(0.0)).limit(0)
    family = F.lower("family")
    hits = sum((F.when(family.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    score = (
        F.when(family.contains(q), 100.0).otherwise(0.0) + hits * 10 + F.when(hits == len(words), 20).otherwise(0) + F.when(family.startswith(q), 30).otherwise(0)
        + hits / F.size(F.split(family, r"\s+")) * 20 - F.length("family") * 0.15
    )
    gate = F.lit(True)
    for w in words:
        gate = gate & _field_hit(w)
    return products.filter(gate).withColumn("score", score)


@dataclass(frozen=True)
class Filters:
    subcategory: str | None = None
    brands: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    in_stock: bool = False


def apply_filters(summary: DataFrame, f: Filters) -> DataFrame:
    """Facet filters; once a price bound is set, rows without a price go."""
    if f.subcategory:
        summary = summary.filter(F.col("subcategory") == f.subcategory)
    if f.brands:
        summary = summary.filter(F.col("brand").isin(*f.brands))
    if f.least:
        summary = summary.filter(F.col("best_price") >= f.least)
    if f.most:
        summary = summary.filter(F.col("best_price") <= f.most)
    return summary.filter("in_stock") if f.in_stock else summary


ORDERS = {
    "price_asc": lambda: [F.col("best_price").asc_nulls_last()],
    "price_desc": lambda: [F.col("best_price").desc_nulls_last()],
    "stores": lambda: [F.col("store_count").desc()],
    "az": lambda: [F.col("family").asc()],
}


def page(summary: DataFrame, order: str, pages: int = 1, tie: str = "id") -> DataFrame:
    """The first pages of a sort, by a top-k that keeps `pages * PAGE` rows per task."""
    return summary.orderBy(*ORDERS[order](), F.col(tie)).limit(pages * PAGE)


def collated_page(summary: DataFrame, after: tuple | None = None, column: str = "family", collation: str = "UNICODE", size: int = PAGE, tie: str = "id") -> DataFrame:
    """The next rows by a name in the order of a language, as ``collation`` has it: accents and case only part what is otherwise equal.

    after: name and tie of the last row of the page before; the rows up to it are
    filtered out and not sorted again. Names that the collation takes for equal
    go by tie; rows without a name come last.
    """
    name = F.collate(column, collation)
    rows = summary
    if after is not None:
        last, at = after
        beyond = F.col(tie) > at
        if last is None:
            rows = rows.filter(F.col(column).isNull() & beyond)
        else:
            key = F.collate(F.lit(last), collation)
            rows = rows.filter((name > key) | ((name == key) & beyond) | F.col(column).isNull())
    return rows.orderBy(name.asc_nulls_last(), F.col(tie)).limit(size)


def brand_facet(summary: DataFrame) -> DataFrame:
    return summary.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


def price_range(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.min("best_price"), F.lit(0.0)).alias("least"), F.coalesce(F.max("best_price"), F.lit(0.0)).alias("most"))


def subcategories(summary: DataFrame) -> DataFrame:
    return summary.select("subcategory").distinct().filter("subcategory <> ''")


FIRST_BRANDS, LEAST_QUERY, SUGGESTIONS = 15, 2, 6


def in_category(products: DataFrame, category: str) -> DataFrame:
    return products.filter(F.col("category") == category)


def autocomplete(products: DataFrame, query: str, least: int = LEAST_QUERY, k: int = SUGGESTIONS) -> DataFrame:
    """The best products of a query; of a query of fewer than ``least`` characters none."""
    found = search(products, query if len(query.strip()) >= least else "")
    return found.orderBy(F.desc("score"), "id").limit(k)


def categories(products: DataFrame) -> DataFrame:
    """category and its subcategories, sorted: a small dimension."""
    return products.groupBy("category").agg(F.array_sort(F.collect_set("subcategory")).alias("subcategories"))


def matching_categories(known: DataFrame, query: str) -> DataFrame:
    """Categories whose name or one of whose subcategories holds the query."""
    q = query.strip().lower()
    return known.filter(F.lower("category").contains(q) | F.exists("subcategories", lambda s: F.lower(s).contains(q)))


def price_bound(text: Column) -> Column:
    """The leading integer of what was typed; none, or 0, is no bound."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("int"), F.lit(0))


def visible_brands(facet: DataFrame, query: str = "", first: int = FIRST_BRANDS) -> DataFrame:
    """Brands that hold the query, else the first by count."""
    return facet.filter(F.lower("brand").contains(query.lower())) if query else facet.orderBy(F.desc("n"), "brand").limit(first)


def offer_table(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """product_id, store_id, store_name (else the id), price and place: cheapest first, without a price last."""
    named = offers.join(stores.select("store_id", "store_name"), "store_id", "left")
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("price").asc_nulls_last(), "store_id"))
    return named.select("product_id", "store_id", F.coalesce("store_name", F.col("store_id").cast("string")).alias("store_name"), "price", place.cast("long").alias("place"))
