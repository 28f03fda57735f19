"""Semi-structured extraction: links, lists and text of HTML, JSON-LD offers, specification lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as T

_LINK = r'(?is)<a\b[^>]*\bhref="([^"]*)"'
_ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"
_JSON_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_LINK), 1)


def plain(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    return T.squeeze(T.decoded_entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def list_items(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(_ITEM), 1), lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")))


def json_ld_offers(pages: DataFrame) -> DataFrame:
    """The first Product block of each page with a readable price: page_id, name, price, in_stock.

    Blocks may be an object, an array or a @graph; VARIANT takes all three.
    """
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_JSON_LD), 1)).alias("pos", "raw"))
    blocks = blocks.withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    as_list = lambda path: F.try_variant_get("v", path, "array<variant>")
    nodes = blocks.select("page_id", "pos", F.posexplode(F.coalesce(as_list("$"), as_list("$['@graph']"), F.array("v"))).alias("at", "n"))
    get = lambda path, kind="string": F.try_variant_get("n", path, kind)
    price = T.numeric_prefix(F.coalesce(get("$.offers.price"), get("$.offers[0].price"), get("$.offers.lowPrice")))
    stock = F.coalesce(get("$.offers.availability"), get("$.offers[0].availability"))
    found = nodes.filter(get("$['@type']") == "Product").select("page_id", "pos", "at", get("$.name").alias("name"), price.alias("price"), F.when(stock.contains("InStock"), True).when(stock.contains("OutOfStock"), False).alias("in_stock"))
    first = F.min(F.struct("pos", "at", "name", "price", "in_stock")).alias("m")
    return found.filter("price is not null").groupBy("page_id").agg(first).select("page_id", "m.name", "m.price", "m.in_stock")


def stock_from_html(html: Column) -> Column:
    """Three states from an ordered cascade of signals."""
    low = F.lower(html)
    return (
        F.when(low.contains("schema.org/instock"), True).when(low.contains("schema.org/outofstock"), False)
        .when(low.rlike("delivery-not-available|sold-out"), False).when(low.rlike("delivery-available|add-to-cart"), True)
    )


def spec_sections(specs: DataFrame) -> DataFrame:
    """Specification entries by section: the key up to the first colon, else 'Tjera'. specs: id, specs (array of k, v)."""
    rows = specs.select("id", F.posexplode("specs").alias("pos", "s"))
    cut = F.instr("s.k", ":")
    section = F.when(cut > 0, F.trim(F.substr("s.k", F.lit(1), cut - 1))).otherwise("Tjera")
    key = F.when(cut > 0, F.trim(F.substr("s.k", cut + 1))).otherwise(F.col("s.k"))
    rows = rows.select("id", "pos", section.alias("section"), key.alias("k"), F.col("s.v").alias("v"))
    return rows.groupBy("id", "section").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "k", "v"))).alias("items"))


def key_values(items: Column) -> Column:
    """'key: value' lines as a map, first key wins."""
    pairs = F.filter(items, lambda x: x.rlike(r"^[^:]{1,60}:\s*\S"))
    keyed = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, 1, i), lambda p: p["k"] == e["k"])))
