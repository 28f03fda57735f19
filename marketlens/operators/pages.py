"""Device and manufacturer pages: gates of a search result, specification tables by section, structured product data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.rows import once

#: Words that make another model of a name: those of the tiers.
SUFFIXES = tuple(dict.fromkeys(w for t in T.TIERS for w in t.split()))
DESCRIPTION_CHARS = 500

_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_HEAD = r"(?is)<th\b[^>]*>(.*?)</th>"
_TITLE = r'(?is)<td\b[^>]*class="[^"]*ttl[^"]*"[^>]*>(.*?)</td>'
_INFO = r'(?is)<td\b[^>]*class="[^"]*nfo[^"]*"[^>]*>(.*?)</td>'


def _bare(html: Column) -> Column:
    return T.squeeze(T.decoded_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def name_has_brand(name: Column, brand: Column) -> Column:
    """Whether a device's name holds the brand; without a brand anything goes."""
    return brand.isNull() | F.contains(F.lower(name), F.lower(brand))


def models_fit_brand(models: Column, brand: Column) -> Column:
    """Whether the model codes do not belong to the other of the two makers whose codes are told apart."""
    samsung, apple = F.exists(models, lambda m: m.startswith("SM-")), F.exists(models, lambda m: m.rlike(r"^A\d{4}$"))
    return ~F.coalesce(((brand == "Apple") & samsung) | ((brand == "Samsung") & apple), F.lit(False))


def strict_model(wanted: Column, found: Column, brands: tuple[str, ...]) -> Column:
    """Whether the wanted model is in the found name, brands aside, and no suffix that makes it another model follows it."""
    makers = rf"(?i){T.B}(?:{'|'.join(brands)}){T.B}"
    plain = lambda c: T.squeeze(F.regexp_replace(F.lower(c), makers, "")) if brands else T.squeeze(F.lower(c))
    at = F.instr(plain(found), plain(wanted))
    after = F.substr(plain(found), at + F.length(plain(wanted)))
    return (at > 0) & ~after.rlike(rf"{T.B}(?:{'|'.join(SUFFIXES)}){T.B}")


def first_result(results: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """The first search result of each product that passes both gates and has a relative link. results: product_id, wanted, brand, pos, name, href."""
    fine = name_has_brand(F.col("name"), F.col("brand")) & strict_model(F.col("wanted"), F.col("name"), brands) & ~F.col("href").startswith("http")
    return results.filter(fine).groupBy("product_id").agg(F.min_by(F.struct("name", "href"), "pos").alias("m")).select("product_id", "m.name", "m.href")


def spec_rows(html: Column) -> Column:
    """(h, k, v) of the rows of specification tables: heading, title and information, each empty where the row has none."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(_ROW), 1),
        lambda r: F.struct(_bare(F.regexp_extract(r, _HEAD, 1)).alias("h"), _bare(F.regexp_extract(r, _TITLE, 1)).alias("k"), _bare(F.regexp_extract(r, _INFO, 1)).alias("v")),
    )


def by_section(rows: Column) -> Column:
    """(section, k, v) of spec_rows; a heading holds until the next one."""
    last = lambda i: F.try_element_at(F.filter(F.slice(rows, 1, i + 1)["h"], lambda h: h != ""), F.lit(-1))
    named = F.transform(rows, lambda r, i: F.struct(F.coalesce(last(i), F.lit("")).alias("section"), r["k"].alias("k"), r["v"].alias("v")))
    return F.filter(named, lambda r: (r["k"] != "") & (r["v"] != ""))


def device_pages(pages: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """page_id, name, specs (section, k, v) of the listed sections, models and images of device pages that have a name and fit the brand.

    pages: page_id, html, brand. Models are the codes in the row named Models.
    """
    html = F.coalesce("html", F.lit(""))
    name = _bare(F.regexp_extract(html, r'(?is)<h1\b[^>]*class="[^"]*specs-phone-name-title[^"]*"[^>]*>(.*?)</h1>', 1))
    images = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?is)<img\b[^>]*\bsrc="(https?://[^"]+)"'), 1))
    rows = once(pages.select("page_id", "html", "brand"), name=name, rows=spec_rows(html), images=images).drop("html")
    rows = once(rows, all=by_section(F.col("rows")))
    told = F.get(F.filter("all", lambda r: r["k"] == "Models")["v"], F.lit(0))
    codes = F.array_distinct(F.filter(F.split(F.coalesce(told, F.lit("")), r"[\s,;]+"), lambda m: m.rlike(r"^(SM-[A-Z0-9]+|A\d{4})$")))
    rows = once(rows, models=codes).filter((F.col("name") != "") & name_has_brand(F.col("name"), F.col("brand")) & models_fit_brand(F.col("models"), F.col("brand")))
    return rows.select("page_id", "name", F.filter("all", lambda r: r["section"].isin(*sections)).alias("specs"), "models", "images")


def json_ld_products(pages: DataFrame) -> DataFrame:
    """The first Product block of each page with properties or images: page_id, name, specs (map), images, model, description."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_BLOCK), 1)).alias("pos", "raw")).withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    listed = lambda path: F.try_variant_get("v", path, "array<variant>")
    nodes = blocks.select("page_id", "pos", F.posexplode(F.coalesce(listed("$"), listed("$['@graph']"), F.array("v"))).alias("at", "n"))
    get = lambda path, kind="string": F.try_variant_get("n", path, kind)
    rows = nodes.filter(get("$['@type']") == "Product").select(
        "page_id", "pos", "at", get("$.name").alias("name"), get("$.additionalProperty", "array<struct<name:string,value:string>>").alias("properties"),
        F.coalesce(get("$.image", "array<string>"), F.transform(get("$.image", "array<struct<url:string>>"), lambda i: i["url"]), F.array(get("$.image"))).alias("images"),
        F.coalesce(*[F.nullif(get(f"$.{k}"), F.lit("")) for k in ("model", "sku", "mpn", "gtin")], F.lit("")).alias("model"), F.substring(get("$.description"), 1, DESCRIPTION_CHARS).alias("description"),
    )
    said = F.filter(F.coalesce("properties", F.array().cast("array<struct<name:string,value:string>>")), lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    last = F.filter(said, lambda p, i: ~F.exists(F.slice(said, i + 2, F.greatest(F.size(said) - i - 1, F.lit(0))), lambda q: q["name"] == p["name"]))
    rows = rows.withColumns({"specs": F.map_from_entries(last), "images": F.filter("images", lambda u: F.coalesce(u.startswith("http"), F.lit(False)))})
    rows = rows.filter((F.size("specs") > 0) | (F.size("images") > 0))
    # maps do not compare, so the place alone decides
    kept = F.struct("name", "specs", "images", "model", "description")
    return rows.groupBy("page_id").agg(F.min_by(kept, F.struct("pos", "at")).alias("m")).select("page_id", "m.*")


def is_console(family: Column, platforms: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Whether a name is a console itself: without platform names, words of its parts, sizes and what follows a plus hardly a letter is left."""
    words = lambda w: rf"(?i){T.B}(?:{'|'.join(w)}){T.B}"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(family, r"^(.*?)(?:\s*\+|$)", 1), words(platforms), ""), words(parts), "")
    rest = T.squeeze(F.regexp_replace(F.regexp_replace(rest, rf"(?i){T.B}\d+\s*(gb|tb){T.B}", ""), "(?i)[^a-z ]", " "))
    return F.length(rest) < 3


def without_prefix(body: Column) -> Column:
    """A JSON response without the characters that stand before its first bracket to keep scripts from reading it."""
    return F.regexp_replace(body, r"^[^\[{]*", "")


def timeline_means(responses: DataFrame) -> DataFrame:
    """product_id and score: the mean of a keyword's points, halves rounded up; 0 without points or where the response cannot be read.

    responses: keywords (array of product ids in the order of the response), body.
    """
    points = F.from_json(without_prefix(F.col("body")), "default struct<timelineData:array<struct<value:array<double>>>>")["default"]["timelineData"]["value"]
    rows = responses.select(F.posexplode("keywords").alias("at", "product_id"), points.alias("points"))
    own = F.array_compact(F.transform("points", lambda p: F.get(p, F.col("at"))))
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)
    return rows.select("product_id", F.when(F.size(own) > 0, T.round_half_up(mean)).otherwise(0).cast("long").alias("score"))


def cached_at(rows: DataFrame, column: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of a cache that are no older than so many hours."""
    return rows.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
