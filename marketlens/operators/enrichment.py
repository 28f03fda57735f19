"""Enrichment: specifications from names and pages, regions from model codes, source priority, input checks and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as T

#: Specification patterns of this library, in order: key, pattern of the value.
SPECS = (
    ("RAM", r"(?i)(\d+\s*gb)\s*(?:ram|ddr\d)"),
    ("Screen", r"""(\d{1,2}(?:\.\d{1,2})?)\s*(?:"|″|inch)"""),
    ("Resolution", rf"(?i){T.B}(8k|4k|uhd|qhd|full hd|fhd){T.B}"),
    ("Panel", rf"(?i){T.B}(oled|qled|amoled|ips|led){T.B}"),
    ("Volume", rf"(?i){T.B}(\d+(?:\.\d+)?)\s*(?:l|liter|litra){T.B}"),
    ("Power", rf"(?i){T.B}(\d+)\s*w{T.B}"),
)
MOST_IMAGES = 8
DESCRIPTION_CHARS = 500

_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"
_TERM = r"(?is)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>.*?</dd>"
_DEFINED = r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>(.*?)</dd>"
_IMAGE = r"""(?is)<img\b[^>]*\bsrc=["'](https?://[^"']*)["']"""


def _bare(html: Column) -> Column:
    return T.squeeze(T.decoded_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def specs_from_name(name: Column, colours: tuple = (), patterns=SPECS) -> Column:
    """A map of what a product name says of its specifications; empty if it says nothing."""
    value = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    found = [("Storage", T.storage_size(F.regexp_replace(name, SPECS[0][1], " "))), *((k, value(p)) for k, p in patterns), ("Colour", T.colour(name, colours))]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in found])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def table_pairs(html: Column) -> Column:
    """(k, v) of table rows of two cells and of definition lists, in that order; blank sides are left out."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(_ROW), 1), lambda r: F.regexp_extract_all(r, F.lit(_CELL), 1))
    pairs = F.transform(F.filter(rows, lambda c: F.size(c) == 2), lambda c: F.struct(_bare(c[0]).alias("k"), _bare(c[1]).alias("v")))
    defined = F.arrays_zip(F.regexp_extract_all(html, F.lit(_TERM), 1).alias("k"), F.regexp_extract_all(html, F.lit(_DEFINED), 1).alias("v"))
    defined = F.transform(defined, lambda p: F.struct(_bare(p["k"]).alias("k"), _bare(p["v"]).alias("v")))
    return F.filter(F.concat(pairs, defined), lambda p: (p["k"] != "") & (p["v"] != ""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, or null."""
    tag = F.regexp_extract(html, rf"""(?is)(<meta\b[^>]*\b(?:property|name)=["']{name}["'][^>]*>)""", 1)
    return F.nullif(T.decoded_entities(F.regexp_extract(tag, r"""(?is)\bcontent=["']([^"']*)["']""", 1)), F.lit(""))


def page_details(pages: DataFrame) -> DataFrame:
    """page_id, title, description, images (distinct, MOST_IMAGES at most) and pairs of each page; nulls and blanks give null or nothing."""
    html = F.coalesce("html", F.lit(""))
    title = F.nullif(_bare(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))
    shown = F.filter(F.array(meta(html, "og:image")), lambda u: u.isNotNull())
    images = F.slice(F.array_distinct(F.concat(shown, F.regexp_extract_all(html, F.lit(_IMAGE), 1))), 1, MOST_IMAGES)
    description = F.substring(F.coalesce(meta(html, "og:description"), meta(html, "description")), 1, DESCRIPTION_CHARS)
    return pages.select("page_id", F.coalesce(meta(html, "og:title"), title).alias("title"), description.alias("description"), images.alias("images"), table_pairs(html).alias("pairs"))


def first_source(found: DataFrame, key: str = "product_id") -> DataFrame:
    """Of the results of several sources the one of highest priority that has specifications or images.

    found: key, priority (0 first), source, specs (map), images (array).
    """
    useful = found.filter((F.coalesce(F.size("specs"), F.lit(0)) > 0) | (F.coalesce(F.size("images"), F.lit(0)) > 0))
    return useful.groupBy(key).agg(F.min_by(F.struct("source", "specs", "images"), F.struct("priority", "source")).alias("b")).select(key, "b.*")


def region(models: Column, brand: Column) -> Column:
    """(region, confidence) that the model codes of a device tell."""
    some = F.size(models) > 0
    european = F.exists(models, lambda m: m.rlike(r"SM-[A-Z0-9]+B$"))
    american = F.exists(models, lambda m: m.rlike(r"SM-[A-Z0-9]+U\d?$"))
    is_samsung = F.coalesce(brand, F.lit("")).isin("", "Samsung")
    told = lambda r, c: F.struct(F.lit(r).alias("region"), F.lit(c).alias("confidence"))
    return (
        F.when(is_samsung & european & ~american, told("EU", "confirmed")).when(is_samsung & american & ~european, told("US", "confirmed"))
        .when(is_samsung & european, told("EU", "likely")).when(~some | is_samsung, told("Unknown", "unclear"))
        .when(brand == "Apple", told("EU", "likely")).otherwise(told("Global", "unclear"))
    )


def regional_model(models: Column, brand: Column) -> Column:
    """The European code where codes tell regions, else the first; empty without codes."""
    coded = (F.coalesce(brand, F.lit("")) == "Samsung") | F.exists(models, lambda m: m.startswith("SM-"))
    european = F.get(F.filter(models, lambda m: m.rlike(r"SM-[A-Z0-9]+B$")), F.lit(0))
    return F.coalesce(F.when(coded, european), F.get(models, F.lit(0)), F.lit(""))


def lookup_name(family: Column) -> Column:
    """A device name without what follows a comma and without sizes."""
    return T.squeeze(F.regexp_replace(F.regexp_replace(family, r"(?s),.*$", ""), rf"(?i){T.B}\d+\s*(gb|tb){T.B}", ""))


def is_light(hex_colour: Column) -> Column:
    """Whether a #rrggbb colour is light."""
    part = lambda at: F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double")
    return part(2) * 0.299 + part(4) * 0.587 + part(6) * 0.114 > 150


def alert_threshold(product_id: Column, email: Column, threshold: Column) -> Column:
    """The leading integer of the threshold if product, address and threshold are valid, else null."""
    number = F.regexp_extract(threshold, r"^\s*([-+]?\d+)", 1).try_cast("int")
    return F.when((F.coalesce(product_id, F.lit("")) != "") & email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (number > 0), number)


def history_days(asked: Column, least: int = 30, most: int = 365, kept: int = 90) -> Column:
    """Days of history to show: a wish between bounds, and no more than is kept; no readable wish or 0 counts as the most."""
    wish = F.coalesce(F.nullif(F.regexp_extract(asked, r"^\s*([-+]?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(most))
    return F.least(F.lit(most), F.greatest(F.lit(least), wish), F.lit(kept))


def progress(elapsed: Column, expected: Column) -> Column:
    """Percent done by an estimate that nears but never passes 95."""
    return F.least(F.lit(95.0), 95 * (1 - F.exp(-elapsed / (expected * 0.6))))


def remaining(elapsed: Column, expected: Column) -> Column:
    return F.greatest(F.lit(0), T.round_half_up(expected - F.floor(elapsed)))


def duration(seconds: Column) -> Column:
    """Seconds as text, such as 2m 5s."""
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.when(seconds <= 0, "acum").when(minutes > 0, F.concat(minutes, F.lit("m "), rest, F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))


def spec_preview(sections: DataFrame, most_sections: int = 3, most_items: int = 3) -> DataFrame:
    """The first sections of each id with their first items. sections: id, section, first, items (see ``extract.spec_sections``)."""
    all_sections = F.array_sort(F.collect_list(F.struct("first", "section", F.slice("items", 1, most_items).alias("items"))))
    return sections.groupBy("id").agg(F.slice(all_sections, 1, most_sections).alias("s")).select("id", F.transform("s", lambda x: F.struct(x["section"].alias("section"), x["items"].alias("items"))).alias("preview"))
