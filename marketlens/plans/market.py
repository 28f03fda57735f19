"""Queries on payloads, live prices, pages and lexicon rules, each with its SQL.

Payloads are made from the part table by text functions, go through the
operators, and are compared with what SQL says of the part table itself.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.lexicon import Lexicon
from marketlens.functions.rows import spread
from marketlens.operators import discovery, enrichment, extract, fusion, history, matching, offers, pages, pricequery, pricing, querying, search, state
from marketlens.plans.catalogue import AS_OF, HISTORY, KEYED, LEXICON, OFFERS, PRODUCTS, REGISTRY, STATE, SUMMARY, _keyed, _summary
from marketlens.sources import adapters as A
from marketlens.sources import json_tables
from marketlens.sources.shared import shared_dir
from marketlens.sources.tables import table

_ = REGISTRY.query
P = "p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part)"
LEX = Lexicon(("Widget", "Gear"), ("red", "blue"), (("hot goods", "Hot", "hot"), ("cold goods", "Cold", "cold")), own_codes=("CEL",))
WORDS = {"lexicon": LEXICON.colours, "aliases": (("orange", "red"),), "families": {"cool": ("blue", "green"), "warm": ("red", "orange")}}


def _size() -> Column:
    return F.col("size")


def _name() -> Column:
    return F.col("name")


def _id() -> Column:
    return F.col("id")


def _price() -> Column:
    return F.col("price")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Dealt out, as the bodies that are made of these few columns are long to parse."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return spread(rows, "id")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- offers -----------------------------------------------------------------------


def _shopify_body() -> Column:
    return _text(
        '{"product":{"title":"', _name(), '","handle":"h', _id(), '","options":[{"name":"Color"},{"name":"Storage"}],"variants":[{"option1":"Black","option2":"64GB","available":true,"price":"', _price(),
        '"},{"option1":"Red","option2":"128GB","inventory_quantity":', _size() - 25, ',"inventory_policy":"', F.when(_size() % 2 == 0, "continue").otherwise("deny"), '","price":"', _price() * 2,
        '"},{"option1":"Red","option2":"256GB","inventory_management":null,"price":"', _price() * 3, '"}]}}',
    )


def _woo_body() -> Column:
    return _text(
        '[{"id":-1,"name":"case ', _name(), '","prices":{"price":"1"}},{"id":', _id(), ',"name":"', _name(), '","type":"', F.when(_size() % 2 == 0, "variable").otherwise("simple"), '","prices":{"price":"', F.floor(_price() * 100 + 0.5),
        '","currency_minor_unit":2},"is_in_stock":', _size() > 20, ',"variations":[{"id":', _id() * 10 + 1, ',"attributes":[{"name":"Color","value":"Black"}]},{"id":', _id() * 10 + 2, ',"attributes":[{"name":"Color","value":"Red"}]}]}]',
    )


def _flat_body() -> Column:
    return _text(
        '[{"id":-1,"name":"', _name(), '","price":0},{"id":', _id(), ',"name":"', _name(), '","price":', _price(), ',"salePrice":', F.when(_size() % 2 == 0, (_price() / 2).cast("string")).otherwise("null"),
        ',"offerPrice":', F.when(_size() % 3 == 0, (_price() / 4).cast("string")).otherwise("null"), ',"stock":', _size() % 5, "}]",
    )


def _paged_body() -> Column:
    return _text(
        '{"ProductsResult":{"results":[{"Title":"other thing","ActualPrice":1},{"Title":"', _name(), '","Url":"/u/', _id(), '","ActualPrice":', _price(), ',"HasDiscount":', _size() % 2 == 0, ',"DiscountPrice":', F.when(_size() % 3 == 0, F.lit(0.0)).otherwise(_price() / 2),
        F.when(_size() % 4 == 0, ',"IsInStock":false').when(_size() % 4 == 1, ',"StockQuantity":3').otherwise(""), ',"AvailableWebshop":', _size() > 30, "}]}}",
    )


def _cards_body() -> Column:
    return _text(
        '<div class="product-box"><a class="product-name" href="/a/', _id(), '">', _name(), '</a><span class="price-unit-price">50 L</span></div>\n<div class="box product-box x"><img src="/i.png"><a class="product-name" href="/b/', _id(), '"><b>',
        _name(), '</b></a><p class="price-unit-price">1.', F.lpad(_size().cast("string"), 3, "0"), " L</p></div>",
    )


def _wish(platform: str) -> Column:
    """What is asked for beside the name, or null."""
    if platform == "shopify":
        return F.when(_size() % 4 == 1, "!x Red").when(_size() % 4 == 2, "!x Red 256GB").when(_size() % 4 == 3, "!x Green")
    return F.when(_size() % 3 == 1, "!x Red").when(_size() % 3 == 2, "!x Green") if platform == "woocommerce" else F.lit(None).cast("string")


_BODY = {"shopify": _shopify_body, "woocommerce": _woo_body, "flat": _flat_body, "paged": _paged_body, "shopware": _cards_body, "html": lambda: F.lit("")}
_TRUTH = {  # price, in_stock, error
    "shopify": ("CASE size % 4 WHEN 0 THEN price WHEN 1 THEN price * 2 WHEN 2 THEN price * 3 END", "CASE size % 4 WHEN 1 THEN size > 25 OR size % 2 = 0 WHEN 3 THEN NULL ELSE true END", "CASE WHEN size % 4 = 3 THEN 'variant_unavailable' END"),
    "woocommerce": (
        "CASE WHEN size % 2 = 1 OR size % 3 = 0 THEN floor(price * 100 + 0.5) / 100 WHEN size % 3 = 1 THEN price / 2 END", "CASE WHEN size % 2 = 1 OR size % 3 = 0 THEN size > 20 WHEN size % 3 = 1 THEN false END",
        "CASE WHEN size % 2 = 0 AND size % 3 = 2 THEN 'variant_unavailable' END",
    ),
    "flat": ("CASE WHEN size % 3 = 0 THEN price / 4 WHEN size % 2 = 0 THEN price / 2 ELSE price END", "size % 5 > 0", "NULL::VARCHAR"),
    "paged": ("CASE WHEN size % 2 = 0 AND size % 3 > 0 THEN price / 2 ELSE price END", "CASE size % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE size > 30 END", "NULL::VARCHAR"),
    "shopware": ("1000.0::DOUBLE + size", "NULL::BOOLEAN", "NULL::VARCHAR"), "html": ("NULL::DOUBLE", "NULL::BOOLEAN", "'not_found'"),
}
_PLATFORMS = list(_TRUTH)


def _payloads(spark: SparkSession, d: str, platform: str, store: int = 1) -> DataFrame:
    """A response for a first query that hits nothing and one for the name."""
    rows = _parts(spark, d).withColumns({"body": _BODY[platform](), "terms": F.array_compact(F.array(_name(), _wish(platform)))})
    tries = F.array(F.struct(_text("nothing of the kind ", _id()).alias("query"), F.lit(0).alias("query_ord")), F.struct(_name().alias("query"), F.lit(1).alias("query_ord")))
    return rows.select(_id().alias("product_id"), F.lit(store).alias("store_id"), F.col("terms").alias("search_terms"), F.inline(tries), "body")


def _details(spark: SparkSession, d: str, store: int = 1) -> DataFrame:
    return _parts(spark, d).select(F.lit(store).alias("store_id"), (_id() * 10 + 2).alias("variation_id"), (_price() / 2).alias("price"), F.lit(False).alias("in_stock"), F.lit("/v").alias("url"))


def _truth(platform: str, store: str = "1", where: str = "true") -> str:
    price, stock, error = _TRUTH[platform]
    return f"SELECT id AS product_id, {store} AS store_id, round({price}, 4) AS price, {stock} AS in_stock, {error} AS error FROM p WHERE {where}"


def _offer_rows(rows: DataFrame) -> DataFrame:
    return rows.select("product_id", "store_id", F.round("price", 4).alias("price"), "in_stock", "error")


@_(f"WITH {P} {_truth('shopify')}")
def shopify_offers(spark, d):
    return _offer_rows(offers.choose(offers.shopify(_payloads(spark, d, "shopify"), LEXICON), strict_colour=None, lex=LEXICON))


@_(f"WITH {P} {_truth('woocommerce')}")
def woocommerce_offers(spark, d):
    return _offer_rows(offers.choose(offers.woocommerce(_payloads(spark, d, "woocommerce"), _details(spark, d), LEXICON), strict_colour=None, lex=LEXICON))


@_(f"WITH {P} {_truth('flat')}")
def flat_offers(spark, d):
    return _offer_rows(offers.choose(offers.flat(_payloads(spark, d, "flat")), strict_colour=False, lex=LEXICON))


@_(f"WITH {P} {_truth('paged')}")
def paged_offers(spark, d):
    return _offer_rows(offers.choose(offers.paged(_payloads(spark, d, "paged")), over_all=True, lex=LEXICON))


@_(f"WITH {P} {_truth('shopware')}")
def shopware_offers(spark, d):
    return _offer_rows(offers.choose(offers.shopware(_payloads(spark, d, "shopware")), sanity=True, lex=LEXICON))


@_(f"WITH {P} " + " UNION ALL ".join(_truth(n, str(i), f"id % 6 = {i}") for i, n in enumerate(_PLATFORMS)))
def offers_dispatch(spark, d):
    rows = reduce(DataFrame.unionByName, [_payloads(spark, d, n, i).filter(F.col("product_id") % 6 == i) for i, n in enumerate(_PLATFORMS)])
    stores = spark.createDataFrame(list(enumerate(_PLATFORMS)), "store_id int, platform string")
    return _offer_rows(offers.dispatch(rows, stores, _details(spark, d), LEXICON))


@_(f"WITH {P} SELECT id, CASE WHEN size % 3 > 0 THEN price END AS price, CASE size % 6 WHEN 1 THEN true WHEN 2 THEN size > 25 WHEN 4 THEN true WHEN 5 THEN false END AS in_stock FROM p")
def product_page_price(spark, d):
    sign = F.when(_size() % 6 == 1, '<i class="delivery-status-indicator is-available">').when(_size() % 6 == 2, _text('{"availableStock" : ', F.greatest(_size() - 25, F.lit(0)), "}")).when(_size() % 6 == 4, "12+ artikuj").when(_size() % 6 == 5, '"available":false').otherwise("")
    html = _text("<html>", F.when(_size() % 3 > 0, _text('"productPrice":"', F.format_string("%.2f", _price()), '"')).otherwise('"productPrice":"0"'), sign, "</html>")
    got = offers.product_page(html)
    return _parts(spark, d).select("id", got["price"].alias("price"), F.when(_size() % 3 > 0, got["in_stock"]).otherwise(offers.page_stock(html)).alias("in_stock"))


@_("SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS in_stock FROM pages")
def html_stock_signals(spark, d):
    sign = F.element_at(F.array(F.lit("http://schema.org/InStock"), F.lit('class="sold-out"'), F.lit("add-to-cart"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", extract.stock_from_html(F.concat("html", sign)).alias("in_stock"))


@_(f"WITH {P}, j AS (SELECT *, size % 4 AS k FROM p) SELECT id AS page_id, CASE WHEN k = 3 THEN NULL ELSE name END AS name, price, CASE k WHEN 0 THEN true WHEN 1 THEN false END AS in_stock FROM j WHERE k < 3")
def json_ld_offer_pages(spark, d):
    one = _text('{"@type":"Product","name":"', _name(), '","offers":')
    block = F.when(_size() % 4 == 0, _text(one, '{"price":"', _price(), ' EUR","availability":"http://schema.org/InStock"}}')).when(_size() % 4 == 1, _text('[{"@type":"Thing"},', one, '[{"price":', _price(), ',"availability":"OutOfStock"}]}]')).when(
        _size() % 4 == 2, _text('{"@graph":[', one, '{"lowPrice":', _price(), "}}]}")).otherwise("not json")
    rows = _parts(spark, d).select(_id().alias("page_id"), _text('<script type="application/ld+json">', block, "</script>").alias("html"))
    return extract.json_ld_offers(rows)


# --- sources ----------------------------------------------------------------------


def _title() -> Column:
    return F.when(_size() % 7 == 0, F.concat(F.lit("U-PS5 "), _name())).otherwise(_name())


def _sku() -> Column:
    return F.when(_size() % 2 == 0, _text("CEL", _size())).otherwise(_text("ZX-", _size() + 100))


def _image() -> Column:
    return F.when(_size() % 3 == 0, "data:abc").otherwise(_text("https://i/", _id()))


def _source_sql(id_sql: str, sku: bool = True, where: str = "true") -> str:
    model = "CASE WHEN size % 2 = 0 THEN '' ELSE 'ZX-' || (size + 100) END" if sku else "''"
    return f"""WITH {P} SELECT {id_sql} AS id, name AS family, CASE WHEN name LIKE '%widget' THEN 'Widget' WHEN name LIKE '%gear' THEN 'Gear' WHEN split_part(name, ' ', 1) IN ('red', 'blue') THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 1) END AS brand,
  CASE split_part(name, ' ', 1) WHEN 'hot' THEN 'hot goods' WHEN 'cold' THEN 'cold goods' ELSE 'tjera' END AS category, {model} AS model_number, CASE WHEN size % 3 = 0 THEN '' ELSE 'https://i/' || id END AS image_url
FROM p WHERE size % 7 > 0 AND {where}"""


def _source_rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", "family", "brand", "category", "model_number", "image_url")


@_(_source_sql("'a-h' || id"))
def shopify_source(spark, d):
    body = _text('{"products":[{"title":"', _title(), '","handle":"h', _id(), '","vendor":"Others","images":[{"src":"', _image(), '"}],"variants":[{"sku":"', _sku(), '"}]},{"title":"TV","handle":"short"}]}')
    return _source_rows(discovery.shopify(_parts(spark, d).select(F.lit("a").alias("store"), body.alias("body")), LEX))


@_(_source_sql("'a-w' || id"))
def woocommerce_source(spark, d):
    body = _text('[{"name":"', F.replace(_title(), F.lit(" "), F.lit("&#32;")), '","slug":"w', _id(), '","sku":"', _sku(), '","images":[{"src":"', _image(), '"}],"categories":[],"brands":[]}]')
    return _source_rows(discovery.woocommerce(_parts(spark, d).select(F.lit("a").alias("store"), body.alias("body")), LEX))


@_(_source_sql("'a-' || id", sku=False))
def flat_source(spark, d):
    body = _text('[{"id":', _id(), ',"name":"', _title(), '","image":"', _image(), '"},{"id":0,"name":"x"}]')
    return _source_rows(discovery.flat(_parts(spark, d).select(F.lit("a").alias("store"), body.alias("body")), LEX))


@_(_source_sql("'a-' || id", where="id // 8 % 3 < 2"))
def paged_source(spark, d):
    """Lists of three pages of 8; the second completes its total, so the third is never asked for."""
    item = _text('{"Id":"', _id(), '","Title":"', _title(), '","ProductCode":"', _sku(), '","Thumbnail":"', _image(), '"}')
    rows = _parts(spark, d).select(F.floor(_id() / 24).alias("list"), (F.floor(_id() / 8) % 3).alias("page"), item.alias("item"))
    rows = rows.groupBy("list", "page").agg(_text('{"Batch":{"Items":[', F.array_join(F.array_sort(F.collect_list("item")), ","), '],"Config":{"TotalItems":16}}}').alias("body"))
    return _source_rows(discovery.paged(rows.withColumn("store", F.lit("a")), LEX, 8))


@_(_source_sql("'a-' || replace(name, ' ', '-')", sku=False, where="true").replace("FROM p WHERE", "FROM (SELECT min_by(p, id) AS q, CASE WHEN size % 7 = 0 THEN 'u' ELSE '' END AS u, name AS n FROM p GROUP BY u, n), LATERAL (SELECT q.id, q.name, q.size) AS t(id, name, size) WHERE"))
def card_source(spark, d):
    """From HTML: a card in a layout table, quotes of both kinds and none, a name in a heading, an image that loads late, and a card without a link."""
    html = _text(
        "<table><tr><td><div class='x product-box'><a href=/x><table><tr><td><img data-src='", _image(), "' src=\"\"></td></tr></table></a><h3>", F.replace(_title(), F.lit(" "), F.lit(" \n &#32;")),
        '</h3></div></td></tr></table><div class="product-box"><h3>no link</h3></div>',
    )
    return _source_rows(discovery.from_pages(_parts(spark, d).select(F.lit("a").alias("store"), F.lit("t").alias("term"), _id().alias("page"), html.alias("html")), LEX))


@_("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
def json_round_trip(spark, d):
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    json_tables.write_json(_parts(spark, d).select("id", "name", "price"), path)
    return json_tables.read_json(spark, path, "id long, name string, price double").unionByName(json_tables.read_json(spark, path + "-that-is-not-there", "id long, name string, price double"))


@_(f"WITH {HISTORY} SELECT product_id::VARCHAR AS product_id, day, store_id::VARCHAR AS store_id, price FROM history")
def history_unnested(spark, d):
    rows = A.history(spark, d).select(F.col("product_id").cast("string").alias("product_id"), F.col("day").cast("string").alias("day"), F.col("store_id").cast("string").alias("store_id"), "price")
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    days = rows.groupBy("product_id", "day").agg(pairs("store_id", "price").alias("stores")).groupBy("product_id").agg(pairs("day", "stores").alias("days"))
    return json_tables.nested_history(days.select(F.create_map("product_id", "days").alias("prices")))


@_("SELECT (props->>'$.k')::BIGINT AS product_id, floor(avg(event_id % 7) + 0.5)::BIGINT AS score FROM events GROUP BY 1")
def trends_source(spark, d):
    rows = A.events(spark, d).select(F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 7).alias("v"))
    rows = rows.groupBy("k").agg(F.array_join(F.collect_list(_text('{"value":[1,', F.col("v"), "]}")), ",").alias("points"))
    body = _text(")]}',\n", '{"default":{"timelineData":[', F.col("points"), "]}}")
    return pages.timeline_means(rows.select(F.array(F.lit(-1).cast("long"), "k").alias("keywords"), body.alias("body"))).filter("product_id >= 0")


@_("SELECT count(*) FILTER (WHERE value > 30) AS non_zero FROM events")
def trend_non_zero(spark, d):
    return A.events(spark, d).select(F.when(F.col("value") > 30, 1).otherwise(0).alias("score")).agg(F.count_if(F.col("score") > 0).alias("non_zero"))


def _cache(hours: int):
    return lambda spark, d: pages.cached_at(A.events(spark, d), "ts", F.lit(A.events(spark, d).agg(F.max("ts")).first()[0]), hours).select("event_id", "value")


for _table, _hours in (("trends_cache", 25), ("enrichment_cache", 24)):
    _(f"SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {_hours} HOURS", _table)(_cache(_hours))

# --- live prices ------------------------------------------------------------------

_RECORDS = OFFERS + f", records AS (SELECT product_id::VARCHAR AS key, store_id, price, in_stock, {AS_OF}::TIMESTAMP - INTERVAL 1 MINUTE * (product_id % 5) * 50 AS refreshed_at FROM offers)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    age = F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("product_id") % 5) * 50).cast("int"))
    rows = A.offers(spark, d).select(F.col("product_id").cast("string").alias("key"), "store_id", "price", "in_stock", (A.as_of(spark, d).cast("timestamp_ntz") - age).alias("refreshed_at"))
    none = F.lit(None).cast("string")
    return rows.withColumns({"matched_name": none, "product_url": none, "error": none, "suspicious": F.lit(False), "overpriced": F.lit(False)})


@_(f"WITH {_RECORDS} SELECT key, store_id, refreshed_at > {AS_OF}::TIMESTAMP - INTERVAL 2 HOURS AS fresh FROM records")
def cache_freshness(spark, d):
    return _records(spark, d).select("key", "store_id", pricequery.is_fresh(F.col("refreshed_at"), A.as_of(spark, d)).alias("fresh"))


@_(f"""WITH {_RECORDS}, s AS (SELECT s_suppkey AS store_id FROM supplier WHERE s_acctbal >= 0), keys AS (SELECT DISTINCT key, key::BIGINT AS id FROM records), fresh AS (SELECT * FROM keys WHERE id % 5 < 3 AND id % 11 > 0),
live AS (SELECT key, store_id, CASE WHEN id % 4 = 1 THEN NULL ELSE price * 2 END AS price, in_stock FROM records JOIN keys USING (key) WHERE store_id % 2 = 0), grid AS (
  SELECT k.key, s.store_id, l.price, CASE WHEN k.id % 4 <> 1 THEN l.in_stock END AS in_stock, CASE WHEN l.key IS NULL THEN 'search_failed' WHEN k.id % 4 = 1 THEN 'not_found' END AS error
  FROM keys k CROSS JOIN s LEFT JOIN live l ON l.key = k.key AND l.store_id = s.store_id WHERE k.key NOT IN (SELECT key FROM fresh)),
dev AS (SELECT *, CASE WHEN price > 0 AND count(price) FILTER (WHERE price > 0) OVER w >= 3 THEN (price - avg(price) FILTER (WHERE price > 0) OVER w) / avg(price) FILTER (WHERE price > 0) OVER w END AS off FROM grid WINDOW w AS (PARTITION BY key))
SELECT key, store_id, price, in_stock, NULL::VARCHAR AS error, false AS suspicious, false AS overpriced, false AS stale, true AS from_cache FROM records WHERE key IN (SELECT key FROM fresh)
UNION ALL SELECT key, store_id, price, in_stock, error, coalesce(off < -0.4, false), coalesce(off > 0.6, false), false, false FROM dev""")
def price_query(spark, d):
    """Products of id % 11 = 0 are forced; of those with id % 4 = 1 the stores gave another generation of the product."""
    records = _records(spark, d)
    ident = F.col("key").cast("long")
    requests = records.select("key").distinct().select("key", F.array(F.lit("Thing 7")).alias("search_terms"), (ident % 11 == 0).alias("force"))
    live = records.filter("store_id % 2 = 0").select("key", "store_id", (F.col("price") * 2).alias("price"), "in_stock", F.when(ident % 4 == 1, "Thing 8").otherwise("Thing 7").alias("matched_name"), "product_url", "error")
    return pricequery.price_query(requests, records, live, A.stores(spark, d), A.as_of(spark, d))


@_(f"""WITH {_RECORDS} SELECT key, store_id, CASE WHEN key::BIGINT % 3 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN key::BIGINT % 3 = 0 THEN {AS_OF}::TIMESTAMP ELSE refreshed_at END AS refreshed_at
FROM records WHERE key::BIGINT % 3 > 0 OR store_id % 2 = 0""")
def price_upsert(spark, d):
    old = _records(spark, d).select("key", "store_id", "price", "refreshed_at")
    new = old.filter((F.col("key").cast("long") % 3 == 0) & (F.col("store_id") % 2 == 0)).withColumn("price", F.col("price") + 1).drop("refreshed_at")
    # records of which the new ones have no store at all go with the rest of their key
    every = old.filter(F.col("key").cast("long") % 3 == 0).select("key").distinct()
    gone = pricequery.price_upsert(old, new, A.as_of(spark, d).cast("timestamp_ntz"))
    return gone.join(every.join(new.select("key").distinct(), "key", "left_anti"), "key", "left_anti")


_REFRESH = OFFERS + f""", r AS (SELECT product_id, store_id, CASE WHEN store_id % 7 > 0 THEN price END AS price, CASE WHEN store_id % 7 = 0 THEN CASE WHEN product_id % 2 = 0 THEN 'not_found' ELSE 'timeout' END END AS error,
  CASE WHEN store_id % 3 = 0 THEN 'n' || product_id END AS native, least(100, store_id) AS confidence FROM offers)"""


def _refresh(part: str):
    def query(spark, d):
        rows = A.offers(spark, d)
        lost, none = F.col("store_id") % 7 == 0, F.lit(False)
        rows = rows.select(
            "product_id", "store_id", F.when(~lost, F.col("price")).alias("price"), "in_stock", F.when(lost, F.when(F.col("product_id") % 2 == 0, "not_found").otherwise("timeout")).alias("error"),
            F.when(F.col("store_id") % 3 == 0, _text("n", F.col("product_id"))).alias("store_product_id"), F.least(F.lit(100), "store_id").cast("double").alias("confidence"), none.alias("suspicious"), none.alias("overpriced"),
        )
        empty = spark.createDataFrame([], "store_id long, store_product_id string, product_id long, confidence int, status string")
        tables = {"history": A.history(spark, d), "state": A.catalogue_state(spark, d), "mappings": empty, "alerts": A.alerts(spark, d)}
        return pricequery.refresh(rows, tables, A.as_of(spark, d))[part]

    return query


@_(f"""WITH {_REFRESH}, o AS (SELECT product_id, min(price) AS low, count(DISTINCT store_id) AS n, max(day) AS seen FROM obs GROUP BY 1), m AS (SELECT product_id, min(price) AS low, count(price) AS n FROM r WHERE price IS NOT NULL GROUP BY 1)
SELECT o.product_id, coalesce(m.low, o.low) AS lowest_price, coalesce(m.n, o.n) AS store_count, CASE WHEN m.product_id IS NULL THEN seen ELSE {AS_OF} END AS last_seen, 'discovered' AS status FROM o LEFT JOIN m USING (product_id)""")
def refresh_state(spark, d):
    return _refresh("state")(spark, d)


@_(f"WITH {_REFRESH} SELECT store_id, 'scrape_failed' AS error_type, error AS message, product_id FROM r WHERE error = 'timeout'")
def refresh_errors(spark, d):
    return _refresh("errors")(spark, d)


@_(f"WITH {_REFRESH} SELECT store_id, native AS store_product_id, product_id, confidence::INT AS confidence, 'pending' AS status FROM r WHERE native IS NOT NULL")
def refresh_mappings(spark, d):
    return _refresh("mappings")(spark, d)


@_(f"""WITH {_REFRESH}, a AS (SELECT product_id, o_custkey AS subscriber, floor(max(price))::BIGINT AS threshold, max(o_orderdate) AS last FROM obs JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), m AS (SELECT product_id, min(price) AS low FROM r WHERE price IS NOT NULL GROUP BY 1)
SELECT product_id, subscriber, threshold, low AS lowest_price FROM a JOIN m USING (product_id) WHERE threshold >= low AND last < {AS_OF}::TIMESTAMP - INTERVAL 24 HOURS""")
def refresh_due_alerts(spark, d):
    return _refresh("due")(spark, d).select("product_id", "subscriber", "threshold", "lowest_price")


@_(f"WITH {P} SELECT id, CASE WHEN size % 3 = 0 THEN id::VARCHAR ELSE id || ':' || CASE WHEN size % 3 = 1 THEN 'red' ELSE '' END || ':' || CASE WHEN size % 2 = 0 THEN '64gb' ELSE '128gb' END END AS key FROM p")
def variant_cache_key(spark, d):
    colour, storage = F.when(_size() % 3 == 1, "Red"), F.when(_size() % 3 > 0, F.when(_size() % 2 == 0, "64GB").otherwise("128Gb"))
    return _parts(spark, d).select("id", pricequery.variant_key(_id(), colour, storage).alias("key"))


@_(f"WITH {P} SELECT id, CASE WHEN size % 3 = 0 THEN 'timeout' WHEN size % 2 = 0 THEN 'variant_unavailable' ELSE 'not_found' END AS error FROM p")
def variant_error_text(spark, d):
    return _parts(spark, d).select("id", pricequery.variant_error(F.when(_size() % 3 == 0, "timeout").otherwise("not_found"), _size() % 2 == 0).alias("error"))


@_(f"WITH {P} SELECT id, CASE WHEN size % 3 = 0 THEN '128GB' WHEN size % 2 = 0 THEN '256GB' ELSE '64GB' END AS storage FROM p")
def variant_defaults(spark, d):
    options = F.array(F.lit("64GB"), F.lit("128GB"), F.lit("256GB"))
    named = T.storage_size(_text(_name(), F.when(_size() % 2 == 0, " 256 gb").otherwise("")))
    return _parts(spark, d).select("id", querying.variant_default(F.when(_size() % 3 == 0, "128gb"), named, options, F.lit("64GB")).alias("storage"))


# --- catalogue --------------------------------------------------------------------

_FUSED = KEYED + """, f AS (SELECT *, CASE WHEN id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 3 ELSE 0 END - length(family) * 0.05 AS score FROM keyed),
g AS (SELECT *, row_number() OVER (PARTITION BY fusion_key ORDER BY score DESC, id) AS n FROM f)"""


def _full(spark: SparkSession, d: str) -> DataFrame:
    rows, i = _keyed(spark, d), F.col("id")
    return rows.select("id", "family", "fusion_key", F.when(i % 3 == 0, "http://x").otherwise("").alias("image_url"), F.when(i % 5 == 0, F.lit("2024-01-01")).cast("timestamp").alias("enriched_at"),
        F.when(i % 4 == 0, F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.create_map().cast("map<string,string>")).alias("specs"), (i % 6 == 0).alias("has_variant"),
        F.array("family", _text("t", i % 2)).alias("search_terms"), F.array(F.struct(_text("s", i % 3).alias("label"), _text(i).alias("sku"))).alias("storage_options"))


@_(f"WITH {_FUSED} SELECT fusion_key, min(id) FILTER (WHERE n = 1) AS kept, count(*) AS members FROM g GROUP BY fusion_key")
def survivor_scored(spark, d):
    return fusion.survivors(_full(spark, d), "fusion_key").select("fusion_key", "kept", "members")


@_(f"""WITH {_FUSED}, o AS (SELECT fusion_key, 's' || id % 3 AS label, min(id) AS id FROM keyed GROUP BY ALL)
SELECT min(id) FILTER (WHERE n = 1) AS id, (SELECT string_agg(label || '=' || o.id, ',' ORDER BY o.id) FROM o WHERE o.fusion_key = g.fusion_key) AS options, count(DISTINCT family) + count(DISTINCT id % 2) AS terms FROM g GROUP BY fusion_key""")
def fused_catalogue(spark, d):
    rows = fusion.fused(_full(spark, d), "fusion_key")
    return rows.select("id", F.array_join(F.transform("storage_options", lambda o: F.concat(o["label"], F.lit("="), o["sku"])), ",").alias("options"), F.size("search_terms").cast("long").alias("terms"))


@_(f"WITH {_FUSED.replace('id % 3 = 0 THEN 10', 'id % 3 = 0 AND id % 2 = 0 THEN 10')} SELECT id, fusion_key, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'http://x' ELSE '' END AS image_url FROM g WHERE n = 1")
def discovery_merge(spark, d):
    """Products with odd ids are discovered again, without an image; groups of one key then keep their survivor."""
    rows = _full(spark, d)
    return pricequery.discovery_merge(rows, rows.filter("id % 2 = 1").withColumn("image_url", F.lit(""))).select("id", "fusion_key", "image_url")


@_("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'https://i/' || p_partkey WHEN p_partkey % 3 = 0 THEN 'http://x' ELSE '' END AS image_url FROM part")
def images_written_back(spark, d):
    rows = _full(spark, d)
    found = rows.filter("id % 4 = 0").select("id", _text("https://i/", F.col("id")).alias("url"))
    return fusion.with_images(rows, found).select("id", "image_url")


@_("SELECT list(p_partkey ORDER BY p_partkey)[1:20]::VARCHAR AS first, greatest(count(*) - 20, 0) AS more FROM part WHERE p_partkey % 3 > 0")
def missing_images(spark, d):
    return discovery.missing_images(_full(spark, d)).select(F.concat(F.lit("["), F.array_join("first", ", "), F.lit("]")).alias("first"), "more")


@_(f"WITH {P} SELECT id FROM p WHERE NOT (size % 5 = 0)")
def used_goods(spark, d):
    title = F.when(_size() % 5 == 0, F.concat(F.lit(" u-Xbox "), _name())).when(_size() % 5 == 1, F.concat(F.lit("u-xboxy "), _name())).otherwise(_name())
    return _parts(spark, d).filter(~T.is_used(title)).select("id")


@_(f"WITH {P} SELECT id, CASE WHEN size % 5 > 1 THEN 'https://i/' || id ELSE '' END AS image FROM p")
def safe_images(spark, d):
    url = F.when(_size() % 5 == 0, "ftp://x").when(_size() % 5 == 1, "http://x/;base64,aa").otherwise(_text("https://i/", _id()))
    return _parts(spark, d).select("id", T.safe_image(url).alias("image"))


@_("SELECT p_partkey AS id, p_name AS family FROM part WHERE p_name = 'red bolt' OR p_name = 'small ring'")
def id_lookup(spark, d):
    """Ids with percent signs: an id meets a key as written, else decoded on both sides."""
    stored = F.when(F.col("id") % 2 == 0, F.replace("family", F.lit(" "), F.lit("%20"))).otherwise(F.replace("family", F.lit("r"), F.lit("%72")))
    keys = spark.createDataFrame([("red%20bolt",), ("small%20%72ing",)], "key string").select(T.url_decoded(F.col("key")).alias("k"))
    return A.products(spark, d).withColumn("k", T.url_decoded(stored)).join(F.broadcast(keys), "k").select("id", "family")  # two keys


@_("SELECT p_partkey AS id, p_type AS category FROM part WHERE p_type = 'PROMO'")
def category_scan(spark, d):
    return search.in_category(A.products(spark, d), "PROMO").select("id", "category")


@_(f"WITH {PRODUCTS} SELECT category, string_agg(DISTINCT subcategory, ',' ORDER BY subcategory) AS subcategories FROM products GROUP BY category HAVING contains(lower(category), 'lar') OR bool_or(contains(lower(subcategory), 'lar'))")
def category_match(spark, d):
    return search.matching_categories(search.categories(A.products(spark, d)), " Lar ").select("category", F.array_join("subcategories", ",").alias("subcategories"))


@_(f"WITH {PRODUCTS} SELECT id, family FROM products WHERE contains(lower(family), 'red') AND contains(lower(family), 'plate') AND category = 'PROMO'")
def search_in_category(spark, d):
    return search.in_category(search.search(A.products(spark, d), "red plate"), "PROMO").select("id", "family")


@_(f"""WITH {PRODUCTS}
(SELECT id, family FROM (SELECT * FROM products WHERE contains(lower(family), 're') OR contains(lower(brand), 're') OR contains(lower(model_number), 're')) ORDER BY
 100 + 10 + 20 + CASE WHEN starts_with(family, 're') THEN 30 ELSE 0 END + 10 - length(family) * 0.15 DESC, id LIMIT 6)""")
def autocomplete_gate(spark, d):
    """A query of one character gives nothing; of two it gives six rows."""
    rows = A.products(spark, d)
    return search.autocomplete(rows, " r ").unionByName(search.autocomplete(rows, " re ")).select("id", "family")


@_("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 AND c_custkey > 0 THEN c_custkey::INT WHEN c_custkey % 4 = 2 THEN -3 END AS bound FROM customer")
def filter_input(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), search.price_bound(F.when(key % 4 == 1, _text(key, ".9 L")).when(key % 4 == 2, " -3x").when(key % 4 == 3, "0").otherwise("abc")).alias("bound"))


@_(f"WITH {PRODUCTS} SELECT brand, count(*) AS n FROM products GROUP BY brand ORDER BY n DESC, brand LIMIT 15")
def brand_facet_first(spark, d):
    return search.visible_brands(search.brand_facet(A.products(spark, d)))


@_(f"WITH {PRODUCTS} SELECT brand, count(*) AS n FROM products WHERE contains(lower(brand), 'd#2') GROUP BY brand")
def brand_facet_search(spark, d):
    return search.visible_brands(search.brand_facet(A.products(spark, d)), "D#2")


@_(f"WITH {OFFERS}, r AS (SELECT product_id, o.store_id, coalesce(CASE WHEN s_suppkey % 5 > 0 THEN s_name END, o.store_id::VARCHAR) AS store_name, price, row_number() OVER (PARTITION BY product_id ORDER BY price ASC NULLS LAST, o.store_id) AS place FROM offers o LEFT JOIN supplier ON s_suppkey = o.store_id) SELECT * FROM r")
def offer_table(spark, d):
    return search.offer_table(A.offers(spark, d), A.stores(spark, d).filter("store_id % 5 > 0"))


@_(f"""WITH {SUMMARY}, ids AS (SELECT product_id AS id, string_agg(store_id, ',' ORDER BY store_id) AS stores, max(day) AS refreshed FROM offers WHERE price IS NOT NULL GROUP BY 1)
SELECT id, best_price, store_count, in_stock, stores, refreshed FROM summary LEFT JOIN ids USING (id)""")
def summary_with_stores(spark, d):
    held = A.offers(spark, d).filter("price is not null").groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_set("store_id")).alias("stores"), F.max("day").alias("refreshed"))
    return _summary(spark, d).join(held, "id", "left").select("id", "best_price", "store_count", "in_stock", F.array_join("stores", ",").alias("stores"), "refreshed")


@_(f"WITH {OFFERS}, f AS (SELECT product_id, store_id, price, count(*) FILTER (WHERE price > 0) OVER w AS n, avg(price) OVER w AS m FROM offers WINDOW w AS (PARTITION BY product_id)) SELECT product_id, store_id, price FROM f WHERE n >= 3 AND price > 1.6 * m ORDER BY price DESC, product_id, store_id LIMIT 30")
def flagged_first(spark, d):
    rows = pricing.flag_outliers(A.offers(spark, d)).filter("overpriced").select("product_id", "store_id", "price")
    return rows.orderBy(F.desc("price"), "product_id", "store_id").limit(30)


@_("SELECT event_id AS id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 30")
def discovery_log(spark, d):
    return state.bounded_log(A.events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "value"), 30)


# --- matching and lexicon rules -----------------------------------------------------


@_(f"WITH {P}, q AS (SELECT id % 50 AS product_id, id % 4 AS query_ord, id AS pos, CASE WHEN size % 3 = 0 THEN 0 ELSE size END::DOUBLE AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY query_ord, score DESC, pos) AS n FROM q WHERE score > 0) SELECT product_id, query_ord, pos, score FROM r WHERE n = 1")
def first_hit(spark, d):
    rows = _parts(spark, d).select((_id() % 50).alias("product_id"), (_id() % 4).alias("query_ord"), _id().alias("pos"), F.when(_size() % 3 == 0, 0).otherwise(_size()).cast("double").alias("score"))
    return matching.first_query_with_hit(rows)


@_(f"WITH {P}, g AS (SELECT id, price, max(price) OVER w AS most, count(*) OVER w AS n FROM (SELECT id, brand, size, CASE WHEN size % 10 = 0 THEN price / 100 ELSE price END AS price FROM p) WINDOW w AS (PARTITION BY brand, size)) SELECT id, CASE WHEN n >= 2 AND price < most * 0.1 THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM g")
def price_sanity(spark, d):
    rows = _parts(spark, d).withColumn("price", F.when(_size() % 10 == 0, _price() / 100).otherwise(_price()))
    group = rows.groupBy("brand", "size").agg(F.max("price").alias("most"), F.count(F.lit(1)).alias("n"))
    return rows.join(group, ["brand", "size"]).select("id", discovery.doubtful_price(_price(), F.col("most"), F.col("n")).alias("weight"))


@_(f"WITH {P} SELECT id, CASE WHEN size % 4 = 0 THEN 'ok' WHEN name LIKE 'red%' THEN 'ok' WHEN name LIKE 'blue%' THEN 'unavailable' ELSE 'unavailable' END AS verdict, CASE WHEN size % 4 = 0 THEN 'ok' WHEN name LIKE 'blue%' THEN 'unavailable' ELSE 'ok' END AS lax, CASE WHEN name LIKE 'red%' THEN 90 WHEN name LIKE 'blue%' THEN 0 ELSE -1 END AS alias FROM p")
def colour_verdicts(spark, d):
    wanted = F.when(_size() % 4 > 0, "red")
    return _parts(spark, d).select("id", querying.colour_verdict(wanted, _name(), **WORDS).alias("verdict"), querying.colour_verdict(wanted, _name(), strict=False, **WORDS).alias("lax"), querying.colour_confidence(F.lit("orange"), _name(), **WORDS).alias("alias"))


@_(f"WITH {P} SELECT id, CASE WHEN size % 2 = 0 THEN CASE WHEN name LIKE 'red%' THEN 'red' WHEN name LIKE 'blue%' THEN 'blue' ELSE 'green' END END AS colour FROM p")
def requested_colour(spark, d):
    exact = F.when(_size() % 2 == 0, "!").otherwise("")
    return _parts(spark, d).select("id", querying.requested_colour(F.array(F.lit("white"), _text(exact, _name()), _text(exact, "green x")), LEXICON.colours).alias("colour"))


@_(f"WITH {P} SELECT id, CASE WHEN instr(name, 'gear') > 1 THEN 'gear' WHEN instr(name, 'rod') > 1 THEN 'rod' END AS forward, CASE WHEN starts_with(name, 'hot ') THEN substr(name, 5) END AS stripped, size % 3 = 0 AS is_model FROM p")
def brand_in_query(spark, d):
    number = F.when(_size() % 3 == 0, _text("zx-", _size() + 100, " x")).when(_size() % 3 == 1, _text("x1 zx-", _size() + 100)).otherwise(_name())
    return _parts(spark, d).select("id", querying.brand_forward(_name(), ("Gear", "Rod")).alias("forward"), querying.brand_stripped(_name(), ("Hot",)).alias("stripped"), querying.is_model_number(number).alias("is_model"))


@_(f"WITH {P} SELECT id, 'AB-' || (size + 100) || '|' || CASE WHEN starts_with(name, 'hot ') THEN 'big ' || name || '|' || 'big' ELSE '' END AS queries FROM p".replace("CASE WHEN starts_with(name, 'hot ') THEN 'big ' || name || '|' || 'big' ELSE '' END", "CASE WHEN starts_with(name, 'hot ') THEN name || '|big ' || name ELSE 'big ' || name END"))
def store_queries(spark, d):
    terms = F.array(F.lit("http://x"), _text("big ", _name(), " 64gb, more"), _text("AB-", _size() + 100), F.lit("ab"))
    return _parts(spark, d).select("id", F.array_join(querying.store_queries(terms, ("hot",)), "|").alias("queries"))


@_(f"WITH {P} SELECT id, base, coalesce('!b ' || base || ' 64GB|!' || base || ' 64GB|', '') || 't' AS terms FROM (SELECT id, CASE WHEN size % 3 = 0 AND size % 5 > 0 THEN CASE WHEN name LIKE '% ring' THEN 'Ring' WHEN name LIKE '% plate' THEN 'Plate' END END AS base FROM p)")
def variant_terms(spark, d):
    base = querying.base_model(_text(F.when(_size() % 5 == 0, "case ").otherwise(""), _name()), F.when(_size() % 3 == 0, "Laptop").otherwise("TV"), ((r"(?i)\bring\b", "Ring"), (r"(?i)\bplate\b", "Plate")), LEXICON.accessories)
    rows = _parts(spark, d).withColumn("base", base)
    return rows.select("id", "base", F.array_join(querying.variant_terms(F.col("base"), F.lit("b"), F.lit(""), F.lit("64GB"), F.array(F.lit("t"))), "|").alias("terms"))


@_(f"WITH {P} SELECT id, CASE size % 4 WHEN 0 THEN NULL WHEN 1 THEN price WHEN 2 THEN NULL WHEN 3 THEN price END AS price, CASE WHEN size % 4 IN (0, 2) THEN 'not_found' END AS error, CASE WHEN size % 4 = 3 THEN NULL ELSE 'thing ' || CASE WHEN size % 4 = 1 THEN 7 ELSE 8 END END AS url_name FROM p")
def bad_matches(spark, d):
    """The name, or else the last part of the address, tells another generation than the terms; an address of digits tells nothing."""
    name = F.when(_size() % 4 == 0, "Thing S8")
    url = F.when(_size() % 4 == 3, "https://s/p/123").otherwise(_text("https://s/p/thing-", F.when(_size() % 4 == 1, 7).otherwise(8), ".html"))
    rows = _parts(spark, d).select("id", "price", F.lit(True).alias("in_stock"), name.alias("matched_name"), url.alias("product_url"), F.array(F.lit("Thíng 7"), F.lit("http://x 99")).alias("search_terms"), F.lit(None).cast("string").alias("error"))
    return matching.nullify_bad_matches(rows).select("id", "price", "error", matching.name_from_url(F.col("product_url")).alias("url_name"))


@_(f"WITH {P} SELECT id, CASE WHEN size % 4 = 0 THEN 'Acme' WHEN name LIKE '%widget' THEN 'Widget' WHEN name LIKE '%gear' THEN 'Gear' WHEN split_part(name, ' ', 1) IN ('red', 'blue') THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 1) END AS brand, CASE size % 3 WHEN 0 THEN 'QX-' || (size + 200) WHEN 1 THEN 'i7-' || (size + 1000) || 'H' ELSE CASE WHEN size % 2 = 0 THEN '' ELSE 'ZX-' || (size + 100) END END AS model, size % 2 = 0 AS own FROM p")
def brand_and_model(spark, d):
    name = _text(_name(), F.when(_size() % 3 == 0, _text(" QX-", _size() + 200)).when(_size() % 3 == 1, _text(" i7-", _size() + 1000, "H")).otherwise(""))
    return _parts(spark, d).select("id", discovery.brand(_name(), F.when(_size() % 4 == 0, "Acme"), LEX.brands, LEX.generic).alias("brand"), discovery.model_number(name, _sku(), LEX.own_codes).alias("model"), discovery.is_own_code(_sku(), LEX.own_codes).alias("own"))


@_(f"WITH {P} SELECT id, size % 3 = 0 AS console FROM p")
def console_hardware(spark, d):
    name = F.when(_size() % 3 == 0, "Playbox 5 Slim 825 GB Digital + Game of things").otherwise(_text("Playbox 5 ", _name()))
    return _parts(spark, d).select("id", pages.is_console(name, ("playbox",), ("slim", "digital")).alias("console"))


@_(f"WITH {P} SELECT id, CASE size % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' ELSE 'Unknown' END AS region, CASE size % 3 WHEN 0 THEN 'SM-' || id || 'B' WHEN 1 THEN 'SM-' || id || 'U1' ELSE 'X' || id END AS model, size % 3 = 2 AS fits, size % 2 = 0 AS branded FROM p")
def device_regions(spark, d):
    codes = F.array(F.when(_size() % 3 == 0, _text("SM-", _id(), "B")).when(_size() % 3 == 1, _text("SM-", _id(), "U1")).otherwise(_text("X", _id())))
    return _parts(spark, d).select("id", enrichment.region(codes, F.lit("Samsung"))["region"].alias("region"), enrichment.regional_model(codes, F.lit("Samsung")).alias("model"), pages.models_fit_brand(codes, F.lit("Apple")).alias("fits"), pages.name_has_brand(F.when(_size() % 2 == 0, "apple x").otherwise("x"), F.lit("Apple")).alias("branded"))


@_(f"WITH {P} SELECT id AS product_id, 'Acme ' || name AS name, '/d/' || id AS href FROM p WHERE size % 3 > 0")
def search_result_gate(spark, d):
    """Of three results the first has a suffix of another model, the second another brand; the third passes unless its link is absolute."""
    result = lambda pos, name, href: F.struct(F.lit(pos).alias("pos"), name.alias("name"), href.alias("href"))
    found = F.array(result(0, _text("Acme ", _name(), " Pro Max"), F.lit("/x")), result(1, _text("Other ", _name()), F.lit("/y")), result(2, _text("Acme ", _name()), _text(F.when(_size() % 3 == 0, "http://z").otherwise("/d/"), _id())))
    rows = _parts(spark, d).select(_id().alias("product_id"), _text("acme ", _name()).alias("wanted"), F.lit("Acme").alias("brand"), F.inline(found))
    return pages.first_result(rows, ("acme", "other"))


@_(f"WITH {P} SELECT id AS page_id, name, 'Display/Size=' || size || ',Display/Type=AMOLED' AS specs, 'SM-' || id || 'B' AS models FROM p WHERE size % 5 > 0")
def device_specs(spark, d):
    html = _text(
        '<h1 class="specs-phone-name-title">', _name(), '</h1><div id="specs-list"><table><tr><th>Display</th><td class="ttl"><a>Size</a></td><td class="nfo">', _size(), '</td></tr><tr><td class="ttl">Type</td><td class="nfo">AMOLED </td></tr></table>',
        '<table><tr><th>Misc</th><td class="ttl">Models</td><td class="nfo">SM-', _id(), "B, zz, ", F.when(_size() % 5 == 0, "A1234").otherwise(""), "</td></tr></table></div>",
    )
    rows = pages.device_pages(_parts(spark, d).select(_id().alias("page_id"), html.alias("html"), F.when(_size() % 5 == 0, "Samsung").alias("brand")), ("Display",))
    return rows.select("page_id", "name", F.array_join(F.transform("specs", lambda r: F.concat_ws("", r["section"], F.lit("/"), r["k"], F.lit("="), r["v"])), ",").alias("specs"), F.array_join("models", ",").alias("models"))


@_(f"WITH {P} SELECT id AS page_id, name, size::VARCHAR AS width, CASE WHEN size % 2 = 0 THEN 'http://i/1' ELSE 'http://i/1,http://i/2' END AS images, 'M' || id AS model FROM p WHERE size % 7 > 0")
def json_ld_specs(spark, d):
    image = F.when(_size() % 7 == 0, '""').when(_size() % 2 == 0, '"http://i/1"').otherwise('["http://i/1","http://i/2","x"]')
    block = _text('{"@graph":[{"@type":"Product","name":"', _name(), '","mpn":"M', _id(), '","additionalProperty":[', F.when(_size() % 7 == 0, "").otherwise(_text('{"name":"width","value":', _size(), "}")), '],"image":', image, "}]}")
    rows = pages.json_ld_products(_parts(spark, d).select(_id().alias("page_id"), _text('<script type="application/ld+json">', block, "</script>").alias("html")))
    return rows.select("page_id", "name", F.try_element_at("specs", F.lit("width")).alias("width"), F.array_join("images", ",").alias("images"), "model")


@_(f"WITH {P} SELECT id, size || ' cm' AS width, 'red' AS hue FROM p")
def key_value_lines(spark, d):
    html = _text("<ul><li>Width: ", _size(), " cm</li><li>no pair</li><li><b>Hue</b>: red</li><li>Width: 9</li></ul>")
    found = extract.key_values(extract.list_items(html))
    return _parts(spark, d).select("id", F.try_element_at(found, F.lit("Width")).alias("width"), F.try_element_at(found, F.lit("Hue")).alias("hue"))


@_(f"WITH {P} SELECT id AS product_id, CASE WHEN size % 2 = 0 THEN 'maker' WHEN size % 3 = 0 THEN 'device' ELSE 'store' END AS source FROM p")
def enrichment_waterfall(spark, d):
    source = lambda n, name, has: F.struct(F.lit(n).alias("priority"), F.lit(name).alias("source"), F.when(has, F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.create_map().cast("map<string,string>")).alias("specs"))
    rows = _parts(spark, d).select(_id().alias("product_id"), F.inline(F.array(source(0, "maker", _size() % 2 == 0), source(1, "device", _size() % 3 == 0), source(2, "store", F.lit(True)))))
    return enrichment.first_source(rows.withColumn("images", F.array().cast("array<string>"))).select("product_id", "source")


@_(f"WITH {P} SELECT id, strip_accents('é' || name || 'Çë') AS plain FROM p")
def plain_letters(spark, d):
    return _parts(spark, d).select("id", T.strip_diacritics(_text("é", _name(), "Çë")).alias("plain"))


@_(f"WITH {P} SELECT id, (id * 7919) % 256 * 0.299::DOUBLE + size * 0.587::DOUBLE + 17 * 0.114::DOUBLE > 150 AS light FROM p")
def light_colours(spark, d):
    return _parts(spark, d).select("id", enrichment.is_light(_text("#", F.lpad(F.hex((_id() * 7919) % 256), 2, "0"), F.lpad(F.hex(_size()), 2, "0"), "11")).alias("light"))


@_("SELECT c_custkey AS id, least(365, greatest(30, CASE WHEN c_custkey % 3 = 0 OR c_custkey = 0 THEN 365 ELSE c_custkey END), 90)::INT AS days FROM customer")
def history_days(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), enrichment.history_days(F.when(key % 3 == 0, "x").otherwise(_text(key, " days"))).alias("days"))


@_("""WITH s AS (SELECT DISTINCT user_id AS id, event_type AS section FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section) AS n FROM s) SELECT id, string_agg(section || ':a,b,c', '|' ORDER BY n) AS preview FROM r WHERE n <= 3 GROUP BY id""")
def spec_preview(spark, d):
    rows = A.events(spark, d).select(F.col("user_id").alias("id"), F.col("event_type").alias("section")).distinct()
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("k"), F.lit("v").alias("v")) for i, k in enumerate("abcd")])
    first = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("section")).cast("int")
    out = enrichment.spec_preview(rows.select("id", "section", first.alias("first"), items.alias("items")))
    shown = F.transform("preview", lambda s: F.concat(s["section"], F.lit(":"), F.array_join(F.transform(s["items"], lambda i: i["k"]), ",")))
    return out.select("id", F.array_join(shown, "|").alias("preview"))


@_("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html FROM pages")
def entities_of_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.decoded_entities(F.col("html")).alias("html"))


_ALL_STORES = "SELECT product_id, day, " + ", ".join(f"min(price) FILTER (WHERE store_id = {s}) AS store_{s}" for s in range(10))


@_(f"WITH {HISTORY} {_ALL_STORES} FROM (SELECT product_id, day, store_id % 10 AS store_id, min(price) AS price FROM history GROUP BY ALL) GROUP BY product_id, day")
def history_pivot_all(spark, d):
    """Every store's prices, stores taken together by the last digit."""
    rows = A.history(spark, d).withColumn("store_id", F.col("store_id") % 10)
    return history.pivot_by_store(rows, list(range(10)))


@_(f"WITH {STATE}, k AS (SELECT family, brand, count(*) AS members, min(id) AS first FROM ({'SELECT p_partkey AS id, p_name AS family, p_brand AS brand FROM part'}) GROUP BY ALL HAVING count(*) > 1) SELECT p_partkey AS id, first AS class, members - 1 AS siblings FROM part JOIN k ON p_name = family AND p_brand = brand")
def sibling_classes(spark, d):
    """Products with siblings, as classes: no pairs are made."""
    rows = A.products(spark, d).select("id", "family", "brand")
    sizes = rows.groupBy("family", "brand").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("class")).filter("members > 1")
    return rows.join(sizes, ["family", "brand"]).select("id", "class", (F.col("members") - 1).alias("siblings"))
