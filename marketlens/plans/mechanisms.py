"""Queries on dictionary joins, page trees, stored tables and streams, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.lexicon import LexiconTables
from marketlens.functions.rows import tasks_for
from marketlens.operators import dictionary, discovery, extract, history, matching, offers, pagetree, pricequery, pricing, search, searchindex, state
from marketlens.operators.growing import GrowingClasses
from marketlens.plans.catalogue import AS_OF, HISTORY, LEXICON, MATCH, NAMES, OFFERS, PROBES, PRODUCTS, STATE, SUMMARY, TRENDS, _keyed
from marketlens.plans.market import _RECORDS, REGISTRY, P, _parts, _records, _text
from marketlens.sources import adapters as A
from marketlens.sources import payloads
from marketlens.sources.history_table import HistoryTable
from marketlens.sources.shared import shared_dir
from marketlens.sources.snapshots import Snapshots
from marketlens.sources.tables import table
from marketlens.streaming.refresh import STATE as REFRESH_STATE
from marketlens.streaming.refresh import RefreshTables

_ = REGISTRY.query

# --- dictionary rules ---------------------------------------------------------------
# A lexicon with an entry per order line, among which the nouns of the part table are the first and the last.

_NAMED = """p AS (SELECT p_partkey AS id, p_name || ' w' || p_partkey || '-' || (1 + p_size % 7) || ' x' AS name, CASE WHEN p_size % 10 = 0 THEN 'Acme' ELSE 'Others' END AS vendor, p_name FROM part)"""
_BRAND_SQL = """CASE WHEN p_name LIKE '% widget' THEN 'Widget' WHEN code IS NOT NULL THEN code WHEN p_name LIKE '% ring' THEN 'Ring' ELSE string_split(name, ' ')[CASE WHEN split_part(name, ' ', 1) IN ('red', 'blue') THEN 2 ELSE 1 END] END"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """ord and word: a code per order line, after Widget and before Ring."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), _text("W", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("word"))
    return lines.union(spark.createDataFrame([(-1, "Widget"), (2**60, "Ring")], "ord long, word string"))


def _generic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("red",), ("Blue",)], "word string")


def _named(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("size")
    return _parts(spark, d).select("id", _text(F.col("name"), " w", F.col("id"), "-", 1 + size % 7, " x").alias("name"), F.when(size % 10 == 0, "Acme").otherwise("Others").alias("vendor"))


@_(f"WITH {_NAMED} SELECT id, CASE WHEN vendor = 'Acme' THEN 'Acme' ELSE {_BRAND_SQL} END AS brand FROM p LEFT JOIN (SELECT DISTINCT 'W' || l_orderkey || '-' || l_linenumber AS code FROM lineitem) ON lower(code) = string_split(name, ' ')[3]")
def brand_by_table(spark, d):
    names = _named(spark, d).select(F.col("id").alias("key"), F.col("name").alias("text"), "vendor")
    return dictionary.brands(names, _lexicon(spark, d), _generic(spark)).select(F.col("key").alias("id"), "brand")


@_("""WITH r AS (SELECT word, row_number() OVER (ORDER BY word) AS ord, 'c' || length(word) AS category FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark)),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents), b AS (SELECT doc_id, min(ord) AS ord FROM w JOIN r USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(category, 'tjera') AS category, coalesce(word, 'Other') AS subcategory FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN r USING (ord)""")
def category_by_table(spark, d):
    """Whole documents by the first word, in order of the alphabet, of all words of the benchmark."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), 0)).alias("word")
    rules = table(spark, d, "benchmark").select(words).distinct()
    # the order of a word is its place among words of its first bytes: enough letters for these words, and no window over all
    code = F.conv(F.rpad(F.hex(F.encode(F.substring("word", 1, 7), "UTF-8")), 14, "0"), 16, 10).cast("long")
    firsts = rules.select("word", (code * 100).alias("code"))
    rules = firsts.join(firsts.groupBy("code").agg(F.array_sort(F.collect_list("word")).alias("same")), "code")
    rules = rules.select((F.col("code") + F.array_position("same", F.col("word"))).alias("ord"), _text("c", F.length("word")).alias("category"), F.col("word").alias("subcategory"), "word")
    found = dictionary.categories(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), rules)
    return found.select(F.col("key").alias("doc_id"), "category", "subcategory")


@_(f"WITH {_NAMED} SELECT 'a-' || id AS id, name AS family, {_BRAND_SQL} AS brand, CASE WHEN code IS NOT NULL THEN 'known' WHEN p_name LIKE 'hot %' THEN 'hot goods' ELSE 'tjera' END AS category FROM p LEFT JOIN (SELECT DISTINCT 'W' || l_orderkey || '-' || l_linenumber AS code FROM lineitem) ON lower(code) = string_split(name, ' ')[3]")
def flat_source_by_tables(spark, d):
    """A payload source whose brands and categories come from tables."""
    body = _text('[{"id":', F.col("id"), ',"name":"', F.col("name"), '"}]')
    codes = _lexicon(spark, d).filter("ord between 0 and 1000000000000").select("ord", F.lit("known").alias("category"), F.lit("Known").alias("subcategory"), "word")
    rules = codes.union(spark.createDataFrame([(2**60, "hot goods", "Hot", "hot")], "ord long, category string, subcategory string, word string"))
    rows = discovery.flat(_named(spark, d).select(F.lit("a").alias("store"), body.alias("body")), LexiconTables(_lexicon(spark, d), _generic(spark), rules))
    return rows.select("id", "family", "brand", "category")


# --- pages as trees -------------------------------------------------------------------

_BARE = r"""h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS html FROM pages)"""


def _decoded(text: str) -> str:
    for name, char in (("quot", '"'), ("apos", "''"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


@_(rf"""WITH {_BARE}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"[^>]*>', 1)) AS url FROM h) SELECT page_id, {_decoded("url")} AS url FROM l""")
def tree_links(spark, d):
    """Links of the real pages by the tag stack: those in comments and scripts are none."""
    found = pagetree.elements(table(spark, d, "pages"), ("a",))
    return found.select("page_id", F.col("attrs")["href"].alias("url")).filter("url is not null")


@_(rf"""WITH {_BARE}, l AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, '(?s)<li\b[^>]*>(.*?)</li>', 1)), '<[^>]*>', '', 'g') AS item FROM h)
SELECT page_id, trim(regexp_replace({_decoded("item")}, '\s+', ' ', 'g')) AS item FROM l""")
def tree_lists(spark, d):
    found = pagetree.elements(table(spark, d, "pages"), ("li",))
    return found.select("page_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("item"))


def _spec_page():
    """A layout table around a table of specifications with sections, quotes of every kind, unclosed cells; a list; attributes."""
    name, size = F.col("name"), F.col("size")
    return _text(
        "<table width=100%><tr><td>", "<table class=specs><tr><th colspan='2'>Display &amp; more", F.when(size % 4 == 0, " x" * 40).otherwise(""), "<tr><td title='a > b'>Size<td><b>", size, "</b> in</tr><tr><td>Name</td><td>", name,
        "</td></tr></table></td></tr></table>", "<dl><dt>Weight<dd>", size, " kg<dt>Lone</dl>", '<ul class="a product-attributes"><li><span class="attr-label">Colour</span> <span class="attr-value">', name,
        "</span><li><span class=attr-label>Price</span><span class='attr-value'>", F.col("price"), "</span></ul>",
    )


@_(f"""WITH {P}, s AS (SELECT *, CASE WHEN size % 4 = 0 THEN '' ELSE 'Display & more: ' END AS head FROM p)
SELECT id AS page_id, unnest([head || 'Size', head || 'Name', 'Weight', 'Colour', 'Price']) AS k, unnest([size || ' in', name, size || ' kg', name, price::VARCHAR]) AS v FROM s""")
def tree_specs(spark, d):
    """Specifications of pages with nested tables; of equal keys the last counts."""
    pages = _parts(spark, d).select(F.col("id").alias("page_id"), _spec_page().alias("html"))
    found = pagetree.by_page(pagetree.elements(pages, classes=("product-attributes", "attr-label", "attr-value")))
    attributes = pagetree.attribute_specs(found, (("product-attributes", "li", (".attr-label", "th"), (".attr-value", "td")),))
    return pagetree.last_said(pagetree.table_specs(found).unionByName(pagetree.definition_specs(found)).unionByName(attributes))


@_(f"WITH {P} SELECT id AS page_id, name, unnest(['', 'Body', 'Body']) AS section, unnest(['Launch', 'Size', 'Note']) AS k, unnest([size::VARCHAR, size || ' mm', 'a b']) AS v FROM p")
def tree_device(spark, d):
    """Device pages with a table inside an information cell."""
    name, size = F.col("name"), F.col("size")
    html = _text(
        "<h1 class='specs-phone-name-title modelname'>", name, "</h1><table><tr><td class=ttl>Launch<td class='nfo x'>", size, "</table><table><tr><th>Body</th><td class='ttl'>Size</td><td class=nfo>", size,
        " <i>mm</i></td></tr><tr><td class=ttl>Note</td><td class=nfo><table><tr><td>a <td>b</table></td></tr></table>",
    )
    pages = _parts(spark, d).select(F.col("id").alias("page_id"), html.alias("html")).union(spark.createDataFrame([(-1, "<table><tr><td class=ttl>a<td class=nfo>b</table>"), (-2, None)], "page_id long, html string"))
    return pagetree.device_specs(pages)


@_(f"WITH {P} SELECT id AS page_id, array_to_string(list_filter(['http://m/media/0', 'http://x/product/' || id, 'http://x/product/1' || id, CASE WHEN size % 2 = 0 THEN 'http://l/media/late' END], lambda x: x IS NOT NULL), ' ') AS images FROM p")
def tree_images(spark, d):
    size = F.col("size")
    html = _text(
        "<meta content='http://m/media/0' property=og:image><img src=http://x/product/", F.col("id"), "><img src='http://x/product/logo'><img src=http://x/product/1", F.col("id"), "><img src=/product/2><img src='http://x/product/", F.col("id"), "'>",
        F.when(size % 2 == 0, "<img src='' data-src=http://l/media/late>").otherwise("<!-- <img src='http://l/media/late'> -->"),
    )
    found = pagetree.elements(_parts(spark, d).select(F.col("id").alias("page_id"), html.alias("html")), ("img", "meta"))
    return pagetree.images(found).select("page_id", F.array_join("images", " ").alias("images"))


# --- stored tables --------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_(f"""WITH {HISTORY}, old AS (SELECT * FROM history WHERE day BETWEEN {AS_OF} - 95 AND {AS_OF} - 5), new AS (
  SELECT product_id, day, store_id, price + 1 AS price FROM history WHERE day BETWEEN {AS_OF} - 6 AND {AS_OF} AND product_id % 2 = 0)
SELECT product_id, day, store_id, price FROM new UNION ALL SELECT product_id, day, store_id, price FROM old ANTI JOIN new USING (product_id, day, store_id) WHERE day >= {AS_OF} - 90""")
def history_table(spark, d):
    """The history up to five days ago as a table by day; then a week's prices come in, and the days that are too old go."""
    last = A.last_day(spark, d)
    stored = HistoryTable(spark, _path(spark, "history"))
    rows = A.history(spark, d)
    stored.upsert(rows.filter(F.col("day") <= F.lit(last - timedelta(days=5))), last - timedelta(days=5))
    week = rows.filter((F.col("day") >= F.lit(last - timedelta(days=6))) & (F.col("product_id") % 2 == 0))
    stored.upsert(week.withColumn("price", F.col("price") + 1), last)
    return stored.read()


@_(f"WITH {HISTORY} SELECT product_id, day, store_id, price FROM history WHERE product_id % 7 = 0 AND day >= {AS_OF} - 30")
def history_table_range(spark, d):
    last = A.last_day(spark, d)
    stored = HistoryTable(spark, _path(spark, "history"))
    stored.upsert(A.history(spark, d), last)
    return stored.range(last, 30).filter(F.col("product_id") % 7 == 0)


@_(f"WITH {TRENDS} SELECT product_id, score * 2 AS score FROM trends")
def trends_overwrite(spark, d):
    """Trends are replaced as a whole; a run that fails afterwards leaves them as they are."""
    stored = Snapshots(spark, _path(spark, "trends"), "product_id long, score long")
    rows = A.trends(spark, d)
    stored.overwrite(rows)
    stored.overwrite(rows.withColumn("score", F.col("score") * 2))
    return stored.read()


@_(f"""WITH {_RECORDS} SELECT key, store_id, CASE WHEN key::BIGINT % 3 = 0 THEN price + 2 ELSE price END AS price, CASE WHEN key::BIGINT % 3 = 0 THEN {AS_OF}::TIMESTAMP ELSE refreshed_at END AS refreshed_at FROM records""")
def price_records_merge(spark, d):
    """Price records as versions; two refreshes, each on the rows that the one before left."""
    now = A.as_of(spark, d).cast("timestamp_ntz")
    stored = Snapshots(spark, _path(spark, "prices"), "key string, store_id long, price double, refreshed_at timestamp_ntz")
    stored.overwrite(_records(spark, d))

    def refreshed(rows: DataFrame) -> DataFrame:
        new = rows.filter(F.col("key").cast("long") % 3 == 0).withColumn("price", F.col("price") + 1).drop("refreshed_at")
        return pricequery.price_upsert(rows, new, now)

    stored.merge(refreshed)
    stored.merge(refreshed)
    stored.vacuum()
    return stored.read()


# --- search index ---------------------------------------------------------------------

_ASKED = """q AS (SELECT min(p_partkey) AS query_id, p_name AS q FROM part GROUP BY p_name UNION ALL SELECT -1 - min(p_partkey), substr(p_name, 2, length(p_name) - 3) || ' ' || substr(p_name, 1, 2) FROM part GROUP BY p_name),
words AS (SELECT query_id, lower(trim(q)) AS q, list_filter(string_split(lower(q), ' '), lambda w: w <> '') AS ws FROM q),
found AS (SELECT query_id, id, family, q, ws, len(list_filter(ws, lambda w: contains(lower(family), w))) AS hits,
    lower(family || chr(10) || brand || chr(10) || model_number || chr(10) || family || ' ' || brand || ' ' || family) AS hay FROM words, products),
hit AS (SELECT query_id, id, family, CASE WHEN contains(lower(family), q) THEN 100.0 ELSE 0 END::DOUBLE + hits * 10 + CASE WHEN hits = len(ws) THEN 20 ELSE 0 END + CASE WHEN starts_with(lower(family), q) THEN 30 ELSE 0 END
    + hits / len(string_split(family, ' ')) * 20 - length(family) * 0.15::DOUBLE AS score FROM found WHERE len(list_filter(ws, lambda w: NOT contains(hay, w))) = 0)"""


def _searched(spark: SparkSession, d: str) -> tuple[searchindex.SearchIndex, DataFrame]:
    """The index of all products; as queries every name, and every name without its ends and with its first letters behind."""
    index = searchindex.build(A.products(spark, d), _path(spark, "search"))
    names = A.products(spark, d).groupBy("family").agg(F.min("id").alias("id"))
    cut = _text(F.expr("substr(family, 2, length(family) - 3)"), " ", F.substring("family", 1, 2))
    return index, names.select(F.col("id").alias("query_id"), F.col("family").alias("query")).union(names.select(-1 - F.col("id"), cut))


@_(f"WITH {PRODUCTS}, {_ASKED} SELECT query_id, id, round(score, 6) AS score FROM hit")
def search_batch(spark, d):
    return searchindex.search(*_searched(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


@_(f"WITH {PRODUCTS}, {_ASKED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM hit QUALIFY place <= 6")
def search_suggestions(spark, d):
    return searchindex.suggestions(*_searched(spark, d)).select("query_id", "id", "place")


# --- refresh as a stream --------------------------------------------------------------
# Two micro-batches an hour apart: even products, then the odd ones and every tenth again, a little cheaper.

_STREAM = OFFERS + f""", r AS (SELECT product_id, store_id, CASE WHEN store_id % 7 > 0 THEN price END AS price, CASE WHEN store_id % 7 = 0 THEN CASE WHEN product_id % 3 = 0 THEN 'not_found' ELSE 'timeout' END END AS error,
  store_id % 5 = 0 AS suspicious, CASE WHEN store_id % 3 = 0 THEN 'n' || product_id END AS native, least(100, store_id) AS confidence FROM offers),
b1 AS (SELECT * FROM r WHERE product_id % 2 = 0), b2 AS (SELECT * REPLACE (price - 1 AS price) FROM r WHERE product_id % 2 = 1 OR product_id % 10 = 0),
m1 AS (SELECT product_id, min(price) AS low, count(*) AS n FROM b1 WHERE price IS NOT NULL AND NOT suspicious GROUP BY 1), m2 AS (SELECT product_id, min(price) AS low, count(*) AS n FROM b2 WHERE price IS NOT NULL AND NOT suspicious GROUP BY 1),
t1 AS (SELECT {AS_OF}::TIMESTAMP AS now), a AS (SELECT product_id, o_custkey AS subscriber, floor(max(price))::BIGINT AS threshold, max(o_orderdate) AS last_notified FROM obs JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n1 AS (SELECT product_id, subscriber, low FROM a JOIN m1 USING (product_id), t1 WHERE threshold >= low AND (last_notified IS NULL OR last_notified < now - INTERVAL 24 HOURS)),
n2 AS (SELECT product_id, subscriber, low FROM a JOIN m2 USING (product_id), t1 WHERE threshold >= low AND (last_notified IS NULL OR last_notified < now - INTERVAL 23 HOURS) AND (product_id, subscriber) NOT IN (SELECT (product_id, subscriber) FROM n1))"""


def _streamed(spark: SparkSession, d: str) -> RefreshTables:
    """The tables after the stream has read both batches; a tenth of the mappings was approved before."""
    store, product = F.col("store_id"), F.col("product_id")
    lost, now = store % 7 == 0, A.as_of(spark, d).cast("timestamp")
    tasks = tasks_for(spark, table(spark, d, "lineitem").count())
    rows = A.offers(spark, d, tasks).select(
        "product_id", "store_id", F.when(~lost, F.col("price")).alias("price"), "in_stock", F.when(lost, F.when(product % 3 == 0, "not_found").otherwise("timeout")).alias("error"),
        F.when(store % 3 == 0, _text("n", product)).alias("store_product_id"), F.least(F.lit(100), "store_id").cast("double").alias("confidence"), (store % 5 == 0).alias("suspicious"), F.lit(False).alias("overpriced"), now.alias("at"),
    )
    path = _path(spark, "refresh")
    tables = RefreshTables(spark, path)
    approved = rows.filter("store_product_id is not null and product_id % 10 = 1").select("store_id", "store_product_id", F.lit(-1).cast("long").alias("product_id"), F.lit(1).alias("confidence"), F.lit("approved").alias("status"))
    tables.load(A.catalogue_state(spark, d, tasks), approved, A.alerts(spark, d, tasks))
    later = rows.filter((product % 2 == 1) | (product % 10 == 0)).withColumns({"price": F.col("price") - 1, "at": F.col("at") + F.expr("INTERVAL 1 HOUR")})
    for batch in (rows.filter(product % 2 == 0), later):  # what is there when the stream starts again is one batch, in however many files
        batch.write.mode("append").parquet(f"{path}/offers")
        tables.run(spark.readStream.schema(rows.schema).parquet(f"{path}/offers")).awaitTermination()
    return tables


@_(f"""WITH {_STREAM}, o AS (SELECT product_id, min(price) AS low, count(DISTINCT store_id) AS n, max(day) AS seen FROM obs GROUP BY 1)
SELECT o.product_id, coalesce(m2.low, m1.low, o.low) AS lowest_price, coalesce(m2.n, m1.n, o.n) AS store_count, CASE WHEN m1.product_id IS NULL AND m2.product_id IS NULL THEN seen ELSE {AS_OF} END AS last_seen, 'discovered' AS status
FROM o LEFT JOIN m1 USING (product_id) LEFT JOIN m2 USING (product_id)""")
def stream_refresh_state(spark, d):
    return _streamed(spark, d).state.read()


@_(f"""WITH {_STREAM} SELECT store_id, native AS store_product_id, CASE WHEN product_id % 10 = 1 THEN -1 ELSE product_id END AS product_id, CASE WHEN product_id % 10 = 1 THEN 1 ELSE confidence END::INT AS confidence,
CASE WHEN product_id % 10 = 1 THEN 'approved' ELSE 'pending' END AS status FROM r WHERE native IS NOT NULL""")
def stream_refresh_mappings(spark, d):
    return _streamed(spark, d).mappings.read()


@_(f"WITH {_STREAM} SELECT product_id, subscriber, low AS lowest_price, 0::BIGINT AS batch FROM n1 UNION ALL SELECT product_id, subscriber, low, 1 FROM n2")
def stream_refresh_notices(spark, d):
    return _streamed(spark, d).notices().select("product_id", "subscriber", "lowest_price", "batch")


@_(f"WITH {_STREAM}, w AS (SELECT product_id, store_id, price, 0 AS n FROM b1 UNION ALL SELECT product_id, store_id, price, 1 FROM b2) SELECT product_id, {AS_OF} AS day, store_id, arg_max_null(price, n) AS price FROM w GROUP BY product_id, store_id")
def stream_refresh_history(spark, d):
    return _streamed(spark, d).history.read()


# --- rejected payloads, order of names, co-located merges, matching without numbers ----

_BODIES = f"{P}, b AS (SELECT *, CASE size % 6 WHEN 0 THEN 'unreadable body' WHEN 1 THEN 'empty body' WHEN 2 THEN 'no list' WHEN 3 THEN 'item lacks $.title' END AS reason FROM p)"


def _payload_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Bodies of two products each: cut off, blank, without the list, with a product that has no title, and whole ones."""
    size, whole = F.col("size"), _text('{"products":[{"title":"', F.col("name"), '","id":', F.col("id"), '},{"title":"x","id":-1}]}')
    body = F.when(size % 6 == 0, F.expr("substr(whole, 1, length(whole) - 5)")).when(size % 6 == 1, F.when(size % 12 == 1, "  ")).when(size % 6 == 2, '{"items":[]}').when(size % 6 == 3, F.replace("whole", F.lit('"title":"x"'), F.lit('"name":"x"'))).otherwise(F.col("whole"))
    rows = _parts(spark, d).withColumn("whole", whole).select(F.col("brand").alias("store"), body.alias("body"))
    return payloads.quarantined(rows, "$.products", ("$.title",))


@_(f"WITH {_BODIES} SELECT brand AS store, reason, count(*) AS n FROM b WHERE reason IS NOT NULL GROUP BY ALL")
def payloads_rejected(spark, d):
    return payloads.rejections(_payload_items(spark, d)[1], "store")


@_(f"WITH {_BODIES} SELECT brand AS store, name AS title, id FROM b WHERE size % 6 >= 3 UNION ALL SELECT brand, 'x', -1 FROM b WHERE size % 6 > 3")
def payloads_read(spark, d):
    return _payload_items(spark, d)[0].select("store", payloads.field("$.title").alias("title"), payloads.field("$.id", "long").alias("id"))


@_(f"WITH {PRODUCTS} SELECT id, family FROM products ORDER BY family, id LIMIT 40 OFFSET 80")
def names_third_page(spark, d):
    """The third page by name, each from the last row of the page before."""
    rows, after = A.products(spark, d).select("id", "family"), None
    for _page in range(2):
        last = search.collated_page(rows, after).agg(F.max_by(F.struct("family", "id"), F.struct(F.collate("family", "UNICODE").alias("n"), "id")).alias("m")).first().m
        after = (last.family, last.id)
    return search.collated_page(rows, after)


@_(f"""WITH {STATE}, n AS (SELECT product_id, lowest_price - 1 AS low FROM state WHERE product_id % 4 = 0 UNION ALL SELECT -1 - product_id, 5.0 FROM state WHERE product_id % 50 = 0)
SELECT coalesce(s.product_id, n.product_id) AS product_id, CASE WHEN n.product_id IS NOT NULL THEN low ELSE lowest_price END AS lowest_price, CASE WHEN n.product_id IS NOT NULL THEN {AS_OF} ELSE last_seen END AS last_seen, 'discovered' AS status
FROM state s FULL JOIN n ON s.product_id = n.product_id""")
def state_merge_bucketed(spark, d):
    """The catalogue state stored in buckets by product; updates alone are shuffled."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = Snapshots(spark, _path(spark, "state"), REFRESH_STATE, (("product_id",), buckets))
    stored.overwrite(A.catalogue_state(spark, d))
    known = stored.read()
    updates = known.filter("product_id % 4 = 0").select("product_id", (F.col("lowest_price") - 1).alias("lowest_price")).union(known.filter("product_id % 50 = 0").select(-1 - F.col("product_id"), F.lit(5.0)))
    stored.merge(lambda rows: state.merge_state(rows, updates.withColumn("store_count", F.lit(None).cast("long")), A.as_of(spark, d)))
    stored.vacuum(1)
    return stored.read().drop("store_count")


_PLAIN_NAMES = "names AS (SELECT p_partkey AS id, p_name || CASE WHEN p_size % 3 = 0 THEN ' Pro' WHEN p_size % 5 = 0 THEN ' Ultra' ELSE '' END AS name, p_brand AS brand FROM part)"


@_(f"WITH {MATCH.replace(NAMES, _PLAIN_NAMES)} SELECT query_id, candidate_id, round(score, 6) AS score FROM t WHERE score > 0")
def match_without_numbers(spark, d):
    size = F.col("size")
    names = _parts(spark, d).select("id", _text(F.col("name"), F.when(size % 3 == 0, " Pro").when(size % 5 == 0, " Ultra").otherwise("")).alias("name"), "brand")
    queries = names.groupBy("brand", F.col("name").alias("query")).agg(F.min("id").alias("query_id"))
    candidates = names.groupBy("brand", "name").agg(F.min("id").alias("candidate_id"))
    return matching.scored_pairs(queries, candidates, "brand", LEXICON).select("query_id", "candidate_id", F.round("score", 6).alias("score"))


# --- duplicate classes that grow ------------------------------------------------------


@_(REGISTRY.oracles["duplicate_classes"])
def duplicate_classes_grown(spark, d):
    """The classes of the whole catalogue, taken in as two thirds, a third and, last, a hundredth that links them further."""
    rows, keys = _keyed(spark, d), ["fusion_key", "model_key"]
    grown = GrowingClasses(spark, _path(spark, "classes"))
    grown.add(rows.filter("id % 100 > 0 and id % 3 > 0"), keys)
    grown.add(rows.filter("id % 100 > 0 and id % 3 = 0"), keys)
    grown.add(rows.filter("id % 100 = 0"), keys)
    return grown.classes()


# --- pages asked for directly, probes, listings, texts of pages -------------------------

_SHOPS = [("1", "shopify", "https://one"), ("2", "shopware", "https://two/")]


def _asked_for(spark: SparkSession, d: str) -> DataFrame:
    """Products of both shops: those of even size came from shop 1; every third has an address in shop 2, every ninth of these for another colour than is asked for."""
    size, num = F.col("size"), F.col("id")
    own = _text(F.when(size % 2 == 0, "1-h").otherwise("x-h"), num)
    terms = F.array_compact(F.array(F.col("name"), F.when(num % 3 == 0, _text("https://two/p/", num, F.when(num % 9 == 0, "-green").otherwise(""))), F.when(num % 9 == 0, F.lit("!x Red"))))
    return _parts(spark, d).select("id", "size", "price", "name", own.alias("product_id"), terms.alias("search_terms"))


@_(f"""WITH {P}, a AS (SELECT CASE WHEN size % 2 = 0 THEN '1-h' ELSE 'x-h' END || id AS product_id, size, id, name FROM p)
SELECT product_id, '1' AS store_id, 0 AS ord, 'own handle' AS kind, 'https://one/products/h' || id AS address FROM a WHERE size % 2 = 0
UNION ALL SELECT product_id, '2', 0, 'stored address', 'https://two/p/' || id FROM a WHERE id % 3 = 0 AND id % 9 > 0""")
def offer_lookups(spark, d):
    found = offers.direct_lookups(_asked_for(spark, d).select("product_id", "search_terms"), spark.createDataFrame(_SHOPS, "store_id string, platform string, url string"), LEXICON)
    return found.filter(F.col("kind") != offers.INFERRED)


@_(f"""WITH {P}, a AS (SELECT CASE WHEN size % 2 = 0 THEN '1-h' ELSE 'x-h' END || id AS product_id, * FROM p)
SELECT product_id, '1' AS store_id, CASE WHEN size % 2 = 0 THEN CASE WHEN id % 9 > 0 THEN price END ELSE 1.5 END AS price, CASE WHEN size % 2 = 0 AND id % 9 > 0 THEN id % 4 = 0 END AS in_stock,
  CASE WHEN size % 2 = 0 AND id % 9 = 0 THEN 'variant_unavailable' END AS error FROM a
UNION ALL SELECT product_id, '2', CASE WHEN id % 3 = 0 AND id % 9 > 0 THEN CASE WHEN size % 2 = 0 THEN price ELSE floor(price) END ELSE 1.5 END, CASE WHEN id % 3 = 0 AND id % 9 > 0 THEN CASE WHEN size % 2 = 0 THEN false ELSE true END END, NULL FROM a""")
def offers_direct_first(spark, d):
    """Answers of the own handles and stored addresses; elsewhere the search's price of 1.5 stands."""
    products, shops = _asked_for(spark, d), spark.createDataFrame(_SHOPS, "store_id string, platform string, url string")
    ask = offers.direct_lookups(products.select("product_id", "search_terms"), shops, LEXICON).filter(F.col("kind") != offers.INFERRED)
    ld = lambda price, stock: _text('<script type="application/ld+json">{"@type":"Product","name":"x","offers":{"price":', price, ',"availability":"', stock, '"}}</script>')
    shopify = _text('{"product":{"title":"', F.col("name"), '","options":[{"name":"Color"}],"variants":[{"option1":"', F.when(F.col("id") % 9 == 0, "Black").otherwise(""), '","price":"', F.col("price"), '"}]}}')
    page = F.when(F.col("size") % 2 == 0, ld(F.col("price"), F.lit("OutOfStock"))).otherwise(_text('<i class="delivery-status-indicator is-available">{"productPrice":"', F.floor("price"), '"}'))
    answers = ask.join(products, "product_id").join(shops.drop("url"), "store_id").select(
        "product_id", "store_id", "search_terms", "ord", "platform", "address", F.when(F.col("platform") == "shopify", shopify).otherwise(page).alias("body"),
        ld(F.lit("1"), F.when(F.col("id") % 4 == 0, "InStock").otherwise("OutOfStock")).alias("page"),
    )
    none = F.lit(None)
    searched = products.crossJoin(shops.select("store_id")).select(  # a row per product and shop
        "product_id", "store_id", F.lit(1.5).alias("price"), none.cast("boolean").alias("in_stock"), F.lit("/s").alias("product_url"), F.lit("x").alias("matched_name"), none.cast("string").alias("store_product_id"),
        F.lit(60).alias("confidence"), none.cast("string").alias("error"))
    return offers.direct_first(offers.direct(answers, LEXICON), searched).select("product_id", "store_id", "price", "in_stock", "error")


@_(f"""WITH {PROBES}, half AS (SELECT *, seen_at < (SELECT max(seen_at) FROM probes) - INTERVAL 10 DAYS AS early FROM probes),
flips AS (SELECT service, seen_at, early FROM (SELECT *, lag(status) OVER (PARTITION BY service ORDER BY seen_at, id) AS before FROM half) WHERE status = 'up' AND before IS DISTINCT FROM 'up')
SELECT service, arg_max(status, (seen_at, id)) AS last_status, max(seen_at) AS last_checked, (SELECT max(f.seen_at) FROM flips f WHERE f.service = half.service AND f.early) AS last_notified FROM half GROUP BY service""")
def probe_record(spark, d):
    """Probes in two runs; notices went out in the first only, and their times stay."""
    rows = A.probes(spark, d)
    last = rows.agg(F.max("at")).first()[0]
    early = F.col("at") < F.lit(last - timedelta(days=10))
    empty = spark.createDataFrame([], "service long, last_status string, last_checked timestamp_ntz, last_notified timestamp_ntz")
    first = state.record_probes(empty, rows.filter(early), state.probe_flips(rows.filter(early)))
    return state.record_probes(first, rows.filter(~early), state.probe_flips(rows).limit(0))


@_(f"""WITH {SUMMARY}, ids AS (SELECT product_id, string_agg(store_id::VARCHAR, ' ' ORDER BY price, store_id) AS ids FROM offers WHERE price IS NOT NULL GROUP BY 1)
SELECT id, best_price, store_count, in_stock, coalesce(ids, '') AS store_ids, (SELECT max(day) FROM offers o WHERE o.product_id = id)::TIMESTAMP AS refreshed_at FROM summary LEFT JOIN ids ON product_id = id""")
def offer_listing(spark, d):
    found = A.offers(spark, d)
    rows = pricing.offer_listing(A.products(spark, d), found, A.catalogue_state(spark, d), found.select("product_id", F.col("day").cast("timestamp_ntz").alias("refreshed_at")))
    return rows.select("id", "best_price", "store_count", "in_stock", F.array_join(F.transform("store_ids", lambda s: s.cast("string")), " ").alias("store_ids"), "refreshed_at")


@_(f"WITH {_BARE} SELECT page_id, sha256(trim(regexp_replace({_decoded("regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')")}, '[\\s\\x{{A0}}]+', ' ', 'g'))) AS text_sha256 FROM h")
def page_texts(spark, d):
    """The plain text of every page."""
    return table(spark, d, "pages").select("page_id", F.sha2(extract.plain(F.col("html")), 256).alias("text_sha256"))


@_(f"""WITH {_STREAM} SELECT product_id, subscriber, threshold, CASE WHEN (product_id, subscriber) IN (SELECT (product_id, subscriber) FROM n1) THEN {AS_OF}::TIMESTAMP
  WHEN (product_id, subscriber) IN (SELECT (product_id, subscriber) FROM n2) THEN {AS_OF}::TIMESTAMP + INTERVAL 1 HOUR ELSE last_notified END AS last_notified FROM a""")
def stream_refresh_alerts(spark, d):
    return _streamed(spark, d).alerts.read()


@_(f"WITH {HISTORY} SELECT product_id, day, string_agg(store_id || '=' || price::DECIMAL(14,2), ' ' ORDER BY store_id) AS prices FROM history GROUP BY product_id, day")
def history_by_day(spark, d):
    """Every store of each product and day."""
    rows = history.by_day(A.history(spark, d))
    text = F.transform(F.map_entries("prices"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("decimal(14,2)").cast("string")))
    return rows.select("product_id", "day", F.array_join(text, " ").alias("prices"))
