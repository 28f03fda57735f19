"""All driver-checked queries on the price-intelligence domain, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.lexicon import Words
from marketlens.functions.rows import spread
from marketlens.operators import discovery, enrichment, extract, fusion, history, matching, pricing, querying, reports, search, state
from marketlens.plans.registry import Registry
from marketlens.sources import adapters as A
from marketlens.sources.tables import table

REGISTRY = Registry()
_ = REGISTRY.query  # decorator: _(oracle SQL)

#: The words of these tables.
LEXICON = Words(tuple((c, c) for c in ("black", "white", "red", "blue", "green", "orange")), accessories=("case",), colour_slots=("colou?r",), storage_slots=("storage",))

# The domain tables as DuckDB sees them.
PRODUCTS = """products AS (
  SELECT p_partkey AS id, p_name AS family, p_brand AS brand, p_type AS category,
         CASE WHEN p_size <= 10 THEN 'Compact' WHEN p_size <= 30 THEN 'Standard' ELSE 'Large' END AS subcategory,
         p_retailprice AS list_price, p_size::VARCHAR AS model_number FROM part)"""
STORES = "stores AS (SELECT s_suppkey AS store_id, s_name AS store_name, s_acctbal >= 0 AS enabled FROM supplier)"
OBS = """obs AS (
  SELECT l_partkey AS product_id, l_suppkey AS store_id, l_shipdate::DATE AS day, l_extendedprice AS price,
         CASE WHEN l_linestatus = 'O' THEN true WHEN l_returnflag = 'N' THEN NULL ELSE false END AS in_stock, l_orderkey, l_linenumber FROM lineitem)"""
OFFERS = OBS + """, offers AS (
  SELECT product_id, store_id, price, day, in_stock FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY day DESC, price, l_orderkey, l_linenumber, in_stock DESC NULLS LAST) AS rn FROM obs) WHERE rn = 1)"""
FLAGGED = OFFERS + """, dev AS (
  SELECT *, CASE WHEN price > 0 AND count(*) FILTER (WHERE price > 0) OVER w >= 3
    THEN (price - avg(price) FILTER (WHERE price > 0) OVER w) / avg(price) FILTER (WHERE price > 0) OVER w END AS off
  FROM offers WINDOW w AS (PARTITION BY product_id)
), flagged AS (
  SELECT product_id, store_id, price, day, in_stock, coalesce(off < -0.4, false) AS suspicious, coalesce(off > 0.6, false) AS overpriced FROM dev)"""
HISTORY = OBS + ", history AS (SELECT product_id, day, store_id, min(price) AS price FROM obs GROUP BY ALL)"
STATE = OBS + """, state AS (
  SELECT product_id, min(price) AS lowest_price, count(DISTINCT store_id) AS store_count, max(day) AS last_seen, 'discovered' AS status FROM obs GROUP BY product_id)"""
SUMMARY = PRODUCTS + ", " + OFFERS + """, state AS (
  SELECT product_id, min(price) AS lowest_price, count(DISTINCT store_id) AS store_count FROM obs GROUP BY product_id
), rolled AS (
  SELECT product_id, min(price) AS best_price, count(price) AS store_count, bool_or(coalesce(in_stock, false)) AS any_stock FROM offers GROUP BY product_id
), summary AS (
  SELECT id, family, brand, category, subcategory, coalesce(best_price, lowest_price) AS best_price,
         CASE WHEN best_price IS NOT NULL THEN rolled.store_count ELSE coalesce(state.store_count, 0) END AS store_count, coalesce(any_stock, false) AS in_stock
  FROM products LEFT JOIN rolled ON rolled.product_id = id LEFT JOIN state ON state.product_id = id)"""
AS_OF = "(SELECT max(l_shipdate)::DATE FROM lineitem)"
ALERTS = OBS + """, alerts AS (
  SELECT product_id, o_custkey AS subscriber, floor(max(price))::BIGINT AS threshold, max(o_orderdate) AS last_notified
  FROM obs JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
PROBES = "probes AS (SELECT user_id AS service, event_id AS id, ts AS seen_at, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS status FROM events)"
TRENDS = """trends AS (
  SELECT (props->>'$.k')::BIGINT AS product_id, floor(avg(value) + 0.5)::BIGINT AS score FROM events WHERE (props->>'$.k') IS NOT NULL GROUP BY 1)"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return pricing.flag_outliers(A.offers(spark, d))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return pricing.product_summary(A.products(spark, d), A.offers(spark, d), A.catalogue_state(spark, d))


# --- prices -----------------------------------------------------------------


@_(f"WITH {OFFERS} SELECT * FROM offers")
def current_offers(spark, d):
    return A.offers(spark, d)


@_(f"WITH {FLAGGED} SELECT product_id, store_id, price, suspicious, overpriced FROM flagged")
def offer_outlier_flags(spark, d):
    return _flagged(spark, d).select("product_id", "store_id", "price", "suspicious", "overpriced")


@_(f"WITH {FLAGGED} SELECT product_id, min(price) AS lowest_price, count(*) AS store_count FROM flagged WHERE NOT suspicious GROUP BY product_id")
def offer_summary(spark, d):
    return pricing.price_summary(_flagged(spark, d))


@_(f"WITH {FLAGGED} SELECT product_id, min(price) AS best_price, max_by(store_id, (-price, store_id)) AS best_store FROM flagged WHERE NOT suspicious AND NOT overpriced GROUP BY product_id")
def best_store(spark, d):
    return pricing.best_store(_flagged(spark, d))


@_(f"WITH {OFFERS} SELECT product_id, store_id, price, price = min(price) OVER (PARTITION BY product_id) AS cheapest FROM offers")
def cheapest_marker(spark, d):
    return pricing.cheapest_marker(A.offers(spark, d)).select("product_id", "store_id", "price", "cheapest")


_VALID = {
    "v1": "price IS NOT NULL", "v2": "price > 0", "v3": "price IS NOT NULL AND NOT suspicious", "v4": "price IS NOT NULL AND NOT suspicious AND NOT overpriced",
    "v5": f"price IS NOT NULL AND NOT suspicious AND NOT overpriced AND date_diff('day', day, {AS_OF}) < 1", "v6": "price > 0 AND enabled",
}


def _valid_price(version: str):
    def query(spark, d):
        rows = _flagged(spark, d)
        if version == "v5":
            rows = pricing.mark_stale(rows, F.col("day"), A.as_of(spark, d))
        if version == "v6":
            rows = rows.join(A.stores(spark, d).select("store_id", "enabled"), "store_id")
        return rows.filter(pricing.PREDICATES[version]()).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least"))

    return query


for _v, _where in _VALID.items():
    _(f"WITH {STORES}, {FLAGGED} SELECT product_id, count(*) AS n, min(price) AS least FROM flagged JOIN stores USING (store_id) WHERE {_where} GROUP BY product_id", f"valid_price_{_v}")(_valid_price(_v))


@_(f"WITH {OFFERS} SELECT product_id, store_id, price, date_diff('day', day, {AS_OF}) >= 1 AS stale FROM offers")
def stale_flags(spark, d):
    return pricing.mark_stale(A.offers(spark, d), F.col("day"), A.as_of(spark, d)).select("product_id", "store_id", "price", "stale")


@_(f"WITH {PRODUCTS}, {FLAGGED} SELECT product_id, store_id, price, CASE WHEN suspicious THEN 'suspicious' ELSE 'overpriced' END AS reason, family AS name FROM flagged JOIN products ON id = product_id WHERE suspicious OR overpriced")
def flagged_prices(spark, d):
    return pricing.flagged(_flagged(spark, d), A.products(spark, d))


@_(f"""WITH {PRODUCTS}, {STORES}, {OFFERS}
SELECT p.id AS product_id, s.store_id, o.price, o.in_stock, CASE WHEN o.product_id IS NULL THEN 'not_found' END AS error
FROM products p CROSS JOIN (SELECT * FROM stores WHERE enabled) s LEFT JOIN offers o ON o.product_id = p.id AND o.store_id = s.store_id""")
def failure_rows(spark, d):
    return pricing.with_missing_stores(A.products(spark, d).select(F.col("id").alias("product_id")), A.stores(spark, d), A.offers(spark, d))


# --- search -----------------------------------------------------------------


@_(f"WITH {SUMMARY} SELECT * FROM summary")
def product_summary(spark, d):
    return _summary(spark, d)


_ORDER_SQL = {"price_asc": "best_price ASC NULLS LAST", "price_desc": "best_price DESC NULLS LAST", "stores": "store_count DESC", "az": "family ASC"}


def _page(order: str):
    return lambda spark, d: search.page(_summary(spark, d), order)


for _name, _order in (("price_page_asc", "price_asc"), ("price_page_desc", "price_desc"), ("stores_sort", "stores"), ("az_sort", "az")):
    _(f"WITH {SUMMARY} SELECT * FROM summary ORDER BY {_ORDER_SQL[_order]}, id LIMIT 40", _name)(_page(_order))

SEARCH = """scored AS (
  SELECT id, family, brand, category, subcategory,
         CASE WHEN contains(lower(family), 'red bolt') THEN 100.0 ELSE 0 END::DOUBLE + hits * 10 + CASE WHEN hits = 2 THEN 20 ELSE 0 END
         + CASE WHEN starts_with(lower(family), 'red bolt') THEN 30 ELSE 0 END + hits / len(string_split(family, ' ')) * 20 - length(family) * 0.15::DOUBLE AS score
  FROM (SELECT *, contains(lower(family), 'red')::INT + contains(lower(family), 'bolt')::INT AS hits,
               lower(family || chr(10) || brand || chr(10) || model_number || chr(10) || family || ' ' || brand || ' ' || family) AS hay FROM products)
  WHERE contains(hay, 'red') AND contains(hay, 'bolt'))"""


@_(f"WITH {PRODUCTS}, {SEARCH} SELECT id, family, brand, round(score, 6) AS score FROM scored")
def search_ranked(spark, d):
    return search.search(A.products(spark, d), " Red bolt").select("id", "family", "brand", F.round("score", 6).alias("score"))


@_(f"WITH {PRODUCTS}, {SEARCH} SELECT id, family, brand, category, subcategory FROM scored ORDER BY score DESC, id LIMIT 6")
def search_autocomplete(spark, d):
    return search.search(A.products(spark, d), "red bolt").orderBy(F.desc("score"), "id").limit(6).select("id", "family", "brand", "category", "subcategory")


@_(f"WITH {PRODUCTS} SELECT brand, count(*) AS n FROM products GROUP BY brand")
def brand_facets(spark, d):
    return search.brand_facet(A.products(spark, d))


@_(f"WITH {SUMMARY} SELECT coalesce(min(best_price), 0) AS least, coalesce(max(best_price), 0) AS most FROM summary")
def price_range(spark, d):
    return search.price_range(_summary(spark, d))


@_(f"WITH {PRODUCTS} SELECT DISTINCT subcategory FROM products WHERE subcategory <> ''")
def subcategory_list(spark, d):
    return search.subcategories(A.products(spark, d))


@_(f"WITH {SUMMARY} SELECT * FROM summary WHERE subcategory = 'Standard' AND brand IN ('Brand#2', 'Brand#4') AND best_price >= 500 AND best_price <= 20000 AND in_stock")
def facet_filtered(spark, d):
    return search.apply_filters(_summary(spark, d), search.Filters("Standard", ("Brand#2", "Brand#4"), 500.0, 20000.0, True))


# --- history ----------------------------------------------------------------


@_(f"WITH {HISTORY} SELECT product_id, day, store_id, price FROM history WHERE product_id = 7 AND day >= {AS_OF} - 90")
def history_range(spark, d):
    return history.range_scan(A.history(spark, d), 7, 365, A.as_of(spark, d))


@_(f"WITH {HISTORY} SELECT product_id, day, store_id, price FROM history WHERE day >= {AS_OF} - 90")
def history_retention(spark, d):
    return history.retain(A.history(spark, d), A.as_of(spark, d))


@_(f"""WITH {HISTORY} SELECT product_id, day, min(price) FILTER (WHERE store_id = 1) AS store_1, min(price) FILTER (WHERE store_id = 2) AS store_2, min(price) FILTER (WHERE store_id = 3) AS store_3
FROM history GROUP BY product_id, day""")
def history_pivot(spark, d):
    return history.pivot_by_store(A.history(spark, d), [1, 2, 3])


@_(f"""WITH {STORES}, {HISTORY}, r AS (
  SELECT product_id, price, day, store_id, row_number() OVER (PARTITION BY product_id ORDER BY price, day, store_id) AS n FROM history JOIN stores USING (store_id) WHERE enabled AND price > 0)
SELECT product_id, price, day, store_id FROM r WHERE n = 1""")
def history_minimum(spark, d):
    return history.global_minimum(A.history(spark, d), A.stores(spark, d))


@_(f"""WITH {HISTORY} SELECT product_id, day, store_id, CASE WHEN product_id % 10 = 0 AND day >= {AS_OF} - 30 THEN price + 1 ELSE price END AS price FROM history""")
def history_upsert(spark, d):
    rows = A.history(spark, d)
    new = rows.filter((F.col("product_id") % 10 == 0) & (F.col("day") >= F.date_sub(A.as_of(spark, d), 30))).withColumn("price", F.col("price") + 1)
    return history.upsert(rows, new)


@_(f"WITH {HISTORY} SELECT store_id, max(day) AS last_day FROM history WHERE price IS NOT NULL GROUP BY store_id")
def store_last_recorded(spark, d):
    return history.last_recorded(A.history(spark, d))


# --- state ------------------------------------------------------------------


@_(f"""WITH {STATE} SELECT product_id, CASE WHEN product_id % 3 = 0 THEN lowest_price - 1 ELSE lowest_price END AS lowest_price, store_count,
  CASE WHEN product_id % 3 = 0 THEN {AS_OF} ELSE last_seen END AS last_seen, status FROM state""")
def catalogue_state_merge(spark, d):
    rows = A.catalogue_state(spark, d)
    updates = rows.filter(F.col("product_id") % 3 == 0).select("product_id", (F.col("lowest_price") - 1).alias("lowest_price"), F.lit(None).cast("long").alias("store_count"))
    return state.merge_state(rows, updates, A.as_of(spark, d))


@_(f"WITH {STATE} SELECT product_id, lowest_price, store_count, last_seen, CASE WHEN last_seen < {AS_OF} - 30 THEN 'discontinued' ELSE status END AS status FROM state")
def discontinue_sweep(spark, d):
    return state.discontinue(A.catalogue_state(spark, d), A.as_of(spark, d))


_MAPPINGS = """old AS (SELECT l_suppkey AS store_id, l_partkey AS store_product_id, l_partkey AS product_id, 50 AS confidence,
    CASE WHEN l_partkey % 3 = 0 THEN 'approved' WHEN l_partkey % 3 = 1 THEN 'pending' ELSE 'rejected' END AS status FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL),
new AS (SELECT l_suppkey AS store_id, l_partkey AS store_product_id, l_partkey + 1 AS product_id, least(100, floor(max(l_quantity) * 3 + 0.5))::INT AS confidence FROM lineitem GROUP BY ALL)"""


@_(f"""WITH {_MAPPINGS} SELECT coalesce(old.store_id, new.store_id) AS store_id, coalesce(old.store_product_id, new.store_product_id) AS store_product_id,
  CASE WHEN old.status <> 'pending' THEN old.product_id ELSE new.product_id END AS product_id, CASE WHEN old.status <> 'pending' THEN old.confidence ELSE new.confidence END AS confidence,
  coalesce(old.status, 'pending') AS status FROM old FULL JOIN new ON old.store_id = new.store_id AND old.store_product_id = new.store_product_id""")
def mapping_merge_guarded(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("store_product_id")).agg((F.max("l_quantity") * 3).alias("confidence"))
    third = F.col("store_product_id") % 3
    old = rows.filter(F.col("store_product_id") % 2 == 0).select(
        "store_id", "store_product_id", F.col("store_product_id").alias("product_id"), F.lit(50).alias("confidence"), F.when(third == 0, "approved").when(third == 1, "pending").otherwise("rejected").alias("status")
    )
    return state.merge_mappings(old, rows.select("store_id", "store_product_id", (F.col("store_product_id") + 1).alias("product_id"), "confidence", F.lit(0).alias("ord")))


@_("SELECT event_id AS id, user_id % 6 AS store_id, props AS message FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 200")
def bounded_error_log(spark, d):
    return state.bounded_log(A.scraper_errors(spark, d), 200).select("id", "store_id", "message")


@_(f"""WITH {ALERTS}, low AS (SELECT product_id, min(price) AS lowest_price FROM obs GROUP BY 1)
SELECT product_id, subscriber, threshold, lowest_price FROM alerts JOIN low USING (product_id)
WHERE threshold >= lowest_price AND (last_notified IS NULL OR last_notified < {AS_OF}::TIMESTAMP - INTERVAL 24 HOURS)""")
def alerts_due(spark, d):
    lowest = A.observations(spark, d).groupBy("product_id").agg(F.min("price").alias("lowest_price"))
    return state.due_alerts(A.alerts(spark, d), lowest, A.as_of(spark, d).cast("timestamp_ntz")).select("product_id", "subscriber", "threshold", "lowest_price")


@_(f"WITH {ALERTS} SELECT product_id, subscriber, CASE WHEN subscriber % 5 = 0 THEN threshold + 10 ELSE threshold END AS threshold FROM alerts")
def alerts_upsert(spark, d):
    rows = A.alerts(spark, d)
    new = rows.filter(F.col("subscriber") % 5 == 0).select("product_id", "subscriber", (F.col("threshold") + 10).alias("threshold"))
    return state.upsert_alerts(rows, new).select("product_id", "subscriber", "threshold")


@_(f"WITH {ALERTS} SELECT product_id, subscriber, threshold, CASE WHEN subscriber % 7 = 0 THEN {AS_OF} ELSE last_notified::DATE END AS notified_day FROM alerts")
def alerts_mark(spark, d):
    rows = A.alerts(spark, d).withColumn("last_notified", F.col("last_notified").cast("date"))
    return state.mark_alerts(rows, rows.filter(F.col("subscriber") % 7 == 0), A.as_of(spark, d)).withColumnRenamed("last_notified", "notified_day")


@_(f"WITH {PROBES}, b AS (SELECT *, lag(status) OVER (PARTITION BY service ORDER BY seen_at, id) AS before FROM probes) SELECT service, id FROM b WHERE status = 'up' AND before IS DISTINCT FROM 'up'")
def probe_flips(spark, d):
    return state.probe_flips(A.probes(spark, d)).select("service", "id")


@_(f"WITH {PROBES} SELECT service, max_by(status, (seen_at, id)) AS status FROM probes GROUP BY service")
def probe_state(spark, d):
    return state.latest_probe(A.probes(spark, d)).select("service", "status")


# --- reports ----------------------------------------------------------------

COVERAGE = PRODUCTS + ", " + STATE + ", cov AS (SELECT id, brand, family, category, store_count, lowest_price FROM state JOIN products ON id = product_id)"


@_(f"""WITH {COVERAGE} SELECT store_count, count(*) AS n, (SELECT count(*) FROM cov) AS total, (SELECT count(*) FROM cov WHERE store_count >= 2) AS multi_store,
  (SELECT count(*) FROM cov WHERE store_count = 1) AS single_store FROM cov GROUP BY store_count""")
def store_coverage(spark, d):
    return reports.store_coverage(reports.coverage_rows(A.catalogue_state(spark, d), A.products(spark, d)))


@_(f"WITH {COVERAGE} SELECT * FROM cov WHERE store_count <= 30 ORDER BY store_count, brand, family, id LIMIT 500")
def coverage_detail(spark, d):
    return reports.coverage_detail(reports.coverage_rows(A.catalogue_state(spark, d), A.products(spark, d)), 500, 30)


_HEALTH = STORES + ", " + HISTORY + f""", h AS (SELECT s.store_id, store_name, last_day, coalesce(date_diff('day', last_day, {AS_OF}) < 1, false) AS ok
  FROM stores s LEFT JOIN (SELECT store_id, max(day) AS last_day FROM history GROUP BY 1) x ON x.store_id = s.store_id WHERE enabled)"""


@_(f"WITH {_HEALTH} SELECT * FROM h")
def health_status(spark, d):
    return reports.health(A.stores(spark, d), A.history(spark, d), A.as_of(spark, d))


@_(f"WITH {_HEALTH} SELECT max(last_day) AS last_update, coalesce(bool_and(ok), true) AS all_ok, count(*) AS stores FROM h")
def health_overall(spark, d):
    return reports.overall_health(reports.health(A.stores(spark, d), A.history(spark, d), A.as_of(spark, d)))


@_(f"""WITH {STATE}, {_MAPPINGS} SELECT (SELECT count(*) FROM part) AS total_products, (SELECT count(*) FROM state WHERE last_seen < {AS_OF} - 30) AS discontinued,
  (SELECT count(*) FROM old WHERE status = 'pending') AS pending_mappings,
  (SELECT count(*) FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS) AS recent_errors""")
def admin_stats(spark, d):
    swept = state.discontinue(A.catalogue_state(spark, d), A.as_of(spark, d))
    pairs = table(spark, d, "lineitem").filter("l_partkey % 2 = 0").select("l_suppkey", "l_partkey").distinct()
    pending = pairs.select(F.when(F.col("l_partkey") % 3 == 1, "pending").otherwise("other").alias("status"))
    now = F.lit(A.events(spark, d).agg(F.max("ts")).first()[0])
    return reports.admin_stats(A.products(spark, d), swept, A.scraper_errors(spark, d), pending, now)


@_(f"WITH {TRENDS} SELECT * FROM trends")
def trend_mean(spark, d):
    return A.trends(spark, d)


@_(f"WITH {PRODUCTS}, {TRENDS} SELECT id, family, coalesce(score, 0) AS score FROM products LEFT JOIN trends ON product_id = id ORDER BY score DESC, id LIMIT 8")
def featured_trend(spark, d):
    return reports.featured_by_trend(A.products(spark, d), A.trends(spark, d))


@_(f"""WITH {PRODUCTS}, {FLAGGED}, c AS (SELECT product_id, count(*) AS n FROM flagged WHERE NOT suspicious AND NOT overpriced GROUP BY 1)
SELECT id, family, coalesce(n, 0) AS store_count FROM products LEFT JOIN c ON product_id = id ORDER BY store_count DESC, id LIMIT 50""")
def trend_candidates(spark, d):
    good = _flagged(spark, d).filter(pricing.PREDICATES["v4"]()).groupBy("product_id").agg(F.count(F.lit(1)).alias("store_count"))
    return reports.trend_candidates(A.products(spark, d), good)


@_(f"""WITH {SUMMARY}, pool AS (SELECT id, family, in_stock, store_count, row_number() OVER (ORDER BY in_stock DESC, store_count DESC, id) - 1 AS place FROM summary)
SELECT id, family, in_stock, store_count, place FROM pool, (SELECT dayofyear({AS_OF}) % 3 * 8 AS f) WHERE place >= f AND place < f + 8""")
def featured_rotation(spark, d):
    return reports.featured_rotation(A.products(spark, d), pricing.offer_rollup(A.offers(spark, d)), A.as_of(spark, d))


@_("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 10),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id) - back + 1 AS w FROM e) SELECT user_id, round(sum(w * value) / sum(w), 4) AS estimate, count(*) AS samples FROM w GROUP BY user_id""")
def run_time_estimate(spark, d):
    rows = A.events(spark, d).select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    return reports.weighted_run_time(rows, "user_id").withColumn("estimate", F.round("estimate", 4))


# --- keys, classes and sources ----------------------------------------------

KEYED = PRODUCTS + r""", keyed AS (
  SELECT *, lower(brand) || '::' || trim(regexp_replace(regexp_replace(regexp_replace(lower(
    regexp_replace(regexp_replace(family, '\b(hot|cold)\b', '', 'gi'), '\b(red|blue)\b', '', 'gi')), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS fusion_key,
    lower(brand) || '::model::' || model_number AS model_key FROM products)"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = A.products(spark, d)
    return rows.withColumns({"fusion_key": fusion.fusion_key(F.col("family"), F.col("brand"), F.col("category"), ("hot", "cold"), ("red", "blue")), "model_key": fusion.model_key(F.col("brand"), F.col("model_number"))})


@_(f"WITH {KEYED} SELECT id, fusion_key FROM keyed")
def fusion_key(spark, d):
    return _keyed(spark, d).select("id", "fusion_key")


@_(f"WITH {KEYED} SELECT id, model_key FROM keyed")
def model_key(spark, d):
    return _keyed(spark, d).select("id", "model_key")


@_(f"WITH {KEYED} SELECT fusion_key, count(*) AS members, min(id) AS first_id FROM keyed GROUP BY 1")
def fusion_groups(spark, d):
    return _keyed(spark, d).groupBy("fusion_key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"))


@_(f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY fusion_key ORDER BY length(family), id) AS n FROM keyed)
SELECT fusion_key, min(id) FILTER (WHERE n = 1) AS kept, count(*) AS members FROM r GROUP BY fusion_key""")
def survivor_merge(spark, d):
    rows = _keyed(spark, d).withColumns({"image_url": F.lit(""), "enriched_at": F.lit(None).cast("timestamp"), "specs": F.create_map().cast("map<string,string>"), "has_variant": F.lit(False)})
    return fusion.survivors(rows, "fusion_key").select("fusion_key", "kept", "members")


@_(f"WITH {KEYED}, g AS (SELECT count(*) AS n FROM keyed GROUP BY fusion_key) SELECT sum(n)::BIGINT AS before, count(*) AS after, (sum(n) - count(*))::BIGINT AS eliminated, count(*) FILTER (WHERE n > 1) AS groups_fused FROM g")
def fusion_counters(spark, d):
    return fusion.fusion_counters(_keyed(spark, d), "fusion_key")


@_(f"""WITH RECURSIVE {KEYED}, k AS (SELECT id, fusion_key AS k FROM keyed UNION ALL SELECT id, model_key FROM keyed),
m AS (SELECT k, min(id) AS low FROM k GROUP BY k), reach AS (
  SELECT id, id AS r FROM keyed UNION SELECT reach.id, m.low FROM reach JOIN k ON k.id = reach.r JOIN m ON m.k = k.k),
e AS (SELECT DISTINCT a.low AS a, b.low AS b FROM k x JOIN m a ON a.k = x.k JOIN k y ON y.id = x.id JOIN m b ON b.k = y.k),
c AS (SELECT a AS n, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.n)
SELECT id, min(c.r) AS class FROM k JOIN m USING (k) JOIN c ON c.n = m.low GROUP BY id""")
def duplicate_classes(spark, d):
    return fusion.classes(_keyed(spark, d), ["fusion_key", "model_key"])


@_("SELECT a.p_partkey AS id, b.p_partkey AS sibling FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey")
def siblings(spark, d):
    a = A.products(spark, d).select("id", "family", "brand")
    return spread(a, "id").join(a.withColumnRenamed("id", "sibling"), ["family", "brand"]).filter("id <> sibling").select("id", "sibling")


@_("SELECT p_partkey AS id, p_name AS family FROM part WHERE p_name = 'red bolt'")
def id_lookup_decoded(spark, d):
    return A.products(spark, d).filter(T.url_decoded(F.replace("family", F.lit(" "), F.lit("%20"))) == "red bolt").select("id", "family")


@_("""SELECT p_partkey AS id, p_name AS family, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS source_pos FROM part WHERE p_brand <> 'Brand#9'""")
def source_union_dedup(spark, d):
    rows = A.products(spark, d).select("id", "family", F.when(F.col("brand") == "Brand#9", "Unknown").otherwise(F.col("brand")).alias("brand"))
    return fusion.union_sources([rows.filter("id % 2 = 0"), rows]).select("id", "family", "source_pos")


@_("""SELECT url FROM (SELECT '/' AS url UNION ALL SELECT '/kategori/' || lower(p_type) FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT '/produkt/' || p_partkey FROM part)""")
def sitemap_union(spark, d):
    rows = A.products(spark, d)
    fixed = spark.range(1).select(F.lit("/").alias("url"))
    kinds = rows.select(F.concat(F.lit("/kategori/"), F.lower("category")).alias("url")).distinct()
    return fixed.unionByName(kinds).unionByName(rows.select(F.concat(F.lit("/produkt/"), F.col("id")).alias("url")))


# --- matching ---------------------------------------------------------------

# Names with numbers and sizes, made the same way on both sides.
NAMES = """names AS (SELECT p_partkey AS id, p_name || ' ' || (p_size % 7) || CASE WHEN p_size % 3 = 0 THEN ' Pro' WHEN p_size % 5 = 0 THEN ' Ultra' ELSE '' END
  || CASE WHEN p_size % 2 = 0 THEN ' ' || 64 * (1 + p_size % 4) || 'gb' ELSE '' END AS name, p_brand AS brand FROM part)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    tail = F.when(size % 3 == 0, " Pro").when(size % 5 == 0, " Ultra").otherwise("")
    gb = F.when(size % 2 == 0, F.concat(F.lit(" "), 64 * (1 + size % 4), F.lit("gb"))).otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), size % 7, tail, gb).alias("name"), F.col("p_brand").alias("brand"))


@_(f"WITH {NAMES} SELECT id, name, regexp_extract(name, ' (\\d)( |$)', 1) AS numbers FROM names")
def generation_numbers(spark, d):
    return _names(spark, d).select("id", "name", F.concat_ws(",", T.generation_numbers(F.col("name"))).alias("numbers"))


@_(f"WITH {NAMES} SELECT id, nullif(upper(regexp_extract(name, '(\\d+gb)', 1)), '') AS storage FROM names")
def storage_size(spark, d):
    return _names(spark, d).select("id", T.storage_size(F.col("name")).alias("storage"))


@_(f"WITH {NAMES} SELECT id, CASE WHEN contains(name, ' Pro') THEN 'pro' WHEN contains(name, ' Ultra') THEN 'ultra' END AS tier FROM names")
def tier(spark, d):
    return _names(spark, d).select("id", T.tier(F.col("name")).alias("tier"))


@_(f"WITH {NAMES} SELECT id, CASE WHEN regexp_matches(name, '\\bred\\b') THEN 'red' WHEN regexp_matches(name, '\\bblue\\b') THEN 'blue' END AS colour FROM names")
def colour_token(spark, d):
    return _names(spark, d).select("id", T.colour(F.col("name"), LEXICON.colours).alias("colour"))


MATCH = NAMES + """, q AS (SELECT min(id) AS query_id, brand, name AS query FROM names GROUP BY brand, name), c AS (SELECT min(id) AS candidate_id, brand, name FROM names GROUP BY brand, name),
p AS (SELECT query_id, candidate_id, list_filter(string_split(lower(query), ' '), lambda w: length(w) > 1) AS qw, list_filter(string_split(lower(name), ' '), lambda w: length(w) > 1) AS nw, lower(query) AS ql, lower(name) AS nl
  FROM q JOIN c USING (brand)),
s AS (SELECT query_id, candidate_id, qw, nw, ql, nl, len(list_filter(qw, lambda w: contains(nl, w))) AS hits,
  len(list_filter(nw, lambda w: len(list_filter(qw, lambda x: contains(x, w) OR contains(w, x))) = 0)) AS extra FROM p),
t AS (SELECT query_id, candidate_id, hits * (hits / (hits + extra * 0.4::DOUBLE)) * CASE WHEN regexp_extract(ql, '\\b(red|blue)\\b', 1) <> '' AND regexp_extract(ql, '\\b(red|blue)\\b', 1) = regexp_extract(nl, '\\b(red|blue)\\b', 1) THEN 1.5::DOUBLE ELSE 1 END AS score FROM s
  WHERE regexp_extract(ql, ' (\\d)( |$)', 1) = regexp_extract(nl, ' (\\d)( |$)', 1) AND regexp_extract(ql, ' (pro|ultra)', 1) = regexp_extract(nl, ' (pro|ultra)', 1)
    AND (regexp_extract(ql, '(\\d+gb)', 1) = '' OR regexp_extract(nl, '(\\d+gb)', 1) = '' OR regexp_extract(ql, '(\\d+gb)', 1) = regexp_extract(nl, '(\\d+gb)', 1))
    AND (regexp_extract(ql, '\\b(red|blue)\\b', 1) = '' OR regexp_extract(nl, '\\b(red|blue)\\b', 1) = '' OR regexp_extract(ql, '\\b(red|blue)\\b', 1) = regexp_extract(nl, '\\b(red|blue)\\b', 1))
    AND hits / len(qw) >= 0.6)"""


def _match_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = _names(spark, d)
    queries = names.groupBy("brand", F.col("name").alias("query")).agg(F.min("id").alias("query_id"))
    return queries, names.groupBy("brand", "name").agg(F.min("id").alias("candidate_id"))


@_(f"WITH {MATCH} SELECT query_id, candidate_id, round(score, 6) AS score FROM t WHERE score > 0")
def match_score(spark, d):
    return matching.scored_pairs(*_match_sides(spark, d), "brand", LEXICON).select("query_id", "candidate_id", F.round("score", 6).alias("score"))


@_(f"WITH {MATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS n FROM t WHERE score > 0) SELECT query_id, candidate_id, round(score, 6) AS score FROM r WHERE n = 1")
def match_best(spark, d):
    queries, candidates = _match_sides(spark, d)
    return matching.best_matches(queries, candidates, "brand", LEXICON).withColumn("score", F.round("score", 6))


# --- extraction -------------------------------------------------------------


@_("SELECT page_id, url FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1)) AS url FROM pages)")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(extract.links(F.col("html"))).alias("url"))


@_("SELECT page_id, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS item FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1)) AS item FROM pages)")
def html_lists(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(extract.list_items(F.col("html"))).alias("item"))


_TEXT_SQL = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("quot", '"'), ("apos", "''"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _TEXT_SQL = f"replace({_TEXT_SQL}, '&{_name};', '{_char}')"


@_(f"SELECT page_id, trim(regexp_replace({_TEXT_SQL}, '[\\s\\x{{A0}}]+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", extract.plain(F.col("html")).alias("text"))


@_("SELECT page_id, replace(replace(replace(replace(replace(replace(url, '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS url FROM pages")
def entity_decode(spark, d):
    return table(spark, d, "pages").select("page_id", T.decoded_entities(F.col("url")).alias("url"))


# --- discovery and queries for stores -----------------------------------------

_CAT_RULES = (("hot", "tv", "TV"), ("red|blue", "telefona", "Smartphone"), ("bolt", "kompjutere", "Laptop"))
_RULES = tuple((c, s, w) for w, c, s in _CAT_RULES)
_CAT_SQL = "CASE WHEN regexp_matches(p_name, '\\bhot\\b') THEN 'tv' WHEN regexp_matches(p_name, '\\b(red|blue)\\b') THEN 'telefona' WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 'kompjutere' ELSE 'tjera' END"


@_(f"SELECT {_CAT_SQL} AS new_category, count(*) AS n, count(*) FILTER (WHERE {_CAT_SQL} <> p_type) AS changed FROM part GROUP BY 1")
def recategorise_distribution(spark, d):
    return discovery.recategorised(A.products(spark, d), _RULES)


@_(f"""WITH c AS (SELECT p_partkey AS id, p_name AS family, {_CAT_SQL} AS category FROM part)
SELECT id, family, CASE category WHEN 'telefona' THEN 0 WHEN 'kompjutere' THEN 1 ELSE 4 END AS rank FROM c ORDER BY rank, id LIMIT 50""")
def image_backlog(spark, d):
    rows = A.products(spark, d).withColumn("c", discovery.category(F.col("family"), _RULES))
    rows = rows.select("id", "family", "c.category", "c.subcategory", F.lit("").alias("image_url"))
    return discovery.image_backlog(rows).select("id", "family", "rank")


@_("""WITH l AS (SELECT user_id, event_type, max(ts) AS m FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type DESC) AS n FROM l)
SELECT user_id AS "user", string_agg(event_type, ',' ORDER BY n) AS searches FROM r WHERE n <= 5 GROUP BY user_id""")
def recent_searches(spark, d):
    rows = A.events(spark, d).select(F.col("user_id").alias("user"), F.col("event_type").alias("q"), F.col("ts").alias("at"))
    return discovery.recent_searches(rows).select("user", F.concat_ws(",", "searches").alias("searches"))


@_(f"WITH {NAMES} SELECT id, trim(regexp_replace(regexp_replace(name, '\\d+gb', '', 'g'), '\\s+', ' ', 'g')) AS query FROM names")
def query_clean(spark, d):
    return _names(spark, d).select("id", querying.clean_query(F.col("name")).alias("query"))


@_(f"WITH {NAMES} SELECT id, CASE WHEN regexp_matches(name, '\\bred\\b') THEN 100 WHEN regexp_matches(name, '\\bblue\\b') THEN 0 ELSE -1 END AS confidence FROM names")
def colour_confidence(spark, d):
    return _names(spark, d).select("id", querying.colour_confidence(F.lit("red"), F.col("name"), LEXICON.colours).alias("confidence"))


@_(f"WITH {NAMES} SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS handle FROM names")
def url_handle(spark, d):
    return _names(spark, d).select("id", querying.handle(F.col("name")).alias("handle"))


@_("SELECT page_id, CASE WHEN html ILIKE '%schema.org/instock%' THEN true WHEN html ILIKE '%schema.org/outofstock%' THEN false WHEN regexp_matches(lower(html), 'delivery-not-available|sold-out') THEN false WHEN regexp_matches(lower(html), 'delivery-available|add-to-cart') THEN true END AS in_stock FROM pages")
def html_stock(spark, d):
    return table(spark, d, "pages").select("page_id", extract.stock_from_html(F.col("html")).alias("in_stock"))


@_("""SELECT user_id AS id, section, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS items FROM (
  SELECT user_id, event_type, count(*) AS n, CASE WHEN event_type IN ('view', 'click') THEN 'Visit' ELSE 'Tjera' END AS section FROM events GROUP BY ALL) GROUP BY ALL""")
def spec_sections(spark, d):
    counts = A.events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("Visit: "), F.col("event_type"))).otherwise(F.col("event_type"))
    specs = counts.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_type", key.alias("k"), F.col("n").cast("string").alias("v")))).alias("s"))
    specs = specs.select("id", F.transform("s", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))).alias("specs"))
    return extract.spec_sections(specs).select("id", "section", F.array_join(F.transform("items", lambda x: F.concat(x["k"], F.lit("="), x["v"])), ",").alias("items"))


# --- enrichment ---------------------------------------------------------------


@_(f"""WITH {NAMES} SELECT id, nullif(upper(regexp_extract(name, '(\\d+gb)', 1)), '') AS storage,
  CASE WHEN regexp_matches(name, '\\bred\\b') THEN 'red' WHEN regexp_matches(name, '\\bblue\\b') THEN 'blue' END AS colour FROM names""")
def specs_from_name(spark, d):
    specs = enrichment.specs_from_name(F.col("name"), LEXICON.colours)
    return _names(spark, d).select("id", F.try_element_at(specs, F.lit("Storage")).alias("storage"), F.try_element_at(specs, F.lit("Colour")).alias("colour"))


@_(f"WITH {NAMES} SELECT id, trim(regexp_replace(regexp_replace(name, '\\d+gb', '', 'g'), '\\s+', ' ', 'g')) AS lookup FROM names")
def lookup_name(spark, d):
    return _names(spark, d).select("id", enrichment.lookup_name(F.concat("name", F.lit(", 5G"))).alias("lookup"))


@_("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 >= 2 THEN c_custkey::INT END AS threshold FROM customer""")
def alert_inputs(spark, d):
    key = F.col("c_custkey")
    email = F.concat(F.lit("c"), key, F.when(key % 3 == 0, " at shop.al").otherwise("@shop.al"))
    wish = F.when(key % 4 == 0, "0").when(key % 4 == 1, "-7.5").otherwise(F.concat(key, F.lit(".9 EUR")))
    return table(spark, d, "customer").select(key.alias("id"), enrichment.alert_threshold(key.cast("string"), email, wish).alias("threshold"))


@_("""SELECT DISTINCT l_quantity AS elapsed, round(95.0::DOUBLE * (1 - exp(-l_quantity / 24.0::DOUBLE)), 6) AS percent, greatest(0, 40 - l_quantity)::BIGINT AS remaining FROM lineitem""")
def progress_estimate(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("elapsed")).distinct()
    return rows.select("elapsed", F.round(enrichment.progress(F.col("elapsed"), F.lit(40.0)), 6).alias("percent"), enrichment.remaining(F.col("elapsed"), F.lit(40.0)).alias("remaining"))


@_("""SELECT DISTINCT p_size AS seconds, CASE WHEN p_size * 7 >= 60 THEN (p_size * 7) // 60 || 'm ' || (p_size * 7) % 60 || 's' ELSE p_size * 7 || 's' END AS duration FROM part""")
def duration_text(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("seconds")).distinct().select("seconds", enrichment.duration(F.col("seconds") * 7).alias("duration"))


@_("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark, d):
    return enrichment.page_details(table(spark, d, "pages")).select("page_id", "title")
