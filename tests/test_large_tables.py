"""Steps that once ran in one task, were computed again or were shuffled as a whole: their plans and, on odd rows, their results."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from marketlens.functions import lexicon
from marketlens.functions import text as T
from marketlens.functions.rows import spread
from marketlens.operators import dictionary, history, matching, offers, pages, pricequery, pricing, querying, searchindex
from marketlens.plans import market, mechanisms
from marketlens.plans.catalogue import REGISTRY

D = "/root/testdata/sf0.001"


def plan(rows, capsys):
    capsys.readouterr()
    rows.explain("extended")
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]


def test_bodies_of_a_small_table_are_parsed_in_many_tasks(spark):
    assert market._parts(spark, D).rdd.getNumPartitions() >= 8
    assert market._payloads(spark, D, "shopify").rdd.getNumPartitions() >= 8


def test_cards_and_scores_are_computed_once(spark, capsys):
    rows = spark.createDataFrame([(1, 1, ["a b"], "a b", 0, "<p>")], "product_id long, store_id long, search_terms array<string>, query string, query_ord int, body string")
    said = plan(offers.choose(offers.shopware(rows), sanity=True), capsys).split("== Physical Plan ==")[0]
    assert said.count("regexp_extract_all(body") == 1


def test_doubtful_prices_among_the_hits_of_a_query(spark):
    rows = [(1, 1, ["a b"], "a b", 0, i, "a b c"[: 3 if p == 5.0 else 5], p) for i, p in enumerate([5.0, 100.0, None, -1.0])] + [(2, 1, ["a b"], "a b", None, 0, "a b", 5.0)]
    found = spark.createDataFrame(rows, "product_id long, store_id long, search_terms array<string>, query string, query_ord int, pos int, name string, price double").selectExpr("*", "true AS in_stock", "'u' AS url", "'n' AS native_id", "string(null) AS error")
    found = found.replace({"a b": "ab cd", "a b c": "ab cd ef"}, subset=["query", "name"])
    assert {r.product_id: r.price for r in offers.choose(found, strict_colour=None, sanity=True).collect()} == {1: 100.0, 2: 5.0}


def test_device_pages_are_parsed_once(spark, capsys):
    rows = pages.device_pages(spark.createDataFrame([(1, "<p>", None)], "page_id long, html string, brand string"), ("Display",))
    said = plan(rows, capsys).split("== Physical Plan ==")[0]
    assert said.count("nfo[^") == 1 and said.count("specs-phone-name-title") == 1


def grid(spark):
    products = spark.createDataFrame([(1,), (2,), (None,)], "product_id long")
    stores = spark.createDataFrame([(1, True), (1, True), (2, True), (3, False), (None, True)], "store_id long, enabled boolean")
    rows = spark.createDataFrame([(1, 1, 5.0, True), (1, 3, 6.0, True), (9, 1, 7.0, True), (2, 2, None, None)], "product_id long, store_id long, price double, in_stock boolean")
    return products, stores, rows


def test_grid_of_products_and_stores_is_not_shuffled(spark, capsys):
    products, stores, rows = grid(spark)
    found = pricing.with_missing_stores(products, stores, rows)
    n, x = None, "not_found"
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(1, 1, 5.0, True, n), (1, 2, n, n, x), (1, n, n, n, x), (2, 2, n, n, n), (2, 1, n, n, x), (2, n, n, n, x), (n, 1, n, n, x), (n, 2, n, n, x), (n, n, n, n, x)], key=str)
    above = plan(found, capsys).split("== Physical Plan ==")[1].split("BroadcastNestedLoopJoin")[0].split("Union")[1].rsplit("Generate", 1)
    assert len(above) == 2 and "Exchange" not in above[1]


def test_prices_asked_for_where_stores_gave_nothing(spark):
    _, stores, rows = grid(spark)
    live = rows.selectExpr("string(product_id) AS key", "store_id", "price", "in_stock", "'a' AS matched_name", "'' AS product_url", "string(null) AS error")
    records = live.limit(0).selectExpr("*", "false AS suspicious", "false AS overpriced", "timestamp'2020-01-01' AS refreshed_at")
    requests = spark.createDataFrame([("1", ["a"], False), ("5", ["a"], None)], "key string, search_terms array<string>, force boolean")
    from pyspark.sql import functions as F

    found = pricequery.price_query(requests, records, live, stores, F.lit("2020-01-02").cast("timestamp"))
    assert sorted((r.key, r.store_id or 0, r.price, r.error) for r in found.collect()) == [("1", 0, None, "search_failed"), ("1", 1, 5.0, None), ("1", 2, None, "search_failed"), *[("5", s, None, "search_failed") for s in (0, 1, 2)]]


def test_batches_of_the_refresh_may_be_many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = mechanisms._streamed(spark, D)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = tables.path.removeprefix("file:")
    assert len(glob.glob(os.path.join(path, "offers", "part-*"))) > 8
    assert {r.batch for r in tables.notices().select("batch").distinct().collect()} == {0, 1}


@pytest.mark.parametrize("stores", [[1, 2], [7]])
def test_pivot_adds_up_in_place(spark, capsys, stores):
    rows = spark.createDataFrame([(1, "d", 1, 5.0), (1, "d", 1, 4.0), (1, "d", 2, None), (2, "d", 9, 1.0)], "product_id long, day string, store_id long, price double")
    found = history.pivot_by_store(rows, stores)
    assert "pivotfirst" not in plan(found, capsys).lower()
    expected = {(1, "d", 4.0, None), (2, "d", None, None)} if stores == [1, 2] else {(1, "d", None), (2, "d", None)}
    assert set(map(tuple, found.collect())) == expected


def test_unfolded_texts_are_not_broadcast(spark, capsys, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 0)
    names = spark.createDataFrame([(1, "big Ring x", None), (2, "W1-2 Ring", "Acme"), (3, None, None), (4, "red", None)], "key long, text string, vendor string")
    known, generic = spark.createDataFrame([(1, "w1-2"), (2, "Ring")], "ord long, word string"), spark.createDataFrame([("red",)], "word string")
    found = dictionary.brands(names, known, generic)
    joins = [x for x in plan(found, capsys).split("== Physical Plan ==")[1].splitlines() if "BroadcastHashJoin" in x]
    assert all("LeftAnti" in x for x in joins)
    assert {r.key: r.brand for r in found.collect()} == {1: "Ring", 2: "Acme", 3: "Unknown", 4: "Unknown"}


def test_siblings_are_found_in_many_tasks(spark):
    assert REGISTRY.queries["siblings"](spark, D).rdd.getNumPartitions() >= 8


def parsed_once(spark, capsys, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = plan(rows(), capsys).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return said.count("MapInArrow") == 1 and "ReusedExchange" in said


def test_pages_of_several_rules_are_parsed_once(spark, capsys):
    assert parsed_once(spark, capsys, lambda: mechanisms.tree_specs(spark, D))


def test_stores_of_a_dispatch_are_broadcast_and_not_the_payloads(spark, capsys):
    rows = spark.createDataFrame([(1, s, ["a b"], "a b", 0, "[]") for s in (1, 2, 3)], "product_id long, store_id long, search_terms array<string>, query string, query_ord int, body string")
    stores = spark.createDataFrame([(1, "flat"), (2, "html")], "store_id long, platform string")
    details = spark.createDataFrame([], "store_id long, variation_id long, price double, in_stock boolean, url string")
    found = offers.dispatch(rows, stores, details)
    said = plan(found, capsys).split("== Physical Plan ==")[0]
    assert said.count("rightHint=(strategy=broadcast)") == 6
    assert sorted((r.store_id, r.error) for r in found.collect()) == [(1, "not_found"), (2, "not_found")]


def test_texts_are_cut_once_for_a_score(spark, capsys):
    words = lexicon.Words((("red", "red"),), accessories=("case",), bundles=("kit",))
    pairs = [("thing 7", "Thing 7 red"), ("thing 7 red", "thing 7 red"), ("thing 7", "thing 8"), ("thing 7", "thing 7 case"), ("case thing", "case thing"), ("thing pro  max", "Thing Pro Max"), ("thing pro", "thing pro max"),
             ("thing", "product thing"), ("thing 64gb", "thing 128gb"), ("thing", "thing kit"), (None, "a"), ("ab", None), ("", ""), ("a", "b"), ("a b", "a b")]
    rows = spark.createDataFrame(pairs, "query string, name string").withColumn("score", matching.strict_score(F.col("query"), F.col("name"), words))
    assert plan(rows, capsys).split("== Physical Plan ==")[0].count("split(lower(query") == 1
    got = [round(r.score, 4) for r in rows.collect()]
    assert got == [0.7143, 3.0, 0.0, 0.0, 2.0, 3.0, 0.0, 0.7143, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_tiers_are_looked_for_where_a_text_holds_one(spark):
    texts = ["Thing Pro  Max", "product", "airship", "thing air", "PRO-max", "fe", "safe", None, "", "slim pro plus"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tier(F.col("t")).alias("tier"))
    assert [r.tier for r in rows.collect()] == ["pro max", None, None, "air", "pro", "fe", None, None, None, "pro plus"]


def test_terms_are_cleaned_once(spark, capsys):
    rows = spark.createDataFrame([(["Big thing, more", "AB-123 x", "!exact", "http://x"],), ([],), (None,), ([None, "x"],)], "terms array<string>").select(querying.store_queries(F.col("terms"), ("thing",)).alias("q"))
    assert plan(rows, capsys).split("== Physical Plan ==")[0].count(r"&\w+;") == 1
    assert [r.q for r in rows.collect()] == [["exact", "AB-123 x", "thing", "Big thing"], [], None, []]


def test_texts_without_numeric_entities_are_not_cut(spark, capsys):
    texts = ["a &amp; b", "&#65;&#8364;", "&#0;&#55296;x&#x41;", "&#", "", None, "&amp;#65;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.decoded_entities(F.col("t")).alias("t"))
    assert "&#)" in plan(rows, capsys).split("== Physical Plan ==")[0]
    assert [r.t for r in rows.collect()] == ["a & b", "A€", "&#0;&#55296;x&#x41;", "&#", "", None, "&#65;"]


def test_device_trees_are_parsed_once(spark, capsys):
    assert parsed_once(spark, capsys, lambda: mechanisms.tree_device(spark, D))


def test_cards_of_trees_are_parsed_once(spark, capsys):
    assert parsed_once(spark, capsys, lambda: market.card_source(spark, D))


def test_grams_of_one_file_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    dealt = []
    monkeypatch.setattr(searchindex, "spread", lambda rows, *by: dealt.append(spread(rows, *by)) or dealt[0])
    products = spark.range(3).selectExpr("id", "'Red bolt' AS family", "'B' AS brand", "'1' AS model_number", "array('red bolt') AS search_terms").coalesce(1)
    index = searchindex.build(products, f"file://{tmp_path}/index")
    assert dealt[0].rdd.getNumPartitions() >= 8 and index.postings(spark).filter("gram = 'bol'").count() == 3
