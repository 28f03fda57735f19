"""Every registered query against its SQL on the smallest tables, and rules the tables do not reach."""

import math
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.lexicon import Words
from marketlens.operators import extract, fusion, matching, pricing, search, state
from marketlens.plans.mechanisms import REGISTRY

SF = "/root/testdata/sf0.001"
WORDS = Words((("black", "black"), ("white", "white")), ("case",), ("bundle",), ("core",))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query_equals_its_sql(spark, duck, name):
    df = REGISTRY.queries[name](spark, SF)
    rows = df.collect()
    if name not in REGISTRY.oracles:
        assert rows
        return
    cursor = duck.execute(REGISTRY.oracles[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([normal(dict(zip(names, r))[c]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(repr([normal(r[c]) for c in sorted(names)]) for r in rows) == expected


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("name,numbers", [("iPhone 17 256GB", ["17"]), ("Galaxy S24 Ultra", []), ('TV 65" QLED 4', ["4"]), ("Dell Core i7 14", ["14"]), ("iPad 10.9 8", ["8"])])
def test_generation_numbers(spark, name, numbers):
    assert one(spark, T.generation_numbers(F.col("n"), processors=("core",)), n=name) == numbers


def test_glued_numbers(spark):
    assert one(spark, T.generation_numbers(F.col("n"), glued=True), n="Galaxy S24") == ["24"]


@pytest.mark.parametrize("name,tier", [("iPhone 17 Pro Max", "pro max"), ("iPhone 17 Pro", "pro"), ("Laptop Core Ultra 7", None), ("Laptop Core Ultra 7 Air", "air"), ("Product", None)])
def test_tier(spark, name, tier):
    assert one(spark, T.tier(F.col("n"), ("core",)), n=name) == tier


def test_boundaries_are_ascii(spark):
    key = lambda f: one(spark, fusion.fusion_key(F.col("f"), F.lit("B"), F.lit("x"), colours=("i bardh[eë]",)), f=f)
    assert key("Foo i bardhe") == "b::foo"  # the plain form is a colour word
    assert key("Foo i bardhë ") == "b::foo i bardh"  # no boundary follows an accented letter


def test_fusion_key(spark):
    key = lambda f, c="telefona": one(spark, fusion.fusion_key(F.col("f"), F.lit(" Apple® "), F.lit(c), ("celular",), ("black",)), f=f)
    assert key("Celular iPhone 17 8+256GB Black") == key("iPhone 17 128GB e-SIM".replace("e-SIM", "eSIM")) == "apple::iphone 17"
    assert key("SSD 512GB", "disk") == "apple::ssd 512gb"
    assert key("Nintendo Switch 2 + Mario Kart", "lojra") == "apple::nintendo switch 2"
    assert key("Tastiere + Mouse", "it") == "apple::tastiere mouse"


def test_classes_are_transitive(spark):
    rows = spark.createDataFrame([(1, "k1", None), (2, "k1", "m1"), (3, "k2", "m1"), (4, "k3", None)], "id long, fusion_key string, model_key string")
    assert {r.id: r["class"] for r in fusion.classes(rows, ["fusion_key", "model_key"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_survivor_prefers_image_then_short_name(spark):
    rows = spark.createDataFrame(
        [(1, "g", "long name here", "", None, {}, False, ["a"]), (2, "g", "n", "http://x", None, {}, False, ["b", "a"]), (3, "h", "z", None, datetime(2024, 1, 1), {"k": "v"}, True, ["c"])],
        "id long, g string, family string, image_url string, enriched_at timestamp, specs map<string,string>, has_variant boolean, search_terms array<string>",
    )
    out = {r.g: (r.kept, r.members, r.terms) for r in fusion.survivors(rows, "g").collect()}
    assert out == {"g": (2, 2, ["a", "b"]), "h": (3, 1, ["c"])}


@pytest.mark.parametrize(
    "query,name,ok",
    [
        ("Apple iPhone 17", "Apple iPhone 17 256GB", True), ("Apple iPhone 17", "Apple iPhone 15", False), ("Apple iPhone 17", "Apple iPhone 17 Pro", False),
        ("Apple iPhone 17 256GB", "Apple iPhone 17 1TB", False), ("Apple iPhone 17 black", "Apple iPhone 17 white", False), ("Apple iPhone 17", "Case Apple iPhone 17", False),
        ("case iPhone 17", "Apple iPhone 17", False), ("Nintendo Switch 2", "Nintendo Switch 2 bundle", False), ("Samsung galaxy tab fold", "Samsung tv", False),
    ],
)
def test_strict_score(spark, query, name, ok):
    assert (one(spark, matching.strict_score(F.col("q"), F.col("n"), WORDS), q=query, n=name) > 0) == ok


def test_colour_bonus(spark):
    score = lambda q, n: one(spark, matching.strict_score(F.col("q"), F.col("n"), WORDS), q=q, n=n)
    assert score("iPhone 17 black", "iPhone 17 black") == pytest.approx(1.5 * 3)


def test_bad_matches_lose_their_price(spark):
    rows = [(10.0, True, "Apple iPhone 15", None, ["iPhone 17"], None), (11.0, True, None, "https://s/p/iphone-17.html", ["iPhone 17", "http://x 99"], None), (12.0, True, None, "https://s/p/123", ["iPhone 17"], None)]
    df = spark.createDataFrame(rows, "price double, in_stock boolean, matched_name string, product_url string, search_terms array<string>, error string")
    assert [(r.price, r.in_stock, r.error) for r in matching.nullify_bad_matches(df).collect()] == [(None, None, "not_found"), (11.0, True, None), (12.0, True, None)]


def test_outliers_need_three_prices(spark):
    rows = [(1, s, p) for s, p in enumerate([100.0, 100.0, 10.0, None, 0.0])] + [(2, 0, 1.0), (2, 1, 100.0)] + [(3, 0, 100.0), (3, 1, 100.0), (3, 2, 400.0)]
    out = {(r.product_id, r.store_id): (r.suspicious, r.overpriced) for r in pricing.flag_outliers(spark.createDataFrame(rows, "product_id long, store_id long, price double")).collect()}
    assert out[(1, 2)] == (True, False) and out[(3, 2)] == (False, True) and not any(out[(2, 1)]) and not any(out[(1, 3)])


def test_summary_without_prices_has_no_row(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (2, 0, 5.0, True)], "product_id long, store_id long, price double, suspicious boolean")
    assert pricing.price_summary(rows).collect() == []


def test_search_needs_every_word_in_one_field(spark):
    rows = spark.createDataFrame([(1, "red bolt", "Acme", "x1", ["t"]), (2, "red", "bolt", "x2", ["t"]), (3, "redb", "olt", None, ["t"])], "id long, family string, brand string, model_number string, search_terms array<string>")
    assert sorted(r.id for r in search.search(rows, "red bolt").collect()) == [1, 2]
    assert search.search(rows, "  ").count() == 0


def test_mapping_guard(spark):
    old = spark.createDataFrame([(1, 1, 5, 50, "approved"), (1, 2, 5, 50, "pending")], "store_id long, store_product_id long, product_id long, confidence int, status string")
    new = spark.createDataFrame([(1, 1, 9, 70.0, 0), (1, 2, 9, 120.0, 0), (1, 2, 8, 33.5, 1), (2, 1, 7, -4.0, 0)], "store_id long, store_product_id long, product_id long, confidence double, ord int")
    out = {(r.store_id, r.store_product_id): (r.product_id, r.confidence, r.status) for r in state.merge_mappings(old, new).collect()}
    assert out == {(1, 1): (5, 50, "approved"), (1, 2): (8, 34, "pending"), (2, 1): (7, 0, "pending")}


def test_never_seen_products_are_discontinued(spark):
    rows = spark.createDataFrame([(1, None, "discovered"), (2, date(2024, 1, 1), "discovered"), (3, date(2024, 2, 10), "discontinued")], "product_id long, last_seen date, status string")
    assert [r.status for r in state.discontinue(rows, F.lit(date(2024, 1, 20))).orderBy("product_id").collect()] == ["discontinued", "discovered", "discontinued"]


def test_text_helpers(spark):
    assert one(spark, T.numeric_prefix(F.col("t")), t=" 12.5 EUR") == 12.5
    assert one(spark, T.url_decoded(F.col("t")), t="a+b%20c") == "a+b c"
    assert one(spark, T.url_decoded(F.col("t")), t="50%zz") == "50%zz"
    assert one(spark, T.decoded_entities(F.col("t")), t="A&#8243; &lt;b&gt; &amp;amp; &#x;") == "A″ <b> &amp; &#x;"
    assert one(spark, T.slug(F.col("t")), t="Hello, Wörld 2!") == "hello-w-rld-2"
    assert one(spark, T.strip_diacritics(F.col("t")), t="mbështjellës") == "mbeshtjelles"
    assert one(spark, T.round_half_up(F.lit(-2.5))) == -2


def test_json_ld(spark):
    page = lambda body: f'<script type="application/ld+json">{body}</script>'
    rows = [
        (1, page('{"@type":"Product","name":"A","offers":{"price":"12.50 EUR","availability":"https://schema.org/InStock"}}')),
        (2, page("not json") + page('[{"@type":"Thing"},{"@type":"Product","name":"B","offers":[{"price":7,"availability":"OutOfStock"}]}]')),
        (3, page('{"@graph":[{"@type":"Product","name":"C","offers":{"lowPrice":3}}]}')), (4, page('{"@type":"Product","name":"D"}')),
    ]
    out = {r.page_id: (r.name, r.price, r.in_stock) for r in extract.json_ld_offers(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert out == {1: ("A", 12.5, True), 2: ("B", 7.0, False), 3: ("C", 3.0, None)}


def test_spec_sections(spark):
    df = spark.createDataFrame([(1, [("Display: Size", "6.1"), ("Weight", "1kg"), ("Display: Type", "OLED")])], "id long, specs array<struct<k:string,v:string>>")
    out = {r.section: [(i.k, i.v) for i in r["items"]] for r in extract.spec_sections(df).collect()}
    assert out == {"Display": [("Size", "6.1"), ("Type", "OLED")], "Tjera": [("Weight", "1kg")]}


def test_best_store_takes_text_ids_and_the_last_of_equals(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (1, "c", 6.0), (2, "a", None)], "product_id long, store_id string, price double").withColumns({"suspicious": F.lit(False), "overpriced": F.lit(False)})
    assert [(r.product_id, r.best_price, r.best_store) for r in pricing.best_store(rows).collect()] == [(1, 5.0, "b")]


def test_listing_names_stores_cheapest_first(spark):
    products = spark.createDataFrame([(1, "n", "b", "c", "s"), (2, "m", "b", "c", "s")], "id long, family string, brand string, category string, subcategory string")
    offers = spark.createDataFrame([(1, "x", 5.0, True), (1, "y", 4.0, None), (1, "z", None, True)], "product_id long, store_id string, price double, in_stock boolean")
    known = spark.createDataFrame([], "product_id long, lowest_price double, store_count long, status string")
    seen = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 1))], "product_id long, refreshed_at timestamp")
    out = {r.id: (r.best_price, r.store_count, r.store_ids, r.refreshed_at) for r in pricing.offer_listing(products, offers, known, seen).collect()}
    assert out == {1: (4.0, 2, ["y", "x"], datetime(2024, 1, 2)), 2: (None, 0, [], None)}
