"""The gram index against a scan of all products for each query."""

import random

from pyspark.sql import functions as F

from marketlens.operators import search, searchindex

SCHEMA = "id long, family string, brand string, model_number string, search_terms array<string>"


def made(spark, n=300, seed=2):
    rnd = random.Random(seed)
    words = ["red", "Bolt", "GEAR", "ünder", "x1", "pro max", "ß", "a"] + ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(200)]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))
    rows = [(i, name(), rnd.choice(["Acme", "b", "Red Co"]), rnd.choice([None, "", "X1-200"]), [name(), name()]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), words


def test_index_equals_scan(spark, tmp_path):
    products, words = made(spark)
    queries = [" Red  bolt", "re", "x", "ed Co", "zzz", "ünd a", "bolt bolt", "pro max", "x1-2 gear", "", None, "  ", words[20], words[30][1:4], f"{words[40]} a", "\tgear"]
    index = searchindex.build(products, str(tmp_path / "i"))
    batch = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = sorted((r.query_id, r.id, round(r.score, 6)) for r in searchindex.search(index, batch).collect())
    expected = sorted((i, r.id, round(r.score, 6)) for i, q in enumerate(queries) if q is not None for r in search.search(products, q).collect())
    assert got == expected and len({r[0] for r in got}) >= 9
    best = {(r.query_id, r.place): r.id for r in searchindex.suggestions(index, batch, 2).collect()}
    top = search.search(products, "pro max").orderBy(F.desc("score"), "id").limit(2).collect()
    assert [best[(7, 1)], best[(7, 2)]] == [r.id for r in top]


def test_a_batch_reads_few_postings(spark, tmp_path):
    products, words = made(spark, 2000)
    index = searchindex.build(products, str(tmp_path / "i"))
    batch = searchindex.asked(spark.createDataFrame([(0, words[25]), (1, f"a {words[50]}")], "query_id int, query string"))
    found = searchindex.candidates(index, batch)
    assert 0 < found.count() < 400  # of 4,000 pairs
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_an_empty_index(spark, tmp_path):
    products, _ = made(spark, 5)
    index = searchindex.build(products.limit(0), str(tmp_path / "i"))
    assert searchindex.search(index, spark.createDataFrame([(0, "red")], "query_id int, query string")).collect() == []
