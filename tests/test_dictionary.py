"""Dictionary joins against the ordered rules they stand for."""

import random
import re

from pyspark.sql import functions as F

from marketlens.functions.lexicon import Lexicon, LexiconTables
from marketlens.operators import dictionary as D
from marketlens.operators import discovery

BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def random_texts(n, seed=4):
    rnd = random.Random(seed)
    words = ["tv", "TP-Link", "b&o", "smart", "watch", "Smart watch", "é", "caféx", "3d", "x_y", "hp", "h", "p", "--", "  ", "(", "Ünder", "a.b"]
    return [rnd.choice(["", " ", "-", "é"]) + rnd.choice([" ", "  ", "-", ""]).join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_entries_equal_the_ordered_rule(spark):
    texts = [*random_texts(400), None, "", "word " * 20_000 + "tv"]
    terms = ["smart watch", "TP-link", "B&O", "HP", "tv", "x_y", "3D", "caf", "ünder", "a.b", "tv", None, "", "p"]
    lexicon = spark.createDataFrame(list(enumerate(terms)), "ord long, word string")
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r.ord for r in D.first_entries(rows, lexicon).collect()}
    expected = {}
    for i, text in enumerate(texts):
        for n, term in enumerate(terms):
            if term and text and re.search(BOUND + re.escape(term) + BOUND, text, re.IGNORECASE | re.ASCII):
                expected[i] = n
                break
    assert got == expected and len(expected) > 100
    assert D.first_entries(rows, lexicon.limit(0)).collect() == [] and D.first_entries(rows.limit(0), lexicon).collect() == []


def test_a_hundred_thousand_entries(spark, monkeypatch):
    """The plan has no expression per entry, and beyond the bound no broadcast of the terms."""
    noise = spark.range(100_000).select("id", F.concat(F.lit("maker"), "id").alias("word"))
    brands = noise.union(spark.createDataFrame([(100_000, "Zeta"), (-1, "Acme")], "id long, word string")).withColumnRenamed("id", "ord")
    generic = spark.createDataFrame([("telefon",), ("™laptop",), (None,)], "word string")
    names = [("Telefon Zeta 5", None), ("new maker77 zeta", "Others"), ("acme MAKER99999x maker5", ""), ("PS5 disc", None), ("telefon", None), ("Telefon nova", None), (None, None), ("zeta", "Own")]
    rows = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(names)], "key long, text string, vendor string")
    expected = ["Zeta", "maker77", "Acme", "Sony", "Unknown", "nova", "Unknown", "Own"]
    for most in (200_000, 10):
        monkeypatch.setattr(D, "BROADCAST_TERMS", most)
        out = D.brands(rows, brands, generic)
        assert [r.brand for r in out.orderBy("key").collect()] == expected
        assert "maker77" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sources_by_tables_equal_sources_by_lists(spark):
    words = Lexicon(("Zeta", "TP-Link"), ("telefon", "big"), (("it", "Router", "router|tp-link"), ("tv", "TV", "tv|ekran")))
    tables = LexiconTables(
        spark.createDataFrame([(0, "Zeta"), (1, "TP-Link")], "ord long, word string"), spark.createDataFrame([("telefon",), ("big",)], "word string"),
        spark.createDataFrame([(0, "it", "Router", "router"), (0, "it", "Router", "tp-link"), (1, "tv", "TV", "tv"), (1, "tv", "TV", "ekran")], "ord long, category string, subcategory string, word string"),
    )
    titles = ["Big tp-link router", "Telefon ZETA tv", "Ekran", "Ekran", "big telefon", "XBOX one", "tv-router", "Nova 5"]
    body = "[" + ",".join(f'{{"id":"{i}","name":"{t}"}}' for i, t in enumerate(titles)) + "]"
    payload = spark.createDataFrame([("a", body), ("b", "no json")], "store string, body string")
    rows = lambda lex: sorted(map(str, discovery.flat(payload, lex).collect()))
    assert rows(tables) == rows(words) and len(rows(words)) == len(titles)
