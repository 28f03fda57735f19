"""The near-duplicate stage of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline
from marketlens.llm import simhash, similar
from marketlens.llm.similar import similar_docs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (5 * both >= 4 * (len(a) + len(sets[j]) - both)) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


def planted():
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    passage, rows = [word() for _ in range(60)], []
    for _ in range(40):
        base = [word() for _ in range(rnd.choice([1, 3, 5, 6, 30, 100, 400]))] + (passage if rnd.random() < 0.5 else [])
        for edits in (0, 0, 1, 1, 2, 3, 6, 12):
            text = list(base)
            for _ in range(edits):
                text[rnd.randrange(len(text))] = word()
            rows.append((len(rows), rnd.choice([" ", "\n", " \t"]).join(text).replace("w1", rnd.choice("Ww") + "1")))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (3, "same id, other words in it")]


def test_stage_keeps_one_of_all_that_are_similar(spark):
    rows = planted()
    label = brute_roots(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(5)
    best = {}
    for (i, t), x in zip(rows, label):
        best[x] = min(best.get(x, (True, 0)), (i is None, i or 0))
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(best.values())
    assert 40 < len(best) < len(rows) - 80


def test_one_large_group_and_nothing(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rnd.randint(1, 4)):
            text[rnd.randrange(200)] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    found = {r.doc_id: r.root for r in similar_docs(docs).collect()}
    got = [found[i] for i, _ in rows]
    expected = brute_roots(rows)
    assert len(set(got)) == len(set(expected)) == len(set(zip(got, expected)))
    assert similar_docs(docs.limit(0)).collect() == []


def test_components_of_fingerprints_are_verified_and_bitmaps_lose_nothing(spark, monkeypatch):
    """Documents that share only a fingerprint's component stay apart; sets of many documents are chosen by a bitmap."""
    rows = [(i, t) for i, t in planted() if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_roots(rows)
    near = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "0L AS root")
    monkeypatch.setattr(similar, "BROADCAST_NODES", 3)
    for given in (None, near):
        found = {(r.doc_id, r.text_hash): r.root for r in similar_docs(docs, near=given).collect()}
        got = [found[(r.doc_id, r.text_hash)] for r in near.collect()]
        assert len(set(got)) == len(set(expected)) == len(set(zip(got, expected, strict=True)))


def test_stage_starts_from_fingerprints(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(similar, "near_duplicates", lambda docs: seen.append(1) or simhash.near_duplicates(docs))
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (3, "z", "en", "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == [1, 3] and seen == [1]
