"""What the near-duplicate stage writes and shuffles where documents are many."""

import random

import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import repeats, simhash, similar


def test_shingles_of_one_document_are_left_out_however_many(spark, monkeypatch):
    """600,000 shingles, each in one document, beside a sketch of 262,144 counters."""
    monkeypatch.setattr(repeats, "SKETCH_BITS", (18, 18))
    seen, written = [], similar.written
    monkeypatch.setattr(similar, "written", lambda rows, name: seen.append(written(rows, name)) or seen[-1])
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randint(0, 10**9)}" for _ in range(2000))) for i in range(300)]
    rows.append((300, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.root for r in similar.similar_docs(docs).collect()}
    assert found[300] == found[7] and len(set(found.values())) == 300
    assert seen[0].filter("size is not null").count() < 4000


def test_filter_holds_what_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SKETCH_FLUSH", 500)
    monkeypatch.setattr(repeats, "FILTER_SHARD", 256)
    docs = spark.createDataFrame([(f"a{i % 700} b{i} c",) for i in range(5000)] + [(None,), ("",)], "text string").repartition(3)
    codes = lambda words: next(repeats.slices(pa.RecordBatch.from_pydict({"text": words}), "words")).codes
    found, values, counts = repeats.repeated_filter(docs, "words", lambda part: part.codes, 15000, 1000)
    assert found.parts == 6 and found.has(codes([f"a{i}" for i in range(700)] + ["c"])).all()
    assert found.has(codes([f"b{i}" for i in range(5000)])).mean() < 0.1
    assert values.tolist() == codes(["c"]).tolist() and counts.tolist() == [5000]
    none, values, counts = repeats.repeated_filter(docs.limit(0), "words", lambda part: part.codes, 0, 1000)
    assert not none.has(np.arange(9, dtype=np.uint64)).any() and not len(values) and not len(counts)


@pytest.mark.parametrize("most", [0, 500_000])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(simhash, "BROADCAST_DOCS", most, raising=False)
    rows = [(1, "a", 1), (2, "b", 1), (3, "c", 3), (None, None, 4), (8, "", 4), (5, "a", 5), (5, "d", 1), (6, "e", 6), (7, "f", 7), (7, "f", 7)]
    rows = [(i, t, r, i) for i, t, r in rows]
    table = spark.createDataFrame(rows, "doc_id int, text string, root long, `bits0.x` int")
    found = table.selectExpr("cast(doc_id AS long) doc_id", "xxhash64(coalesce(text, '')) text_hash", "root")
    kept = simhash.keep_best(table.drop("root"), found)
    assert kept.columns == ["doc_id", "text", "bits0.x"] and kept.schema["doc_id"].dataType.simpleString() == "int"
    got = sorted((r[0] or 0, r[1] or "", r[2] or 0) for r in kept.collect())
    assert got == [(1, "a", 1), (3, "c", 3), (5, "a", 5), (6, "e", 6), (7, "f", 7), (8, "", 8)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        single = table.filter("doc_id < 5 or doc_id = 6")
        capsys.readouterr()
        simhash.keep_best(single.drop("root"), found.filter("doc_id < 5 or doc_id = 6")).explain()
        said = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = said.split("Union")[1].split("SortMergeJoin")[0] if most == 0 else said
    assert "Exchange hashpartitioning(coalesce(doc_id" not in first and "SortMergeJoin" not in first and "LeftAnti" in first
