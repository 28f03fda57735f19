"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(docs, items):
    """(doc_id, n_features, weight, score, rank) of each row, in order of the draw, then the rest."""
    corpus, target = Counter(), Counter()
    for _, text in docs:
        corpus.update(features(text)[1])
    for _, text in items:
        target.update(features(text)[1])
    s_all, t_all, rows = sum(corpus.values()), sum(target.values()), []
    for doc_id, text in docs:
        n, buckets = features(text)
        gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000)))) for b in buckets]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    most = 25 * len(order) // 100
    return sorted(map(str, [(*r[:4], i + 1) for i, r in enumerate(order[:most])] + [(*r[:4], None) for r in order[most:] + [r for r in rows if not r[4]]]))


def got(out):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in out.collect())


def test_resampling_equals_plain(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("aeiouAZé中9") for _ in range(rnd.randint(1, 6))) for _ in range(150)] + ["x" * 70, "ß" * 40]
    text = lambda n: rnd.choice([" ", "--", "\n", "\x00"]).join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 19, 20, 21, 60]))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)] + [(7, docs[7][1]), (7, docs[9][1]), (None, text(50)), (None, text(50)), (2000, None), (2001, ""), (2002, text(60_000))]
    items = [(i, text(30)) for i in range(10)] + [(11, None), (12, "")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, score long, bucket long, row long").repartition(5)
    target = spark.createDataFrame(items, "item_id long, text string")
    expected = plain(docs, items)
    assert got(resampling.resample(df, target)) == expected
    assert got(resampling.resample(df.repartition(1), target)) == expected
    assert [r.doc_id for r in resampling.resample(df.limit(0), target).collect()] == []
    assert got(resampling.resample(df, target.limit(0))) == plain(docs, [])


def test_runs_of_joined_texts(spark, monkeypatch):
    """Texts longer than a run stand alone; nulls and empty texts stay in place."""
    import pyarrow as pa

    monkeypatch.setattr(resampling, "JOINED_BYTES", 10)
    texts = [None, "", "abc", "d" * 30, "", "ef gh", None, "i"]
    runs = list(resampling.joined_texts(pa.array(texts)))
    assert [t for _, run in runs for t in run] == [(t or "").encode() for t in texts] and [at for at, _ in runs] == [0, *np.cumsum([len(r) for _, r in runs])[:-1]]


def test_ranks_of_one_score_shared_by_all(spark):
    """All rows tie: ranks go by id without gap or repeat over many ranges."""
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("score"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.col("id").alias("row"))
    out = resampling.ranked(rows.repartition(9), F.lit(True), 2500).collect()
    ranks = {r.row: r["rank"] for r in out}
    assert sorted(x for x in ranks.values() if x) == list(range(1, 2501)) and len(out) == 3000
    ids = sorted(r.row for r in out if r.doc_id is not None)
    assert [ranks[i] for i in ids] == list(range(1, 2001))  # null ids come last


def test_nothing_fits(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert got(resampling.resample(df, df)) == plain([(1, "a b"), (2, None)], [(1, "a b")])
