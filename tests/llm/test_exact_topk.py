"""Exact top-k search against brute force in Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import exact_topk

SCHEMA = "vec_id long, embedding array<double>, class long, size int, score double"


def plain(rows, k, every):
    """(query_id, rank, vec_id, score) of all rows, in integers."""
    fine = [(i, [max(-(2**63), min(2**63 - 1, math.floor(1024 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (query, q) in enumerate(fine):
        if query % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, q, v)))), i) for m, (i, v) in enumerate(fine) if m != n and len(v) == len(q)]
            out += [(query, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def got(spark, rows, k, every, **more):
    df = spark.createDataFrame([(i, v, 1, 1, 1.0) for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.exact_topk(df, F.col("vec_id") % every == 0, k, **more).collect())


@pytest.mark.parametrize(("parts", "chunk_bytes"), [(2, 16 << 20), (3, 300)])
def test_topk_equals_brute_force(spark, parts, chunk_bytes):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(250, 10)).round(3)
    base[100:180] = base[20]  # a third are copies of a query
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(20, rows[20][1]), (20, rows[5][1]), (40, rows[40][1])]  # repeated ids and rows
    rows += [(2000, None), (2001, [None] + [1.0] * 9), (2020, [float("nan")] * 10), (2040, [float("inf")] + [0.0] * 9), (None, [9.0] * 10)]
    rows += [(3000, [0.0] * 10), (4000, [1.0, 2.0, 3.0]), (4001, [0.5, 0.5, -1.0]), (5000, []), (6001, [-4.0] * 10)]  # zero, other lengths, none
    assert got(spark, rows, 5, 20, parts=parts, chunk_bytes=chunk_bytes) == plain(rows, 5, 20)


def test_topk_of_negative_scores_and_few_candidates(spark):
    rows = [(0, [1.0, 1.0]), (1, [-3.0, -1.0]), (2, [-1.0, -1.0]), (3, [-1.0, -1.0])]
    assert got(spark, rows, 10, 1) == plain(rows, 10, 1)
    assert got(spark, rows, 1, 1) == plain(rows, 1, 1)
    assert got(spark, [], 3, 1) == [] and got(spark, [(7, [1.0])], 3, 7) == [] and got(spark, [(7, [1.0])], 3, 2) == []


def test_topk_of_large_components(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, -1e300, 3e6, -2e9, 5e12, 0.25])]
    assert got(spark, rows, 3, 2) == plain(rows, 3, 2)


def test_products_of_every_width():
    rnd = np.random.default_rng(0)
    for most in (10, 2**30, 2**50):
        a, b = rnd.integers(-most, most, (4, 6)), rnd.integers(-most, most, (3, 6))
        exact = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert exact_topk.products(a, b).tolist() == exact


def test_parts_cover_every_component():
    for size in range(9):
        for parts in (1, 2, 3, 5):
            assert [i for p in range(parts) for i in range(size)[exact_topk.part_of(size, p, parts)]] == list(range(size))
