"""Components and duplicate classes: long chains, hubs, texts as ids, nothing."""

import random

import pytest

from marketlens.operators import components as C
from marketlens.operators import fusion


def brute(edges):
    label = {x: x for e in edges for x in e}
    while True:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            return label


@pytest.mark.parametrize("few", [C.FEW_ROWS, 0])
def test_chain_and_hub(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(400)] + [(5000, 5001 + i) for i in range(1500)] + [(rnd.randint(9000, 9200), rnd.randint(9000, 9200)) for _ in range(150)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_of_a_chain_of_a_thousand(spark):
    rows = [(f"p{i:05d}", f"k{i // 2}", f"m{(i + 1) // 2}" if i else None) for i in range(1000)] + [("q", None, None)]
    found = fusion.classes(spark.createDataFrame(rows, "id string, k string, m string"), ["k", "m"])
    got = {r["id"]: r["class"] for r in found.collect()}
    assert got == {f"p{i:05d}": "p00000" for i in range(1000)} | {"q": "q"}
