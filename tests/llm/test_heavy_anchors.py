"""Suffix-array deduplication of a passage that stands in many documents with different neighbours."""

import random
from collections import Counter

import numpy as np

from marketlens.llm import repeats
from marketlens.llm.suffix_dedup import _NAMES, _passes, suffix_dedup

SCHEMA = "doc_id long, text string"


def rows():
    rnd = random.Random(12)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(4000)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [(i, f"{text(25)} {passage} {text(25)}" if i % 3 else text(40)) for i in range(600)]
    return out + [(700, out[1][1]), (None, out[4][1]), (701, passage[5:110]), (702, None), (703, "ab" * 3000)]


def brute(docs, n=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        marks = np.zeros(len(data), bool)
        for j in range(len(data) - n + 1):
            if data[j : j + n] in seen:
                marks[j : j + n] = True
            seen.add(data[j : j + n])
        spans = int((np.diff(np.concatenate(([0], marks.astype(int)))) == 1).sum())
        out[i] = (len(data), int(marks.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~marks]))
    return out


def test_heavy_anchors_give_the_same_and_do_not_gather(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    expected = brute(rows())
    for heavy in (16, 64, 1 << 40):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, heavy=heavy).collect()}
        assert got == expected
    total = repeats.text_bytes(docs)

    def most(heavy):
        """Bytes of different blocks of one anchor, the most of any."""
        sizes = Counter()
        for row in _passes(docs, total, 100, 24, heavy)[0].collect():
            for a, z in zip(np.frombuffer(row[_NAMES[1]], np.uint64), np.frombuffer(row[_NAMES[6]], np.int32)):
                sizes[int(a)] += int(z)
        return max(sizes.values())

    assert most(1 << 40) > 20_000  # all edge blocks at one anchor
    assert most(16) < 4_000
