"""Suffix-array and substring deduplication against brute force."""

import hashlib
import random
import re

import pytest

from marketlens.llm import repeats
from marketlens.llm.suffix_array import suffix_array
from marketlens.llm.suffix_dedup import later_windows, suffix_dedup
from marketlens.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, shard string, text_hash string"


def corpus():
    rnd = random.Random(7)
    words = [f"w{rnd.randint(0, 400)}é"[: rnd.randint(2, 6)] for _ in range(300)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 150)))
        if i % 3 == 0:
            text += " " + passage[: rnd.randint(100, len(passage))] + "\n" + text[:40]
        if i % 7 == 0:
            text = rows[rnd.randint(0, len(rows) - 1)][1] if rows else text
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a " * 500), (103, "ab" * 400), (104, " \t\n"), (105, passage + "　" + passage)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA).repartition(5)


def removed(sequences, n):
    """Positions covered by a run of n items that also starts earlier."""
    seen, out = set(), {}
    for key, items in sequences:
        marks = [False] * len(items)
        for j in range(len(items) - n + 1):
            window = tuple(items[j : j + n])
            if window in seen:
                marks[j : j + n] = [True] * n
            seen.add(window)
        out[key] = marks
    return out


def test_suffix_array_of_random_and_periodic_texts():
    rnd = random.Random(3)
    for _ in range(1500):
        text = [rnd.randint(0, rnd.choice([0, 1, 2, 25])) for _ in range(rnd.randint(0, 40))] * rnd.randint(1, 3)
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_later_windows_keep_the_earliest():
    blocks, places = [b"xxabcdefgh", b"abcdefghyy", b"zabcdefg"], [20 << 32, 10 << 32, 30 << 32]
    found = sorted(later_windows(blocks, places, 6))
    assert found == [(0, 2), (0, 3), (0, 4), (2, 1), (2, 2)]


@pytest.mark.parametrize("window,gram", [(100, 32), (40, 16)])
def test_suffix_dedup(spark, window, gram):
    rows = corpus()
    texts = {i: (t or "").encode() for i, t in rows}
    marks = removed([(i, texts[i]) for i in sorted(texts)], window)
    for r in suffix_dedup(frame(spark, rows), window, gram, digest=True).collect():
        m = marks[r.doc_id]
        kept = bytes(b for b, x in zip(texts[r.doc_id], m) if not x)
        spans = sum(x and not (k and m[k - 1]) for k, x in enumerate(m))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(m), sum(m), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window,gram", [(20, 8), (5, 2)])
def test_substring_dedup(spark, window, gram):
    rows = corpus()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    marks = removed([(i, words[i]) for i in sorted(words)], window)
    for r in substring_dedup(frame(spark, rows), window, gram).collect():
        m = marks[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(m), sum(m), " ".join(w for w, x in zip(words[r.doc_id], m) if not x))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    out = sorted((r.doc_id is not None, r.doc_id, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect())
    assert out == [(False, None, 0), (True, 1, 40), (True, 1, 40), (True, 2, 40)]  # a null id comes first; equal rows are one document
    out = sorted((r.doc_id is not None, r.doc_id, r.n_removed) for r in suffix_dedup(frame(spark, rows)).collect())
    assert [x[2] for x in out] == [0, len(text), len(text), len(text)]


def test_empty_table(spark):
    assert suffix_dedup(frame(spark, [])).collect() == []
    assert substring_dedup(frame(spark, [])).collect() == []


def test_one_long_document(spark):
    rnd = random.Random(1)
    half = " ".join(str(rnd.randint(0, 10**6)) for _ in range(200_000))
    rows = [(5, half + " " + half)]
    assert substring_dedup(frame(spark, rows)).first().n_removed == 200_000
    first = suffix_dedup(frame(spark, rows)).first()
    assert (first.n_removed, first.n_spans) == (len(half), 1)


def test_sketch_never_loses_a_repeated_anchor(spark):
    rows = frame(spark, corpus())
    for bits in (18, 9):  # 9: far too few counters
        bitmap = repeats.repeated_bitmap(repeats.keyed(rows), "words", 20, 8, bits)
        batch = rows.select("text").toArrow().to_batches()
        counts = {}
        for b in batch:
            for part in repeats.slices(b, "words"):
                for h in repeats.anchors(part, 20, 8).hash.tolist():
                    counts[h] = counts.get(h, 0) + 1
        import numpy as np

        often = np.array([h for h, n in counts.items() if n > 1], np.uint64)
        assert len(often) and repeats.is_repeated(often, bitmap, bits).all()
