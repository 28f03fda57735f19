"""Line deduplication and SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from marketlens.operators.components import components
from marketlens.llm.line_dedup import line_dedup
from marketlens.llm.simhash import BkTree, fingerprint, keep_one, near_duplicates, near_links

SCHEMA = "doc_id long, text string, lines string, text_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(4)


def alike(a, b, least=1):
    """Equal, or for lines of `least` characters or more, one edit apart."""
    if a == b or min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


@pytest.mark.parametrize("least", [1, 16])
def test_lines_within_one_edit(spark, least):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abé 𝄞") for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = rnd.choice(base)
            at = rnd.randint(0, len(line))
            kind = rnd.randint(0, 3)
            lines.append([line, line[:at] + "Z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "Q" + line[at + 1 :]][kind])
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 30_000), (204, "x" * 30_001)]
    seen, expected = [], {}
    for i, t in sorted(rows):
        kept, here = [], 0
        for line in (t or "").split("\n"):
            near = line and any(alike(line, other, least) for other in seen)
            if line:
                seen.append(line)
            if near:
                here += 1
            else:
                kept.append(line)
        expected[i] = (None if t is None else "\n".join(kept), here)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(frame(spark, rows), least).collect()}
    assert got == expected
    assert line_dedup(frame(spark, rows)).columns == ["doc_id", "text", "lines", "text_hash", "n_lines", "n_removed"]


def test_line_dedup_takes_columns_of_any_name(spark):
    names = ["n_lines", "N_REMOVED", "_c0", "dropped", "doc_id", "line", "text", "text_hash", "pos"]
    rows = [(7, "old", "x", 1, 1, "l", "one line here\none line herf", "h", 0), (8, None, None, None, 2, None, None, None, None)]
    out = line_dedup(spark.createDataFrame(rows, "n_lines long, N_REMOVED string, _c0 string, dropped int, doc_id long, line string, text string, text_hash string, pos int"))
    assert out.columns == [*(c for c in names if c.lower() not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r._c0, r.pos, r.n_lines, r.n_removed) for r in out.collect()}
    assert got == {1: ("one line here", "x", 0, 2, 1), 2: (None, None, None, 0, 0)}


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    text = "one line that is long enough\nanother line that is long enough"
    got = [(r.doc_id, r.n_removed) for r in line_dedup(frame(spark, [(1, text), (1, text), (2, text)])).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 2)]
    assert line_dedup(frame(spark, [])).collect() == []


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def test_fingerprint():
    for text in (None, "", " \n", "One", "one two THREE", "a b c d", "É é A\x0ba b", "q " * 100_000, "a\xa0b c d e f"):
        assert fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def reach(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def clustered(rnd, n):
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            out.add(base)
            for _ in range(rnd.randint(0, 5)):
                base ^= 1 << rnd.randint(0, 63)
    return sorted(out)[:n]


def test_bk_tree_connects_all_within_the_radius():
    rnd = random.Random(2)
    values = clustered(rnd, 300)
    rnd.shuffle(values)
    tree, label = BkTree(4), {v: v for v in values}
    for v in values:
        for other in tree.add(v):
            a, b = label[v], label[other]
            label = {k: (a if x == b else x) for k, x in label.items()}
    expected = reach(values, 4)
    assert len(set(label.values())) == len(set(expected))


def test_links_between_all_shards(spark):
    values = clustered(random.Random(9), 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(v, v) for v in signed]
    expected = reach(values, 4)
    assert len(set(got)) == len(set(expected)) == len(set(zip(got, expected)))


def test_near_duplicates(spark):
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(400))
    near = text.replace(text.split()[50], "other")
    rows = [(7, text), (3, near), (9, "quite another text with other words in it"), (None, text), (4, None), (5, ""), (7, text)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 3), (3, 3), (4, 4), (5, 4), (7, 3), (7, 3), (9, 9)]
    kept = keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lines", "text_hash"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert near_duplicates(frame(spark, [])).collect() == []
