"""The whole toxicity query against a plain version with dictionaries, from texts and labels to scores."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marketlens.llm import toxicity

ORDER, DISCOUNT = 5, 0.75


def folded(text):
    return bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def ending_at(text, i, n):
    return (b" " * n + text[: i + 1])[-n:]


def continuation(counts):
    """{gram: probability of its last byte after the others} from {gram: in how many longer ones it is}."""
    if len(next(iter(counts))) == 1:
        total = sum(counts.values())
        return {g: (c + 1) / (total + 256) for g, c in counts.items()}
    total, types, shorter = Counter(), Counter(), Counter(g[1:] for g in counts)
    for g, c in counts.items():
        total[g[:-1]] += c
        types[g[:-1]] += 1
    below = continuation(shorter)
    return {g: max(c - DISCOUNT, 0) / total[g[:-1]] + DISCOUNT * types[g[:-1]] / total[g[:-1]] * below[g[1:]] for g, c in counts.items()}


def ratios(rows):
    """{gram: log ratio} for the grams that say something. rows: (text, label)."""
    out = {}
    for n in range(2, ORDER + 1):
        seen = {0: Counter(), 1: Counter()}
        for text, label in rows:
            seen[label].update({ending_at(text, i, n) for i in range(len(text))})
        every = set(seen[0]) | set(seen[1])
        if not seen[0] or not seen[1]:
            continue
        shared = continuation(Counter(g[1:] for g in every))
        totals, types = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        for c in (0, 1):
            for g, k in seen[c].items():
                totals[c][g[:-1]] += k
                types[c][g[:-1]] += 1
        for g in every:
            logs = {}
            for c in (0, 1):
                total = totals[c][g[:-1]]
                own, rest = (max(seen[c][g] - DISCOUNT, 0) / total, DISCOUNT * types[c][g[:-1]] / total) if total else (0.0, 1.0)
                logs[c] = math.log(own + rest * shared[g[1:]])
            t, o = totals[1][g[:-1]], totals[0][g[:-1]]
            both, part = seen[0][g] + seen[1][g], t / (t + o)
            significant = abs(seen[1][g] - both * part) > 3 * math.sqrt(both * part * (1 - part) + 0.5)
            if significant or (both >= 10 and t and o):
                out[g] = logs[1] - logs[0] if significant else 0.0
    return out


def by_length(text, model):
    total = 0.0
    for i in range(len(text)):
        total += next((model[g] for n in range(ORDER, 1, -1) if (g := ending_at(text, i, n)) in model), 0.0)
    return total / max(len(text), 1)


def logistic(points):
    """(slope, shift) that maximise the likelihood less a little shrinkage, by Newton's method. points: (x, y)."""
    scale = max(math.sqrt(sum(x * x for x, _ in points) / len(points)), 1e-12)
    a = b = 0.0
    for _ in range(60):
        ga, gb, haa, hab, hbb = -1e-2 * a, -1e-4 * b, 1e-2, 0.0, 1e-4
        for x, y in points:
            z = x / scale
            p = 1 / (1 + math.exp(-max(-30, min(30, a * z + b))))
            ga, gb = ga + z * (y - p), gb + (y - p)
            haa, hab, hbb = haa + z * z * p * (1 - p), hab + z * p * (1 - p), hbb + p * (1 - p)
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a / scale, b


def plain(docs, labels, part):
    """{row: score}. part: fifth of each id, as a hash deals them."""
    known = defaultdict(int)
    for i, toxic in labels:
        if i is not None and toxic in (0, 1) and crc32(str(i).encode()) % 5:
            known[i] = max(known[i], toxic)
    rows = [(part[i], folded(text), known[i]) for i, text in docs if i in known]
    model = ratios([(t, y) for p, t, y in rows if p >= 1])
    slope, shift = logistic([(by_length(t, model), y) for p, t, y in rows if p < 1])
    return [1 / (1 + math.exp(-max(-30, min(30, slope * by_length(folded(text), model) + shift)))) for _, text in docs]


def test_scores_equal_plain(spark):
    rnd = random.Random(18)
    words = ["".join(rnd.choice("aeiostrné") for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    docs, labels = [], []
    for i in range(150):
        bad = i % 3 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 30))]
        for _ in range(3 * bad):
            text.insert(rnd.randint(0, len(text)), rnd.choice(["Vile", "SCUM", "moron"]))
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(text)))
        labels.append((i, int(bad)))
    labels += [(3, 0), (5, None), (7, 2), (None, 1), (9999, 1)]
    docs += [(200, None), (201, ""), (3, "the same id, other text"), (None, "vile scum"), (202, "x"), (203, "moron " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    ids = spark.createDataFrame([(i,) for i, _ in docs if i is not None], "doc_id long").distinct()
    part = {r.doc_id: r.part for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).alias("part")).collect()}
    expected = plain(docs, labels, part)
    out = toxicity.toxicity(df.coalesce(1), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()  # one partition: rows in order
    assert [r.doc_id for r in out] == [i for i, _ in docs]
    for r, x, (i, _) in zip(out, expected, docs, strict=True):
        assert r.score == pytest.approx(x, abs=1e-7) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (crc32((str(i) if i is not None else "").encode()) % 5 == 0)
    assert len({round(x, 6) for x in expected}) > 20
