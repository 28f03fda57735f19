"""WARC, nearest neighbours, toxicity, decontamination, mixing, quality and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import ann, decontamination, mixing, quality, toxicity, warc

SF = "/root/testdata/sf0.001"


# --- WARC ---------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "x" * 300
    rows = [(1, "http://a", big, "z"), (2, None, big, "z"), (3, "u\r\nv", None, "z"), (4, "u", "short", "z"), (5, "u", "short", "z"), (None, "u", "é" * 60, "z"), (9, "u", "q" * (17 << 20), "z")]
    out = {r.page_id: r for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), 2).collect()}
    assert len(out) == 7
    assert (out[1].record_type, out[1].refers_to, out[2].record_type, out[2].refers_to) == ("response", None, "revisit", 1)
    assert out[5].record_type == "response" and out[3].payload_bytes == 0 and out[None].payload_bytes == 120
    for page_id, _, html, _ in rows:
        assert out[page_id].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_of_repeated_ids_and_files_of_bounded_bytes(spark, tmp_path):
    rnd = random.Random(12)
    body = {k: "".join(rnd.choice("abcdefghij") for _ in range(3000)) for k in range(3)}
    rows = [(5, "u", body[0]), (5, "u", body[0]), (5, "u", body[1]), (7, "u", body[0])] + [(100 + i, "u", body[2][i:]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.warc_round_trip(pages, 4000).filter("page_id < 100").collect())
    assert got == [(5, "response", 0, 3000), (5, "response", 0, 3000), (5, "response", 0, 3000), (7, "revisit", 5, 3000)]
    warc.write_warc(warc.with_revisits(pages), str(tmp_path / "w"), 4000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 12 and max(sizes) <= 4000 + 1
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(rows)


def test_warc_revisits_are_checked(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    good = [(1, 9, "d", "response", None, ""), (2, 9, "d", "revisit", 1, "")]
    assert warc.checked(spark.createDataFrame(good, schema)).count() == 2
    for bad in ((2, 8, "d", "revisit", 1, ""), (2, 9, "e", "revisit", 1, ""), (2, 9, "d", "revisit", 3, "")):
        with pytest.raises(ValueError):
            warc.checked(spark.createDataFrame([good[0], bad], schema))


def test_warc_reader_rejects_damage():
    good = warc.gzip_member(warc.record_bytes(1, "http://a", b"hello", hashlib.sha256(b"hello").hexdigest(), None))
    (headers, block), (_, again) = warc.read_records(good + b"\0" + good, step=7)
    assert block == again == b"hello" and headers["WARC-Target-URI"] == "http://a"
    with pytest.raises(ValueError):
        list(warc.read_records(good[:-9]))
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"hello", b"jello"), raw.replace(b"Content-Length: 5", b"Content-Length: 4"), b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(warc.gzip_member(bad)))


# --- nearest neighbours ---------------------------------------------------------


def test_nearest_equals_brute_force(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(300, 16))
    base[100:140] = base[7]  # many equal vectors: ties to the smaller id
    rows = [(i, [float(x) for x in v], 0, 1) for i, v in enumerate(base)]
    rows += [(1000, None, 0, 1), (1001, [0.0] * 16, 0, 1), (1002, [float("nan")] * 16, 0, 1), (1003, [None] + [1.0] * 15, 0, 1), (None, [1.0] * 16, 0, 1), (1010, [1.0, 2.0], 0, 1), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h long, size int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 5, 64).collect()}
    norm = np.sqrt((base * base).sum(1))
    expected = {}
    ids = np.array([*range(300), 3])  # row 3 is there twice, and counts twice
    for i in range(0, 300, 10):
        score = (base[ids] * base[i]).sum(1) / (norm[ids] * norm[i])
        score[i] = -9
        for r, j in enumerate(np.lexsort((ids, -score))[:5]):
            expected[(i, r + 1)] = (int(ids[j]), float(score[j]))
    assert got == expected


def test_nearest_leaves_out_only_the_own_row(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).collect())
    one = [(0, 1, 0, 1.0), (0, 2, 7, 1.0), (0, 3, 0, 0.0)]  # the copy, the other vector's row, the row that shares the id
    assert got == sorted([*one, *one, (0, 1, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 7, 0.0)])  # fewer than five candidates: all


def test_nearest_of_long_vectors(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(60, 3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 3, 7).collect()}
    unit = base / np.sqrt((base * base).sum(1))[:, None]
    for i in range(0, 60, 20):
        score = unit @ unit[i]
        score[i] = -9
        assert [got[(i, r + 1)] for r in range(3)] == np.argsort(-score)[:3].tolist()


def test_nearest_of_extreme_magnitudes(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(80, 6))
    tiny, huge = base * 2.0**-980, base * 2.0**1000
    big = [float(x) for x in base[3]]
    big[2] = 1e300  # one component dwarfs the others
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base[:30], tiny[30:55], huge[55:]]))] + [(500, big), (600, [5e-324] * 6)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    plain = np.concatenate([base, [[0, 0, 1, 0, 0, 0]], [[1] * 6]])
    unit, ids = plain / np.sqrt((plain * plain).sum(1))[:, None], np.array([r[0] for r in rows])
    assert len(got) == 5 * 6 and all(np.isfinite(r.score) for r in got)
    for i in np.flatnonzero(ids % 20 == 0):
        score = unit @ unit[i]
        score[i] = -9
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == ids[i])
        best = np.argsort(-score)[:5]
        assert [r[1] for r in mine] == ids[best].tolist() and np.allclose([r[2] for r in mine], score[best])


def test_quantisation_bounds_hold():
    rnd = np.random.default_rng(0)
    a, b = rnd.normal(size=(50, 40)), rnd.normal(size=(60, 40))
    a, b = a / np.sqrt((a * a).sum(1))[:, None], b / np.sqrt((b * b).sum(1))[:, None]
    (qa, sa, _), (qb, sb, tb) = ann.quantised(a), ann.quantised(b)
    near = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(near - a @ b.T) <= (np.abs(a).sum(1)[:, None] * sb + sa[:, None] * tb) / 2 + 1e-9).all()


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


# --- toxicity and quality -------------------------------------------------------


def labelled(spark, n=400):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text, bad = [rnd.choice(words) for _ in range(80)], i % 4 == 0
        if bad:
            for _ in range(4):
                text.insert(rnd.randint(0, 80), rnd.choice(["vile", "scumbag", "moronic"]))
        junk = i % 5 == 0
        docs.append((i, ("spam! " * 60 if junk else "") + " ".join(text), "en", f"s{i % 3}", 500, 1.0))
        labels.append((i, 0 if junk else 1, int(bad)))
    docs += [(900, None, None, None, None, 1.0), (901, "", "en", "s0", 0, 1.0), (902, "long " * 200_000, "en", "s0", 10**6, 1.0), (0, "same id, other text", "en", "s0", 20, 1.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity(docs, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and 0 < r.doc_id < 900]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = labelled(spark, 20)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_continuation_is_a_distribution():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    keys = np.unique(toxicity.grams(data, np.array([0, len(data)]), 3))
    p = toxicity.continuation(keys, np.ones(len(keys)), 3)
    sums = {}
    for k, x in zip(keys.tolist(), p.tolist()):
        sums[k >> 8] = sums.get(k >> 8, 0) + x
    assert all(s <= 1 + 1e-9 for s in sums.values())


def test_ratios_equal_a_plain_kneser_ney():
    """The ratio of every gram that is kept, against Kneser-Ney written out with dictionaries."""
    rnd = random.Random(4)
    counts = {}
    for _ in range(6000):
        g, c = "".join(rnd.choice("abc") for _ in range(3)), rnd.random() < 0.3
        g = "abb" if c and rnd.random() < 0.3 else g
        counts.setdefault(g, [0, 0])[0 if c else 1] += 1
    code = lambda g: int.from_bytes(g.encode(), "big")
    order = sorted(counts, key=code)
    keys, toxic, ordinary = np.array([code(g) for g in order]), np.array([counts[g][0] for g in order], float), np.array([counts[g][1] for g in order], float)
    model = toxicity.fit_ratios(toxicity.tagged(keys, 3), toxic, ordinary, 3)
    pairs = {g[1:] for g in order}  # continuation counts of pairs: how many grams they end
    ends = {p: sum(g[1:] == p for g in order) for p in pairs}
    ones = {c: sum(p[1] == c for p in pairs) for c in "abc"}
    single = {c: (ones[c] + 1) / (sum(ones.values()) + 256) for c in "abc"}

    def pair(p):
        own = {q: n for q, n in ends.items() if q[0] == p[0]}
        return max(ends[p] - 0.75, 0) / sum(own.values()) + 0.75 * len(own) / sum(own.values()) * single[p[1]]

    def log(g, c):
        own = {h: counts[h][c] for h in order if h[:2] == g[:2]}
        total, types = sum(own.values()), sum(n > 0 for n in own.values())
        return np.log(max(counts[g][c] - 0.75, 0) / total + 0.75 * types / total * pair(g[1:]))

    share = {g[:2]: sum(counts[h][0] for h in order if h[:2] == g[:2]) / sum(sum(counts[h]) for h in order if h[:2] == g[:2]) for g in order}
    kept = dict(zip((model.grams & 0xFFFFFF).tolist(), model.ratios.tolist(), strict=True))
    told = 0
    for g in order:
        n, e = sum(counts[g]), sum(counts[g]) * share[g[:2]]
        if abs(counts[g][0] - e) > 3 * np.sqrt(e * (1 - share[g[:2]]) + 0.5):
            assert kept[code(g)] == pytest.approx(log(g, 0) - log(g, 1))
            told += 1
        else:
            assert kept.get(code(g), 0.0) == 0.0
    assert told > 2


def test_conflicting_labels_do_not_crash(spark):
    docs, labels = labelled(spark, 60)
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic"))).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 7, 7)], labels.schema))
    assert toxicity.toxicity(docs, both).count() == docs.count() == quality.quality(docs, both).count()
    assert quality.scores(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label"))).count() == docs.count()


def test_quality_equals_plain_co_training(spark):
    """Two rounds over feature rows, written out with loops, against the operator."""
    docs, labels = labelled(spark, 150)
    docs, known = docs.filter("doc_id between 1 and 899"), labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id % 3 > 0")
    got = {r.doc_id: r.score for r in quality.scores(docs, known, rounds=2).collect()}
    label = {r.doc_id: r.label for r in known.collect()}
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)).alias("p")).collect()}
    rows = {r.doc_id: ({"text": list(r.text), "words": np.flatnonzero(np.unpackbits(np.frombuffer(r.words, np.uint8))).tolist(), "meta": list(r.meta)}) for r in quality.views(docs).collect()}
    held = [i for i in label if i in rows and part[i] < 1]
    own = {i: label[i] for i in label if i in rows and part[i] >= 1}
    sure = np.log(0.95 / 0.05)

    def odds(view, target):
        n = [sum(y == c for y in target.values()) for c in (0, 1)]
        seen, words = {}, {}
        for i, y in target.items():
            for f in rows[i][view]:
                seen.setdefault(f, [0, 0])[y] += 1
            for f in rows[i]["words"] if view == "text" else ():
                words.setdefault(f, [0, 0])[y] += 1
        plain = lambda f: np.log((seen.get(f, [0, 0])[1] + 1) / (n[1] + 2)) - np.log((seen.get(f, [0, 0])[0] + 1) / (n[0] + 2))
        every = [sum(w[c] for w in words.values()) + quality.WORD_SLOTS for c in (0, 1)]
        share = every[1] / sum(every)
        content = {f: np.log((w[1] + 1) / every[1]) - np.log((w[0] + 1) / every[0]) for f, w in words.items() if abs(w[1] - sum(w) * share) > 3 * np.sqrt(sum(w) * share * (1 - share) + 0.5)}

        def of(i):
            told = [content[f] for f in rows[i]["words"] if f in content] if view == "text" else []
            return np.log((n[1] + 1) / (n[0] + 1)) + sum(plain(f) for f in rows[i][view]) + sum(told) / np.sqrt(1 + len(told))

        return of

    def calibrated(of):
        bin_ = lambda x: int(max(0, min(40, np.floor(x + 0.5) + 20)))
        counts = np.zeros((41, 2))
        for i in held:
            counts[bin_(of(i)), label[i]] += 1
        prior = (counts.sum(0) + 1) / (counts.sum() + 2)
        rate, size = [(c[1] + 2 * prior[1]) / (c.sum() + 2) for c in counts], [c.sum() + 2 for c in counts]
        out = [max(min(np.average(rate[a : b + 1], weights=size[a : b + 1]) for b in range(k, 41)) for a in range(k + 1)) for k in range(41)]  # monotone least squares
        return lambda i: np.log(out[bin_(of(i))] / (1 - out[bin_(of(i))]))

    targets = {"text": own, "meta": own}
    for _ in range(2):
        score = {v: calibrated(odds(v, targets[v])) for v in ("text", "meta")}
        for view, other in (("text", "meta"), ("meta", "text")):
            given = {i: int(score[other](i) > 0) for i in rows if i not in label and abs(score[other](i)) >= sure}
            targets[view] = own | given
    n = [sum(label[i] == c for i in held) for c in (0, 1)]
    for i in rows:
        total = score["text"](i) + score["meta"](i) - np.log(n[1] / n[0])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    rows = quality.quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and 0 < r.doc_id < 900]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in quality.quality(docs, labels.limit(0)).collect()} == {1}
    assert quality.quality(docs.limit(0), labels).collect() == []


# --- decontamination ------------------------------------------------------------


def hits(text, items, window=10):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    marks, found = [False] * len(words), set()
    for item, body in items:
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or ""))
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                marks[i : i + n] = [True] * n
                found.add(str(item))
    return len(words), sum(marks), sorted(found)


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(6)
    words = [f"{c}{n}" for c in "abcdeÉ" for n in range(6)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25])))) for i in range(30)] + [(77, None), (78, "--"), (None, "zz yy xx ww vv uu tt ss rr qq")]
    docs = []
    for i in range(50):
        text = [rnd.choice(words).upper() for _ in range(rnd.randint(0, 40))]
        if i % 2:
            at = rnd.randint(0, len(text))
            text[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((i, rnd.choice([" ", "-", "\n, "]).join(text), "k", 1))
    docs += [(90, None, "k", 1), (91, "", "k", 1), (92, "filler " * 50_000 + items[-1][1], "k", 1), (93, docs[1][1], "k", 1), (1, docs[1][1], "k", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.contamination(d, b).collect():
        text = next(t for i, t, *_ in docs if i == r.doc_id)
        n, hit, found = hits(text, items)
        assert (r.n_words, r.n_hit, [x for x in r["items"]]) == (n, hit, [x for x in found if x != "None"])
    clean = {i for i, t, *_ in docs if not hits(t, items)[1]}
    kept = decontamination.drop_contaminated(d, b)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == d.columns
    spans = decontamination.remove_spans(d, b)
    assert spans.columns == d.columns and spans.count() == d.count()
    for r in spans.collect():
        text = next(t for i, t, *_ in docs if i == r.doc_id and (t is None or not hits(t, items)[1] or True))
        if r.doc_id in clean:
            assert r.text == text
        else:
            n, hit, _ = hits(text, items)
            assert hits(r.text, [])[0] == n - hit
    assert decontamination.contamination(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# --- mixing ----------------------------------------------------------------------


def test_targets_are_shared_again_until_none_is_above_its_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 30), ("d", 0), (None, 500)]
    out = {r.source: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    total, capped = 1540.0, set()
    while True:
        rest = total - sum(3 * out[s].source_size for s in capped)
        free = [s for s in weights if s not in capped]
        target = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * out[s].source_size}
        if not over:
            break
        capped |= over
    for s in weights:
        assert out[s].target == pytest.approx(target[s] if s in target else 3.0 * out[s].source_size)


def test_mix_comes_near_its_targets(spark):
    rnd = random.Random(3)
    docs = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "c", None]), 1, 2) for i in range(800)] + [(None, "x y", "a", 1, 2), (5, None, "b", 1, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size long, taken long")
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(docs) and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)  # two sources of one weight have one target
    assert len(by) == 4 and all(abs(sum(v) - t) <= 60 for (_, t), v in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df, whole=True).columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_mix_of_whole_rows_with_clashing_names(spark, tmp_path):
    docs = [(f"c{i}", i, i, "w " * (i % 9), "a" if i % 3 else None, "x", "y", "z", "h", "s", 0) for i in range(60)]
    names = "_c1 string, doc_id long, _c0 long, text string, source string, Size string, TAKEN string, Target string, hash string, s string, below long"
    df = spark.createDataFrame(docs, names)
    plain = {(r.doc_id, r.size, r.taken) for r in mixing.mix_sources(df.select("doc_id", "text", "source")).collect()}
    mixing.mix_sources(df, whole=True).write.parquet(str(tmp_path / "mix"))
    rows = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert {(r.doc_id, r["size"], r.taken) for r in rows} == plain and all(r._c1 == f"c{r._c0}" and r._c0 == r.doc_id and r.hash == "h" for r in rows)
    taken = {(r.doc_id, r["size"]) for r in corpus_pipeline.mixing_stage(spark, df, "").collect()}
    assert taken == {(i, n) for i, n, t in plain if t}


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    assert 0 < out.count() <= docs.count() and set(docs.columns) <= set(out.columns)
    odd = docs.limit(40).withColumnsRenamed({"n_chars": "size"}).withColumns({"n_chars": F.col("size"), **{c: F.lit(1) for c in ("n_lines", "n_removed", "label", "root", "key0", "target", "taken", "score")}})
    columns = ["doc_id", "text", *[c for c in odd.columns if c not in ("doc_id", "text")]]
    empty = [(None,) * len(columns), (7, "") + (None,) * (len(columns) - 2), (8, "long word " * 200_000) + (None,) * (len(columns) - 2)]
    odd = odd.unionByName(spark.createDataFrame(empty, ", ".join(f"{c} {dict(odd.dtypes)[c]}" for c in columns)))
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, SF)
        rows.collect()
        if name != "mixing":
            assert stage(spark, docs, SF).columns == docs.columns and rows.columns == odd.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
