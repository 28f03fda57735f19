"""The whole pipeline on planted documents, each stage against a plain version of it on the stage's own input."""

import hashlib
import random

from test_other_operators import hits
from test_short_lines import alike
from test_similar import brute_roots

import corpus_pipeline
from marketlens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Rows, ids of junk, and benchmark items: clean texts of two lines, exact and near copies, passages and junk."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("aeioulnrstmd") for _ in range(rnd.randint(3, 9)))
    words = [word() for _ in range(3000)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(line(15))) for i in range(4)]
    clean = [[line(80), line(80)] for _ in range(70)]
    texts = ["\n".join(map(" ".join, t)) for t in clean]
    texts += texts[:8]  # exact copies: their lines go
    for t in clean[8:30]:  # near copies: in each line a word is another, so the lines stay
        again = [list(x) for x in t]
        for x in again:
            x[rnd.randrange(10, 70)] = "another" + word()
        texts.append("\n".join(map(" ".join, again)))
    for i in range(10):
        own = line(90)
        own[40:40] = items[i % 4][1].split()
        texts.append(" ".join(own))
    junk = range(len(texts), len(texts) + 80)
    texts += [" ".join(rnd.choice(["BUY$$", "NOW!!!", "@@@", "CLICK##", "WIN%%", "$$$"]) for _ in range(rnd.randint(30, 60))) + f" {i}" for i in junk]
    return [(i, t, "en", [None, "a", "b", "c"][rnd.randrange(4)], len(t)) for i, t in enumerate(texts)], set(junk), items


def lines_kept(rows):
    seen, out = [], {}
    for i, t in sorted(rows.items()):
        kept, lines = [], t.split("\n")
        for own in lines:
            near = own and any(alike(own, other) for other in seen)
            if own:
                seen.append(own)
            if not near:
                kept.append(own)
        if len(kept) == len(lines) or "".join(kept).strip():
            out[i] = "\n".join(kept)
    return out


def one_of_each(rows):
    order = sorted(rows.items())
    best = {}
    for (i, _), root in zip(order, brute_roots(order), strict=True):
        best[root] = min(best.get(root, i), i)
    return {i: rows[i] for i in best.values()}


def taken(rows, source):
    """Words taken of each document: shares without rounds to spare, then documents by their hash."""
    size = {i: len(t.split()) for i, t in rows.items()}
    by = {}
    for i in rows:
        by.setdefault(source[i], []).append(i)
    own = {s: sum(size[i] for i in d) for s, d in by.items()}
    weight = dict(zip(sorted(own, key=lambda s: (s is None, s or "")), (5, 2, 1) * len(own), strict=False))
    target, full = {}, set()
    while True:
        rest, share = sum(own.values()) - sum(3 * own[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * own[s] if s in full else rest * w / share for s, w in weight.items()}
        over = {s for s in own if target[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    out = {}
    for s, docs in by.items():
        copies = int(target[s] // own[s])
        left = target[s] - copies * own[s]
        out |= {i: copies * size[i] for i in docs}
        for i in sorted(docs, key=lambda i: hashlib.md5(f"{i}\n{rows[i]}".encode()).hexdigest()[:15]):
            if size[i] > left:
                out[i] += size[i] if size[i] - left < left else 0
                break
            out[i] += size[i]
            left -= size[i]
    return {i: n for i, n in out.items() if n}


def test_each_stage_equals_its_plain_version(spark, tmp_path):
    rows, junk, items = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in junk), 0) for i, *_ in rows if i % 10], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = {
        "quality": lambda d: {i: t for i, t in d.items() if i not in junk}, "line_dedup": lines_kept, "simhash": one_of_each,
        "decontamination": lambda d: {i: t for i, t in d.items() if not hits(t, items)[1]},
    }
    docs, lost = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "mixing":
            assert {r.doc_id: r.taken for r in docs.collect()} == taken(before, {r[0]: r[3] for r in rows})
        else:
            assert after == plain[name](before), name
        lost[name] = len(before) - len(after)
    assert (lost["quality"], lost["line_dedup"], lost["simhash"], lost["decontamination"]) == (80, 8, 22, 10)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_many_rows_of_one_id_do_not_miss_the_target(spark):
    """A third of a source without an id: its rows are told apart by their texts."""
    rows = [(None if i % 3 == 0 else i, f"own{i} " + "w " * (i % 50), "abc"[i % 7 % 3]) for i in range(900)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {}
    for r in out.collect():
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(by) == 3 and all(abs(sum(v) - target) <= 26 for (_, target), v in by.items())
