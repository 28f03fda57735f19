"""Quality classification by co-training.

Two classifiers see different views of a document: one its text (the shapes of
it, and which hashed words it has), one its metadata (source, language, length).
Both start from the labels. In each round either one labels, for the other, the
unlabelled documents it is sure of. In the end each view's score is calibrated
on labels that it was not fitted to, and the two are added as log odds. Both are
naive Bayes models over numbered features, so a round is one aggregation over
compact feature rows, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import repeats
from marketlens.llm.common import filter_docs, written
from marketlens.llm.toxicity import fold_of

ROUNDS = 3
#: Calibrated probability from which a view labels for the other.
CONFIDENT = 0.95
#: Bins of one text feature.
BINS = 12
#: Slots of hashed words; a document has a bit for each.
WORD_SLOTS = 4096
#: Rows whose word bits are unpacked at once: 2 MB of them.
BITS_ROWS = 512
#: A word slot counts beyond as many standard deviations of what chance explains.
DEVIATIONS = 3.0
#: Share of the labels, in fifths, that calibrates and is not fitted to.
CALIBRATION = 1
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 1024, 64, 40
#: Bins of a view's log odds, 1 wide, around 0.
CALIBRATION_BINS = 41
SMOOTHING = 1.0
THRESHOLD = 0.5

TEXT_FEATURES = ("upper", "digit", "mark", "symbol", "space", "line", "other", "distinct", "repeat", "word", "ends")
_CLASS = np.zeros(256, np.uint8)  # 0: lower-case letters and bytes above ASCII
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (33, 34, 39, 44, 46, 58, 59, 63)]] = 4
_CLASS[[32, 9]] = 5
_CLASS[[10, 13]] = 6
_CLASS[[c for c in range(0, 32) if c not in (9, 10, 13)] + [127]] = 7
_FOLD = np.arange(256, dtype=np.uint8)  # words of content: letters lowered, marks and digits between words
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _binned(share: np.ndarray) -> np.ndarray:
    """Shares 0 to 1 in BINS bins, finer towards 0."""
    return np.minimum(np.floor(np.log2(np.maximum(share, 0) * 1024 + 1)), BINS - 1).astype(np.int32)


def text_features(part: repeats.Slice) -> np.ndarray:
    """A row of bins for each document of a slice of words."""
    n = len(part.rows)
    sizes = np.diff(part.offsets)
    doc = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(doc * 8 + _CLASS[part.data], minlength=8 * n).reshape(n, 8)
    length = np.maximum(sizes, 1)
    words = np.diff(part.first)
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((part.codes, owner))
    o, c = owner[order], part.codes[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1]))) if len(o) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=n)
    again = np.concatenate(([False], (part.codes[1:] == part.codes[:-1]) & (owner[1:] == owner[:-1]))) if len(o) else new
    many = np.maximum(words, 1)
    last = part.data[part.ends - 1] if len(o) else part.data[:0]
    columns = [
        _binned(kinds[:, 1] / length), _binned(kinds[:, 2] / length), _binned(kinds[:, 3] / length), _binned(kinds[:, 4] / length),
        _binned(kinds[:, 5] / length), _binned(kinds[:, 6] / length), _binned(kinds[:, 7] / length),
        np.minimum(distinct * 10 // many, BINS - 1), _binned(np.bincount(owner[again], minlength=n) / many),
        np.minimum((kinds[:, :5].sum(axis=1) / many), BINS - 1).astype(np.int32), np.minimum(np.bincount(owner[_CLASS[last] == 3], minlength=n) * 20 // many, BINS - 1),
    ]
    return np.stack([c.astype(np.int32) + i * BINS for i, c in enumerate(columns)], axis=1)


def word_bits(part: repeats.Slice) -> np.ndarray:
    """A row of WORD_SLOTS bits, packed, for each document of a slice of content words."""
    bits = np.zeros((len(part.rows), WORD_SLOTS), bool)
    bits[np.repeat(np.arange(len(part.rows)), np.diff(part.first)), (repeats.mixed(part.codes) % np.uint64(WORD_SLOTS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [text_features(p) for p in repeats.slices(batch, "words")]
        table = np.concatenate(parts) if parts else np.zeros((0, len(TEXT_FEATURES)), np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, len(TEXT_FEATURES)), pa.int32()), pa.array(table.reshape(-1)))
        words = [row.tobytes() for p in repeats.slices(batch, "words", fold=_FOLD) for row in word_bits(p)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), lists, pa.array(words, pa.binary()), *(batch.column(c) for c in ("source", "lang", "n_chars"))], names=["doc_id", "text_hash", "text", "words", "source", "lang", "n_chars"])


def views(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, words and meta: the features of each view."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    found = rows.mapInArrow(_features, "doc_id long, text_hash long, text array<int>, words binary, source string, lang string, n_chars long")
    slot = lambda c, n: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(n - 1)).cast("int") + 1)
    length = F.when(F.col("n_chars").isNull(), 0).otherwise(F.least(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)).cast("int") + 1, F.lit(LENGTH_SLOTS - 1)))
    meta = F.array(slot("source", SOURCE_SLOTS), slot("lang", LANG_SLOTS) + SOURCE_SLOTS, length + SOURCE_SLOTS + LANG_SLOTS)
    return found.select("doc_id", "text_hash", "text", "words", meta.cast("array<int>").alias("meta"))


SHAPES = len(TEXT_FEATURES) * BINS
WIDTH = {"text": SHAPES + WORD_SLOTS, "meta": SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS}


def _text_matrices(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """BITS_ROWS rows at a time: where they are in the batch, their shape features and their word bits."""
    for at in range(0, batch.num_rows, BITS_ROWS):
        part = batch.slice(at, BITS_ROWS)
        shapes = part.column("text").flatten().to_numpy().reshape(part.num_rows, -1)
        words = np.unpackbits(np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
        yield slice(at, at + part.num_rows), shapes, words.view(bool)


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, y, n): the sums of a task, the number of rows last."""
    counts = np.zeros((2, WIDTH["text"] + 1), np.int64)
    for batch in batches:
        y = batch.column("y").to_numpy()
        for rows, shapes, words in _text_matrices(batch):
            for c in (0, 1):
                own = y[rows] == c
                counts[c, :SHAPES] += np.bincount(shapes[own].reshape(-1), minlength=SHAPES)
                counts[c, SHAPES:-1] += words[own].sum(axis=0, dtype=np.int64)
                counts[c, -1] += int(own.sum())
    y, f = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(counts[y, f])], names=["f", "y", "n"])


def fit_view(rows: DataFrame, view: str, label: Column) -> list[float]:
    """Log odds by feature number, the prior last: one aggregation, at most two rows a feature reach the driver."""
    rows = rows.withColumn("y", label).filter("y is not null")
    if view == "text":
        seen = rows.select("text", "words", F.col("y").cast("int").alias("y")).mapInArrow(_text_counts, "f int, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n"))
    else:
        seen = rows.select(F.explode(F.concat(view, F.array(F.lit(WIDTH[view])))).alias("f"), "y").groupBy("f", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((WIDTH[view] + 1, 2))
    for r in seen.collect():
        counts[r["f"], r["y"]] = r["n"]
    return feature_odds(counts, SHAPES if view == "text" else WIDTH[view])


def feature_odds(counts: np.ndarray, plain: int) -> list[float]:
    """Log odds of counts by feature and class; features from ``plain`` on count only where chance does not explain them."""
    totals = counts[-1] + SMOOTHING
    odds = np.log((counts[:, 1] + SMOOTHING) / (totals[1] + SMOOTHING)) - np.log((counts[:, 0] + SMOOTHING) / (totals[0] + SMOOTHING))
    words = counts[plain:-1]
    if words.size:  # shares of all words of a class, so that the length of documents says nothing here
        every = words.sum(axis=0) + SMOOTHING * len(words)
        share = every[1] / every.sum()
        expected = words.sum(axis=1) * share
        beyond = np.abs(words[:, 1] - expected) > DEVIATIONS * np.sqrt(expected * (1 - share) + 0.5)
        odds[plain:-1] = np.where(beyond, np.log((words[:, 1] + SMOOTHING) / every[1]) - np.log((words[:, 0] + SMOOTHING) / every[0]), 0.0)
    odds[-1] = np.log(totals[1] / totals[0])
    return odds.tolist()


def log_odds(view: str, weights: list[float]) -> Column:
    table = F.array(*[F.lit(w) for w in weights[:-1]])
    return F.aggregate(view, F.lit(weights[-1]), lambda total, f: total + F.get(table, f))


def with_text_odds(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Rows with text_odds, the log odds of the text view."""
    names = [c for c in rows.columns if c not in ("text", "words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(weights)
        content = own[SHAPES:-1]
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            for rows, shapes, words in _text_matrices(batch):
                doc, slot = np.nonzero(words)
                total, used = (np.bincount(doc, w[slot], len(words)) for w in (content, content != 0))
                odds[rows] = own[-1] + own[shapes].sum(axis=1) + total / np.sqrt(1.0 + used)  # words of one text are not independent
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(odds)], names=[*names, "text_odds"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in names) + ", text_odds double"
    return rows.mapInArrow(run, schema)


def calibration(rows: DataFrame, score: Column) -> list[float]:
    """For each bin of a view's log odds the log odds observed on the labels, never falling from bin to bin."""
    counts = np.zeros((CALIBRATION_BINS, 2))
    for r in rows.filter("label is not null").groupBy(_bin(score).alias("b"), "label").count().collect():
        counts[r["b"], r["label"]] = r["count"]
    prior = (counts.sum(axis=0) + SMOOTHING) / (counts.sum() + 2 * SMOOTHING)
    pools: list[list[float]] = []  # positive, all, bins: adjacent bins that would fall are pooled
    for negative, positive in counts:
        pools.append([positive + 2 * prior[1], positive + negative + 2, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [float(np.log(p / (a - p))) for p, a, n in pools for _ in range(int(n))]


def _bin(score: Column) -> Column:
    half = CALIBRATION_BINS // 2
    return F.greatest(F.lit(0), F.least(F.lit(CALIBRATION_BINS - 1), F.floor(score + 0.5).cast("int") + half))


def _calibrated(score: Column, table: list[float]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in table]), _bin(score))


def scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, text_hash and score (0 to 1, that quality is 1) for every document row.

    labels: doc_id, label (1 good, 0 bad; others ignored; of several for one id
    the lowest). Null texts count as empty; null metadata are values of their
    own; columns that docs lack count as null. Without labels of both classes
    every score is 1, so nothing is rejected; where the labels kept apart lack a
    class, all labels fit and calibrate. Rows that repeat id and text have one
    score. An empty table gives no rows.
    """
    for name, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l")).agg(F.min("label").cast("int").alias("label"))
    rows = views(docs)
    rows = rows.join(known, rows["doc_id"] == known["l"], "left").drop("l")
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)).cast("int")), "views")
    classes = {r[0] for r in rows.filter("label is not null").select("label").distinct().collect()}
    if len(classes) < 2:
        return rows.select("doc_id", "text_hash", F.lit(1.0).alias("score"))
    fitted = F.when(F.col("part") >= CALIBRATION, F.col("label"))
    held = rows.filter(F.col("label").isNotNull() & (F.col("part") < CALIBRATION))
    if {r[0] for r in held.select("label").distinct().collect()} != classes or {r[0] for r in rows.select(fitted.alias("y")).filter("y is not null").distinct().collect()} != classes:
        fitted, held = F.col("label"), rows.filter("label is not null")  # too few labels to keep some apart
    sure = float(np.log(confident / (1 - confident)))
    given = lambda score: F.when(score >= sure, 1).when(score <= -sure, 0)
    labelled = F.when(F.col("label").isNotNull(), fitted)
    text_label = meta_label = labelled
    scored = rows
    for _ in range(rounds):
        weights = fit_view(rows, "text", text_label)
        odds = log_odds("meta", fit_view(scored, "meta", meta_label))
        scored = with_text_odds(rows, weights)
        own = with_text_odds(held, weights)
        text = _calibrated(F.col("text_odds"), calibration(own, F.col("text_odds")))
        meta = _calibrated(odds, calibration(held, odds))
        # labels stay as they are, also those kept apart; each view labels the rest for the other
        text_label = F.when(F.col("label").isNotNull(), fitted).otherwise(given(meta))
        meta_label = F.when(F.col("label").isNotNull(), fitted).otherwise(given(text))
    n = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    total = text + meta - float(np.log(n[1] / n[0]))
    return scored.select("doc_id", "text_hash", (1 / (1 + F.exp(-total))).alias("score"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 good) for every document; labels of fold 0 are held out."""
    known = labels.filter(fold_of(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
    out = scores(docs, known)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, columns unchanged.

    Nulls, empty texts, repeated rows and missing labels or metadata are as in
    ``scores``; without labels of both classes all documents stay.
    """
    return filter_docs(docs, scores(docs, labels).filter(F.col("score") < threshold), "left_anti")
