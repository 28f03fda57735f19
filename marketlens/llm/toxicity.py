"""Toxicity by class-conditional Kneser-Ney models over bytes.

One model is fitted to toxic documents and one to ordinary ones. Both discount
their own counts of a byte after its context and back off to one distribution:
the Kneser-Ney continuation counts of the shorter contexts over both classes
together, so that what is rare in both says little. A context too rare to tell
the classes apart leaves the byte to a shorter one. A document's score is the
difference of the two log-likelihoods by length, made a probability on labelled
documents that neither model has seen. Counts are of documents: a gram that one
document repeats counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import repeats

ORDER = 5
DISCOUNT = 0.75
#: Shortest grams that a sparse longer one backs off to.
LEAST_ORDER = 2
#: Grams seen in fewer documents say nothing of their own, unless their counts are significant.
LEAST_COUNT = 10
#: A ratio is significant beyond as many standard deviations of what the classes' sizes explain.
DEVIATIONS = 3.0
#: The length of a gram stands above its bytes.
_LENGTH_SHIFT = 48
#: Labelled documents per class that the models and the calibration are fitted to, chosen by a hash of the id.
TRAIN_DOCS = 20_000
#: Share of those, in fifths, that calibrates.
CALIBRATION = 1
#: Distinct grams that a task counts before it lets them go.
FLUSH = 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(range(0x09, 0x0E))] = 32


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the `order` bytes that end there, as one number; before a text stand spaces."""
    out = data.astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:]
    for j in range(1, order):
        before = np.full(len(data), 32, np.uint8)
        before[j:] = data[:-j]
        for t in range(j):
            at = starts + t
            before[at[at < ends]] = 32
        out |= before.astype(np.int64) << (8 * j)
    return out


def tagged(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of each gram, marked with n."""
    return keys & ((1 << (8 * n)) - 1) | n << _LENGTH_SHIFT


@dataclass
class Model:
    """Grams in order with the log ratio of their class probabilities; a score x becomes 1 / (1 + exp(-(slope x + shift)))."""

    grams: np.ndarray
    ratios: np.ndarray
    slope: float = 0.0
    shift: float = 0.0

    def ratio(self, data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
        """The difference of log-likelihoods of each text, divided by its length; 0 for an empty one."""
        total = np.zeros(len(data) + 1)
        if len(data) and len(self.grams):
            key, value = grams(data, offsets, order), np.zeros(len(data))
            left = np.arange(len(data))
            for n in range(order, LEAST_ORDER - 1, -1):  # the longest gram that says something
                own = tagged(key[left], n)
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                found = self.grams[at] == own
                value[left[found]] = self.ratios[at[found]]
                left = left[~found]
            np.cumsum(value, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _sums(groups: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(groups, weights, n).astype(np.float64)


def continuation(keys: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of the last byte after the others, from continuation counts."""
    if order == 1:
        return (counts + 1) / (counts.sum() + 256)
    contexts, of = np.unique(keys >> 8, return_inverse=True)
    total, types = _sums(of, counts, len(contexts)), _sums(of, None, len(contexts))
    shorter, low = np.unique(keys & ((1 << (8 * (order - 1))) - 1), return_inverse=True)
    below = continuation(shorter, _sums(low, None, len(shorter)), order - 1)
    return np.maximum(counts - DISCOUNT, 0) / total[of] + DISCOUNT * types[of] / total[of] * below[low]


def fit_ratios(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, least: int = LEAST_COUNT, deviations: float = DEVIATIONS) -> Model:
    """Log ratios of the class models for tagged grams that say something; 0 for those whose ratio is not significant."""
    found, ratios = [keys[:0]], [np.zeros(0)]
    for n in range(LEAST_ORDER, order + 1):
        own = keys >> _LENGTH_SHIFT == n
        if toxic[own].any() and ordinary[own].any():
            at, ratio = _order_ratios(keys[own] & ((1 << _LENGTH_SHIFT) - 1), toxic[own], ordinary[own], n, least, deviations)
            found.append(tagged(at, n))
            ratios.append(ratio)
    return Model(np.concatenate(found), np.concatenate(ratios))


def _order_ratios(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, least: int, deviations: float) -> tuple[np.ndarray, np.ndarray]:
    shorter, low = np.unique(keys & ((1 << (8 * (order - 1))) - 1), return_inverse=True)
    shared = continuation(shorter, _sums(low, None, len(shorter)), order - 1)[low]
    contexts, of = np.unique(keys >> 8, return_inverse=True)
    logs, totals = [], []
    for counts in (toxic, ordinary):
        total, types = _sums(of, counts, len(contexts)), _sums(of, counts > 0, len(contexts))
        seen = total > 0
        rest = np.where(seen, DISCOUNT * types / np.maximum(total, 1), 1.0)
        own = np.where(seen[of], np.maximum(counts - DISCOUNT, 0) / np.maximum(total[of], 1), 0.0)
        logs.append(np.log(own + rest[of] * shared))
        totals.append(total[of])
    part = totals[0] / (totals[0] + totals[1])
    expected = (toxic + ordinary) * part
    significant = np.abs(toxic - expected) > deviations * np.sqrt(expected * (1 - part) + 0.5)
    keep = significant | ((toxic + ordinary >= least) & (totals[0] > 0) & (totals[1] > 0))
    return keys[keep], np.where(significant, logs[0] - logs[1], 0.0)[keep]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a little shrinkage, on a bounded sample of scores."""
    scale = max(float(np.sqrt((x * x).mean())), 1e-12)
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - np.array([1e-2, 1e-4]) * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _pair_counts(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            toxic = keys & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(np.where(toxic, n, 0)), pa.array(np.where(toxic, 0, n))], names=["gram", "toxic", "ordinary"])

        size = 0
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in repeats.slices(batch, "bytes", fold=_FOLD):
                own = np.repeat(label[part.rows.start : part.rows.stop], np.diff(part.offsets))
                every, doc = grams(part.data, part.offsets, order), np.repeat(np.arange(len(part.rows)), np.diff(part.offsets))
                for n in range(LEAST_ORDER, order + 1):
                    keys = tagged(every, n) << 1 | own
                    at = np.lexsort((keys, doc))
                    keys, of = keys[at], doc[at]
                    held.append(keys[np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])))] if len(keys) else keys)
                    size += len(held[-1])
                if size >= FLUSH:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return count


def _scores(model, order: int, finish):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.ratio(p.data, p.offsets, order) for p in repeats.slices(batch, "bytes", fold=_FOLD)]
            yield finish(batch, np.concatenate(parts) if parts else np.zeros(0))

    return score


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label, part) of at most about ``most`` labelled documents per class, and the share taken of each class."""
    own = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = {c: min(1.0, most / n) for c, n in counts.items()}
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    take = F.lit(False)
    for c, s in share.items():
        take = take | ((F.col("label") == c) & (lot < s))
    chosen = own.filter(take).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int"))
    # two classes of about `most` ids each: a bounded side
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), share


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int = TRAIN_DOCS) -> Model:
    """Fit both models and the calibration. labels: doc_id, label (1 toxic, 0 ordinary; others ignored)."""
    rows, share = training_rows(docs, labels, most)
    counted = rows.filter(F.col("part") >= CALIBRATION).select("text", "label").mapInArrow(_pair_counts(order), "gram long, toxic long, ordinary long")
    counted = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).orderBy("gram").toArrow()  # bounded by the sample
    column = lambda c: counted.column(c).to_numpy()
    model = fit_ratios(column("gram"), column("toxic").astype(np.float64), column("ordinary").astype(np.float64), order)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def finish(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(x)], names=["label", "x"])

    held = rows.filter(F.col("part") < CALIBRATION).select("text", "label").mapInArrow(_scores(sent, order, finish), "label int, x double").toArrow()
    y, x = held.column("label").to_numpy().astype(np.float64), held.column("x").to_numpy()
    if len(np.unique(y)) == 2:
        weight = np.where(y == 1, 1 / share[1], 1 / share[0])
        model.slope, model.shift = fit_logistic(x, y, weight)
    else:  # too few labels to calibrate: the sign of the ratio decides
        model.slope, model.shift = 1.0, 0.0 if len(model.grams) else -1.0
    return model


def score(docs: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """doc_id and score (0 to 1) for every row, from the text alone; null and empty texts get the score of a ratio of 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def finish(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(sent, order, finish), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels come only from rows whose fold (crc32 of the id as text, modulo 5) is
    not 0; labels, lang, source and ids are no inputs of a score. Without labels
    of both classes no document is predicted toxic. Rows that repeat an id are
    each scored by their own text. An empty table gives no rows.
    """
    known = labels.filter(fold_of(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs, fit(docs, known, order, most), order)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
