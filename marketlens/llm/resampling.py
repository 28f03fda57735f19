"""Importance resampling towards a target distribution of hashed n-grams.

Words and pairs of words of all documents and of the target texts are counted in
hash buckets. A document weighs as much as its features are likelier in the
target than in the corpus, Gumbel noise from a hash of its id is added, and the
highest scores are drawn, which draws without replacement by weight.

A batch of texts is joined with sentinels. One pass of the pattern finds the
words and sentinels of the whole batch; a binary search in the sentinels' places
gives the text of each word, and pairs across a sentinel are masked before the
buckets are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import written

#: No byte of any UTF-8 text.
SENTINEL = b"\xff"
#: Words (digits, lowered letters, all bytes of other characters) and sentinels; on bytes the same as the pattern on characters.
TOKENS = re.compile(rb"[0-9a-z\x80-\xf4]+|\xff")
BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
#: Bytes of texts that are joined at once, or one longer text.
JOINED_BYTES = 4 << 20


#: Longest word whose pairs are hashed from the words' own sums.
SHORT = 63


def zeros_appended() -> np.ndarray:
    """[n, k, b]: what byte k of value b of a CRC-32 adds to it once n zero bytes have followed; the sum is linear in its bits."""
    step = np.arange(256, dtype=np.int64)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ 0xEDB88320, step >> 1)
    rows = [np.arange(256, dtype=np.int64)[None, :] << np.array([0, 8, 16, 24])[:, None]]
    for _ in range(SHORT):
        rows.append((rows[-1] >> 8) ^ step[rows[-1] & 255])
    return np.stack(rows)


APPENDED = zeros_appended()


def followed(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs after ``by`` zero bytes: crc32(a + b) is this of crc32(a) and len(b), xor crc32(b)."""
    return APPENDED[by, 0, crc & 255] ^ APPENDED[by, 1, crc >> 8 & 255] ^ APPENDED[by, 2, crc >> 16 & 255] ^ APPENDED[by, 3, crc >> 24]


def batch_features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text of each feature, bucket of each feature), features being words and pairs within a text."""
    tokens = TOKENS.findall(SENTINEL.join(texts).lower())  # bytes: A-Z only
    offsets, at = [], -1
    for _ in texts[1:]:
        at = tokens.index(SENTINEL, at + 1)
        offsets.append(at)
    n = len(tokens)
    doc = np.searchsorted(np.array(offsets, np.int64), np.arange(n), side="right")
    word = np.ones(n, bool)
    word[offsets] = False
    crc, size = np.fromiter(map(crc32, tokens), np.int64, n), np.fromiter(map(len, tokens), np.int64, n)
    pair = np.flatnonzero(word[1:] & word[:-1])  # both of one text
    one = np.ones(len(pair), np.int64)
    two = followed(followed(crc[pair], one) ^ crc32(b" "), np.minimum(size[pair + 1], SHORT)) ^ crc[pair + 1]
    for i in np.flatnonzero(size[pair + 1] > SHORT).tolist():
        two[i] = crc32(tokens[pair[i]] + b" " + tokens[pair[i] + 1])
    return np.bincount(doc[word], minlength=len(texts)), np.concatenate([doc[word], doc[pair]]), np.concatenate([crc[word], two]) % buckets


def joined_texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about JOINED_BYTES; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + JOINED_BYTES, side="right")))
        yield at, [t or b"" for t in column.slice(at, upto - at).cast(pa.binary()).to_pylist()]
        at = upto


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over a table's ``text``: each task sums its own rows, a shuffle of at most ``buckets`` rows a task adds them up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, run in joined_texts(batch.column(0)):
                total += np.bincount(batch_features(run, buckets)[2], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log likelihood ratio) of each bucket, target against corpus, both smoothed by one.

    What comes to the driver is a row per bucket, whatever the size of the corpus.
    """
    both = bucket_counts(corpus, buckets).withColumn("side", F.lit(0)).union(bucket_counts(target, buckets).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for r in both.collect():
        counts[r["side"], r["bucket"]] = r["n"]
    (s, t), (s_all, t_all) = counts, counts.sum(axis=1)
    ratio = (t + 1.0) * float(s_all + buckets) / ((s + 1.0) * float(t_all + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * standard Gumbel noise), from 32 bits of SHA-256 of seed and id; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in joined_texts(batch.column("text")):
                words, doc, bucket = batch_features(run, len(gain))
                n = np.bincount(doc, minlength=len(run))
                total = np.zeros(len(run), np.int64)
                np.add.at(total, doc, gain[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)  # // floors
                columns = [batch.column("doc_id").slice(at, len(run)), pa.array(words), pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(rows: DataFrame, fits: Column, draws: int) -> DataFrame:
    """rows with ``rank``: 1, 2, 3... for the ``draws`` highest scores among those that fit, null for the others.

    A histogram of scores (a row per distinct score, some ten thousand at any
    size) gives the lowest score drawn. Only rows from there up are sorted, by
    ranges of score, id and row, so equal scores and ids are split as well; a
    row's rank is its place in its range and the sizes of the ranges before.
    """
    fits = F.coalesce(fits, F.lit(False))
    levels = rows.filter(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    lowest = levels.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < draws).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if lowest is None:
        return rows.withColumn("rank", none)
    high = fits & (F.col("score") >= lowest)
    place = F.monotonically_increasing_id()  # the partition in the bits from 33 up, the place in it below
    best = rows.filter(high).repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = best.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "row").withColumn("place", place)
    best = written(best.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}), "drawn")
    sizes = best.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # one row per range
    before, at = {}, 0
    for r in sizes:
        before[r["range"]], at = at, at + r["n"]
    starts = rows.sparkSession.createDataFrame(list(before.items()), "r long, before long")
    best = best.join(F.broadcast(starts), F.col("range") == F.col("r")).withColumn("rank", F.col("before") + F.col("place") + 1)
    best = best.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return best.select(*rows.columns, "rank").union(rows.filter(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    floor(percent * N / 100) of the N documents with at least ``min_words``
    words are drawn. Null and empty texts have no features, weight 0 and a score,
    and are never drawn while min_words is above 0; texts of any length are read
    whole. Documents that share an id share their noise; equal scores go by id
    (null ids last), rows equal in both in any order. An empty table gives no
    rows; an empty target makes all words unlikely in the same measure. Other
    columns, whatever their names, are not looked at.
    """
    rows = scored(docs, gains(docs, target, buckets), seed)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    fits = F.col("n_words") >= min_words
    draws = percent * rows.filter(fits).count() // 100
    return ranked(rows, fits, draws).drop("row")
