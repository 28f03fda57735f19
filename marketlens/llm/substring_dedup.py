"""Substring deduplication over words, with a count-min prefilter.

A first pass over the texts builds partition sketches of window counts, which
are merged. A second pass takes only windows that the merged sketch estimates
as repeated. Each task first settles what repeats inside its own rows, so that
of a window that is very common only one occurrence per task goes on; these
meet by window hash (96 bits: 64 of the window, 32 of its anchor), and all but the earliest are
marked. Counters only overestimate, so no repeated window is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlens.llm import repeats
from marketlens.llm.repeats import Anchors, Slice

WINDOW = 20
GRAM = 8
#: Text bytes per shard of windows and of documents.
WINDOW_SHARD_BYTES = 16 << 20
DOC_SHARD_BYTES = 8 << 20
#: Windows that a task holds before it settles them.
HELD_WINDOWS = 1 << 20

_CONTEST = "shard long, windows binary, anchors binary, doc_ids binary, text_hashes binary, starts binary, marks_ids binary, marks_hashes binary, marks_starts binary, marks_ends binary"
_NAMES = [c.split()[0] for c in _CONTEST.split(", ")]
_TYPES = (np.uint64, np.uint32, np.int64, np.int64, np.int32)


def _later(windows: np.ndarray, anchor: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window and place; which of the ordered rows are first, and which start after the first of their window."""
    place = (repeats.doc_rank(ids, hashes) << 32) | starts
    order = np.lexsort((place, anchor, windows))
    w, a, p = windows[order], anchor[order], place[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (a[1:] != a[:-1]))) if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    first = np.repeat(p[at], np.diff(np.concatenate((at, [len(w)]))))
    return order[at], order[p > first]


def _runs(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Window starts, joined to spans of words where they follow each other."""
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts = ids[order], hashes[order], starts[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (starts[1:] > starts[:-1] + 1))) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:] - 1, [len(ids) - 1])).astype(np.int64) if len(at) else at
    return ids[at], hashes[at], starts[at], starts[last] + window


def candidate_windows(part: Slice, found: Anchors, keep: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start in slice, window hash, anchor hash, document) of the windows of the kept anchors."""
    counts = (found.high - found.low + 1)[keep]
    total = int(counts.sum())
    step = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.repeat(found.low[keep], counts) + step
    return x, repeats.span_hashes(part.codes, x, x + window, repeats._RADIX), np.repeat(found.hash[keep].astype(np.uint32), counts), np.repeat(found.doc[keep], counts)


def _finish(doc_id: int | None, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words = text.split()
    n, removed = len(words), int((ends - starts).sum())
    if removed:
        kept = np.ones(n, bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept[a:b] = False
        words = list(compress(words, kept.tolist()))
    return doc_id, n, removed, b" ".join(words).decode()


_finish.types = (pa.int64(), pa.int64(), pa.int64(), pa.string())


def _finish_digest(doc_id: int | None, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    *row, kept = _finish(doc_id, text, starts, ends)
    return *row, hashlib.sha256(kept.encode()).hexdigest()


_finish_digest.types = _finish.types


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Remove every word inside a window whose word sequence also starts earlier.

    Returns doc_id, n_words, n_removed and kept_text (or kept_sha256): the words
    that stay, joined by one space. Documents are ordered by doc_id, null first,
    then by a hash of the text; rows equal in both count as one document and get
    the same result. Null texts have no words. Texts of fewer words than the
    window keep them all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    total = repeats.text_bytes(docs)
    bits = repeats.sketch_bits(total / 6 * 2 / (window - gram + 2))
    rows = repeats.keyed(docs)
    bitmap = spark.sparkContext.broadcast(repeats.repeated_bitmap(rows, "words", window, gram, bits))
    least = spark.sparkContext.defaultParallelism
    window_shards, doc_shards = repeats.shard_count(total, WINDOW_SHARD_BYTES, least), repeats.shard_count(total, DOC_SHARD_BYTES, 2 * least)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        windows, anchor, ids, hashes, starts = (np.concatenate(c) for c in zip(*held, strict=True))
        first, later = _later(windows, anchor, ids, hashes, starts)
        first = first[np.lexsort((starts[first], hashes[first], ids[first]))]  # long runs of one document pack well
        out = [(k, *c, b"", b"", b"", b"") for k, c in repeats.packed((windows[first] % np.uint64(window_shards)).astype(np.int64), window_shards, *(c[first] for c in (windows, anchor, ids, hashes, starts)))]
        marks = _runs(ids[later], hashes[later], starts[later].astype(np.int64), window)
        out += [(k, b"", b"", b"", b"", b"", *c) for k, c in repeats.packed(repeats.shard_of(marks[0], marks[1], window_shards), window_shards, marks[0], marks[1], marks[2].astype(np.int32), marks[3].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 10)]], names=_NAMES)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, hashes = repeats.id_order(batch.column("doc_id")), batch.column("text_hash").to_numpy(zero_copy_only=False)
            for part in repeats.slices(batch, "words"):
                found = repeats.anchors(part, window, gram)
                keep = repeats.is_repeated(found.hash, bitmap.value, bits)
                if keep.any():
                    x, w, a, d = candidate_windows(part, found, keep, window)
                    row = d + part.rows.start
                    held.append((w, a, ids[row], hashes[row], (x - part.first[d]).astype(np.int32)))
                    size += len(x)
                    if size >= HELD_WINDOWS:
                        yield from settle(held)
                        held, size = [], 0
        if size:
            yield from settle(held)

    def contest(table: pa.Table) -> pa.Table:
        read = lambda names, types: [np.concatenate([np.frombuffer(v.as_py(), t) for v in table.column(c)]) for c, t in zip(names, types, strict=True)]
        windows, anchor, ids, hashes, starts = read(_NAMES[1:6], _TYPES)
        _, later = _later(windows, anchor, ids, hashes, starts)
        own = read(_NAMES[6:], (np.int64, np.int64, np.int32, np.int32))
        new = _runs(ids[later], hashes[later], starts[later].astype(np.int64), window)
        return pa.Table.from_batches([repeats.mark_rows(*(np.concatenate((a, b)) for a, b in zip(own, new, strict=True)), doc_shards)])

    marks = rows.mapInArrow(second_pass, _CONTEST).groupBy("shard").applyInArrow(contest, repeats.MARKS)
    last = "kept_sha256" if digest else "kept_text"
    return repeats.apply_marks(docs, marks, doc_shards, _finish_digest if digest else _finish, ["doc_id", "n_words", "n_removed", last], f"doc_id long, n_words long, n_removed long, {last} string")
