"""Deduplication of repeated byte strings with suffix arrays.

A window is WINDOW bytes of one document. Windows with one anchor (see
``repeats``) form blocks; a sketch of all anchors tells which may repeat, and
only their blocks leave the task. Blocks meet by anchor. Of equal blocks, compared
byte by byte, the earliest goes on; those of the different blocks of an anchor
whose windows have hashes in common are laid end to end, and their suffix array,
built by linear grouping, brings equal windows together.
All but the earliest of equal windows are marked.

Where a passage stands in very many documents, the different blocks at its edges
would gather at one anchor. Anchors of HEAVY occurrences or more therefore send
single windows, which meet by their own hash in all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketlens.llm import repeats
from marketlens.llm.repeats import Anchors, Slice
from marketlens.llm.suffix_array import suffix_array

WINDOW = 100
GRAM = 24
BLOCK_SHARD_BYTES = 4 << 20
DOC_SHARD_BYTES = 8 << 20
#: Block bytes that a task holds before it settles them.
HELD_BYTES = 32 << 20
#: Symbols in one suffix array, unless the blocks of one anchor have more.
ARRAY_SYMBOLS = 1 << 15
#: Occurrences from which the blocks of an anchor are taken apart into windows, and block bytes taken apart at once.
HEAVY = 1 << 13
HEAVY_BYTES = 1 << 20

_NAMES = ["shard", "anchors", "digests", "doc_ids", "text_hashes", "starts", "sizes", "data", "marks_ids", "marks_hashes", "marks_starts", "marks_ends"]
_BLOCKS = "shard long, " + ", ".join(f"{n} binary" for n in _NAMES[1:])
_TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of the data, end to end."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return data[:0]
    index = np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)
    return data[index]


def _earliest_blocks(anchor: np.ndarray, digest: np.ndarray, sizes: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the earliest of equal blocks, by anchor, of those that start later, and of what each of these equals."""
    place = (repeats.doc_rank(ids, hashes) << 32) | starts
    order = np.lexsort((place, sizes, digest, anchor))
    a, d, z, p = anchor[order], digest[order], sizes[order], place[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (z[1:] != z[:-1]))) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    first = np.repeat(at, np.diff(np.concatenate((at, [len(a)]))))
    late = p > p[first]
    return order[at], order[late], order[first[late]]


def _all_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the spans at a and b hold the same bytes, pair by pair, some MB at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // HEAVY_BYTES, prepend=-1, append=-1)) if len(sizes) else np.zeros(0, np.int64)
    return all(np.array_equal(_gathered(data, a[i:j], sizes[i:j]), _gathered(data, b[i:j], sizes[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True))


def _settled_blocks(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, digest: np.ndarray, sizes: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal blocks and the later ones, their bytes compared; where a hash deceived, by another hash."""
    first, later, like = _earliest_blocks(anchor, digest, sizes, ids, hashes, starts)
    if not _all_equal(data, at[later], at[like], sizes[later]):
        strong = np.array([int.from_bytes(hashlib.sha256(data[i : i + n].tobytes()).digest()[:8], "little") for i, n in zip(at.tolist(), sizes.tolist(), strict=True)], np.uint64)
        first, later, _ = _earliest_blocks(anchor, strong, sizes, ids, hashes, starts)
    return first, later


def _with_equals(data: np.ndarray, at: np.ndarray, anchor: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, window: int) -> np.ndarray:
    """The blocks, sorted by anchor, with a window whose hash another window of the anchor has; only these can hold equal windows."""
    if not len(blocks):
        return blocks
    own, lengths = anchor[blocks], sizes[blocks].astype(np.int64)
    groups = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    cuts = groups[np.flatnonzero(np.diff((np.cumsum(lengths) - lengths)[groups] // HEAVY_BYTES, prepend=-1))]  # whole anchors, some MB at a time
    keep = np.zeros(len(blocks), bool)
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
        part = blocks[i:j]
        block, _, _, value = windows_of(_gathered(data, at[part], sizes[part]), sizes[part], window)
        order = np.argsort(value, kind="stable")
        same = np.concatenate(([False], value[order][1:] == value[order][:-1], [False]))
        keep[i + block[order[same[1:] | same[:-1]]]] = True
    return blocks[keep]


def blocks_of(part: Slice, found: Anchors, keep: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in slice, bytes, hash) of the blocks of the kept anchors."""
    low, high = found.low[keep], found.high[keep] + window
    return low, high - low, repeats.span_hashes(part.codes, low, high, repeats._RADIX)


def windows_of(data: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, offset in it, start in data, hash) of every window of blocks laid end to end."""
    counts = sizes.astype(np.int64) - window + 1
    block = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes, dtype=np.int64) - sizes)[block] + offset
    return block, offset, start, repeats.span_hashes(repeats._BYTE_CODE[data], start, start + window, repeats._RADIX)


def later_windows(blocks: list[bytes], places: list[int], window: int) -> Iterator[tuple[int, int]]:
    """(block, offset) of each window that also starts at an earlier place.

    places: for each block where it starts, larger for later documents; equal
    windows are neighbours in the suffix array of the blocks laid end to end.
    """
    sizes = np.array([len(b) for b in blocks])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(blocks), np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[(firsts + sizes)[:-1]] = 0
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    block = np.searchsorted(firsts, order, side="right") - 1
    offset = order - firsts[block]
    valid = offset <= sizes[block] - window
    order, block, offset = order[valid], block[valid], offset[valid]
    if not len(order):
        return
    same = np.zeros(len(order), bool)
    reach = np.arange(window)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        same[a:b] = (raw[order[a:b, None] + reach] == raw[order[a - 1 : b - 1, None] + reach]).all(axis=1)
    run = np.cumsum(~same) - 1
    place = np.array(places, np.int64)[block] + offset
    first = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, run, place)
    late = place > first[run]
    yield from zip(block[late].tolist(), offset[late].tolist(), strict=True)


def _finish(doc_id: int | None, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    parts, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    return doc_id, len(text), int((ends - starts).sum()), len(starts), b"".join(parts) + text[at:]


_finish.types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _finish_digest(doc_id: int | None, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    *row, kept = _finish(doc_id, text, starts, ends)
    return *row, hashlib.sha256(kept).hexdigest()


_finish_digest.types = (*_finish.types[:4], pa.string())


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Remove every byte inside a window-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (bytes, or kept_sha256).
    Documents are ordered by doc_id, null first, then by a hash of the text;
    rows equal in both count as one document and get the same result. A null
    text is empty. Texts shorter than the window stay whole. Overlaps count, and
    strings are judged on the input. An empty table gives no rows.
    """
    total = repeats.text_bytes(docs)
    rows, compare, doc_shards = _passes(docs, total, window, gram, heavy)
    marks = rows.groupBy("shard").applyInArrow(compare, repeats.MARKS)
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")
    return repeats.apply_marks(docs, marks, doc_shards, _finish_digest if digest else _finish, ["doc_id", "n_bytes", "n_removed", "n_spans", last], f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")


def _passes(docs: DataFrame, total: int, window: int, gram: int, heavy: int) -> tuple:
    """The blocks that leave the tasks, what compares those of a shard, and the number of shards of documents."""
    spark = docs.sparkSession
    bits = repeats.sketch_bits(total * 2 / (window - gram + 2))
    rows = repeats.keyed(docs)
    repeated, most = repeats.repeated_and_heavy(rows, "bytes", window, gram, bits, heavy)
    bitmap, most = spark.sparkContext.broadcast(repeated), spark.sparkContext.broadcast(most)
    least = spark.sparkContext.defaultParallelism
    block_shards, doc_shards = repeats.shard_count(total, BLOCK_SHARD_BYTES, least), repeats.shard_count(total, DOC_SHARD_BYTES, 2 * least)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, hashed, ids, hashes, starts, sizes = (np.concatenate(c) for c in list(zip(*held, strict=True))[:6])
        data = np.concatenate([h[6] for h in held])
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        first, later = _settled_blocks(data, at, anchor, hashed, sizes, ids, hashes, starts)
        marks = (ids[later], hashes[later], starts[later], starts[later] + sizes[later])
        apart = np.isin(anchor[first], most.value)
        yield sent((anchor, hashed, ids, hashes, starts, sizes), data, at, first[~apart], marks)
        own = first[apart]  # sorted by anchor, so equal windows are near each other
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[own], dtype=np.int64) // HEAVY_BYTES, prepend=-1, append=-1)).tolist() if len(own) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = own[a:b]
            text = _gathered(data, at[part], sizes[part])
            block, offset, start, value = windows_of(text, sizes[part], window)
            block = part[block]
            begin = (starts[block] + offset).astype(np.int32)
            columns = (repeats.mixed(value), value, ids[block], hashes[block], begin, np.full(len(block), window, np.int32))
            once, again = _settled_blocks(text, start, *columns[:2], columns[5], *columns[2:5])
            again = np.sort(again)
            new = np.flatnonzero(np.concatenate(([True], (block[again][1:] != block[again][:-1]) | (np.diff(begin[again]) != 1)))) if len(again) else again
            last = again[np.concatenate((new[1:] - 1, [len(again) - 1])).astype(np.int64)] if len(again) else again
            new = again[new]
            yield sent(columns, text, start, once, (ids[block[new]], hashes[block[new]], begin[new], begin[last] + np.int32(window)))

    def sent(columns: tuple, data: np.ndarray, at: np.ndarray, first: np.ndarray, marks: tuple) -> pa.RecordBatch:
        anchor, _, ids, hashes, starts, sizes = columns
        first = first[np.lexsort((starts[first], hashes[first], ids[first]))]
        keys = (repeats.mixed(anchor[first]) % np.uint64(block_shards)).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first, keys = first[order], keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist() if len(first) else []
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own, key = first[a:b], int(keys[a])
            out.append((key, *(c[own].tobytes() for c in columns), _gathered(data, at[own], sizes[own]).tobytes(), b"", b"", b"", b""))
        out += [(k, *[b""] * 7, *c) for k, c in repeats.packed(repeats.shard_of(marks[0], marks[1], block_shards), block_shards, *marks)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 12)]], names=_NAMES)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, hashes = repeats.id_order(batch.column("doc_id")), batch.column("text_hash").to_numpy(zero_copy_only=False)
            for part in repeats.slices(batch, "bytes"):
                found = repeats.anchors(part, window, gram)
                keep = repeats.is_repeated(found.hash, bitmap.value, bits)
                if keep.any():
                    low, sizes, hashed = blocks_of(part, found, keep, window)
                    row = found.doc[keep] + part.rows.start
                    held.append((found.hash[keep], hashed, ids[row], hashes[row], (low - part.first[found.doc[keep]]).astype(np.int32), sizes.astype(np.int32), _gathered(part.data, low, sizes)))
                    size += len(held[-1][6])
                    if size >= HELD_BYTES:
                        yield from settle(held)
                        held, size = [], 0
        if size:
            yield from settle(held)

    def compare(table: pa.Table) -> pa.Table:
        read = lambda names, types: [np.concatenate([np.frombuffer(v.as_py(), t) for v in table.column(c)]) for c, t in zip(names, types, strict=True)]
        anchor, hashed, ids, hashes, starts, sizes, data = read(_NAMES[1:8], (*_TYPES, np.uint8))
        own = read(_NAMES[8:], (np.int64, np.int64, np.int32, np.int32))
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        place = (repeats.doc_rank(ids, hashes) << 32) | starts
        first, later = _settled_blocks(data, at, anchor, hashed, sizes, ids, hashes, starts)
        marks = [(ids[later], hashes[later], starts[later], starts[later] + sizes[later])]
        several = np.concatenate(([False], anchor[first][1:] == anchor[first][:-1], [False])) if len(first) else np.zeros(1, bool)
        first = _with_equals(data, at, anchor, sizes, first[several[1:] | several[:-1]], window)
        cuts = np.flatnonzero(np.concatenate(([True], anchor[first][1:] != anchor[first][:-1], [True]))) if len(first) else np.zeros(1, np.int64)

        def marked(chosen: np.ndarray) -> tuple[np.ndarray, ...]:
            text = [data[at[i] : at[i] + sizes[i]].tobytes() for i in chosen]
            found = np.array(list(later_windows(text, place[chosen].tolist(), window)), np.int64).reshape(-1, 2)
            return join_windows(chosen[found[:, 0]], found[:, 1])

        def join_windows(block: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
            """Marked windows that follow each other in a block as one span."""
            order = np.lexsort((offset, block))
            block, offset = block[order], offset[order]
            new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (offset[1:] != offset[:-1] + 1)))) if len(block) else np.zeros(0, np.int64)
            last = np.concatenate((new[1:] - 1, [len(block) - 1])).astype(np.int64) if len(new) else new
            begin, end = starts[block[new]] + offset[new], starts[block[new]] + offset[last] + window
            return ids[block[new]], hashes[block[new]], begin.astype(np.int32), end.astype(np.int32)

        held, symbols = [], 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                held.append(first[a:b])
                symbols += int(sizes[first[a:b]].sum()) + b - a
            if symbols >= ARRAY_SYMBOLS:
                marks.append(marked(np.concatenate(held)))
                held, symbols = [], 0
        if held:
            marks.append(marked(np.concatenate(held)))
        return pa.Table.from_batches([repeats.mark_rows(*(np.concatenate((o, *[m[i] for m in marks])) for i, o in enumerate(own)), doc_shards)])

    return rows.mapInArrow(second_pass, _BLOCKS), compare, doc_shards
