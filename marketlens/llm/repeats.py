"""What substring and suffix-array deduplication share: windows, anchors and a sketch.

A text is a sequence of tokens (bytes or words). Every window of n tokens has an
anchor, its gram of k tokens with the least hash (the leftmost of equals). Equal
windows have equal anchors, so a window cannot occur more often than its anchor,
and counts of anchors, of which there are 2 / (n - k + 2) a token, bound the
counts of all windows. Arrays are built for slices of some documents at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at once; one longer document is taken alone.
SLICE_BYTES = 1 << 20
#: Low bits of a minimum that hold the position; a slice has fewer tokens.
POSITION_BITS = 31
#: The sketch has DEPTH rows of 2^bits counters, in these limits; 2 rows of 2^28 make bitmaps of 64 MB.
SKETCH_BITS = (18, 28)
DEPTH = 2
#: Counters a token of expected anchors.
SKETCH_LOAD = 4
#: Shards of a row of the sketch, as bits, where it has enough counters.
SHARDS_BITS = 8
#: Anchors that a task counts before it lets them go.
SKETCH_FLUSH = 1 << 20
#: Hashes of a shard of the filter, about, and the shards as bits, at least and at most.
FILTER_SHARD = 1 << 22
FILTER_SHARDS_BITS = (3, 12)
#: Bits of the filter at most: 64 MB.
FILTER_BITS = 29
#: Bits of a hash beside those of its shard that are compared.
FILTER_HASH_BITS = 32
#: Heavy anchors are summed from the flushes that have them this often.
TASK_COUNT = 64

_U = np.uint64
_RADIX, _RADIX2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(radix: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, radix, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(radix: np.uint64, n: int) -> np.ndarray:
    """radix^0 .. radix^(n-1) modulo 2^64; tables up to some slices long are kept."""
    key = int(radix)
    if key not in _CACHE or len(_CACHE[key]) < n:
        table = _powers(radix, max(n, 1 << 16))
        if n > 4 * SLICE_BYTES:
            return table[:n]
        _CACHE[key] = table
    return _CACHE[key][:n]


def inverse(radix: np.uint64) -> np.uint64:
    return _U(pow(int(radix), -1, 1 << 64))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, radix: np.uint64) -> np.ndarray:
    """A hash of codes[start:end] for each span, from one running sum of codes times powers."""
    run = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * powers(radix, len(codes)), out=run[1:])
    back = powers(inverse(radix), len(codes) + 1)
    return mixed((run[ends] - run[starts]) * back[starts])


@dataclass
class Slice:
    """Some documents as one run of tokens; document i has tokens first[i]:first[i + 1]."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each value; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, tokens: str, column: str = "text", fold: np.ndarray | None = None) -> Iterator[Slice]:
    """Cut a batch into slices; tokens: 'bytes' or 'words'; fold: what each byte is read as."""
    data, offsets = flat(batch.column(column))
    data = data if fold is None else fold[data]
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        own, part = offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        yield _byte_slice(range(at, to), part, own) if tokens == "bytes" else _word_slice(range(at, to), part, own)
        at = to


def _byte_slice(rows: range, data: np.ndarray, offsets: np.ndarray) -> Slice:
    return Slice(rows, data, offsets, _BYTE_CODE[data], offsets)


def _word_slice(rows: range, data: np.ndarray, offsets: np.ndarray) -> Slice:
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~SPACE[data]
    opens, closes = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] |= inner[1:-1][cuts]
    closes[cuts - 1] |= inner[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    codes = span_hashes(_BYTE_CODE[data], starts, ends, _RADIX) if len(starts) else np.zeros(0, _U)
    return Slice(rows, data, offsets, mixed(codes + (ends - starts).astype(_U)), np.searchsorted(starts, offsets), starts, ends)


@dataclass
class Anchors:
    """Runs of windows with one anchor: windows low..high (first tokens) share the gram at ``at``."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def anchors(part: Slice, window: int, gram: int) -> Anchors:
    """The anchors of all windows of a slice, document by document."""
    n, span = len(part.codes), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return Anchors(none, none, none, none.astype(_U), none)
    starts = np.arange(n - gram + 1)
    grams = span_hashes(part.codes, starts, starts + gram, _RADIX2)
    low = (grams >> _U(POSITION_BITS) << _U(POSITION_BITS)) | starts.astype(_U)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
    at = (low & _U((1 << POSITION_BITS) - 1)).astype(np.int64)  # for each window of the slice
    sizes = np.diff(part.first)
    whole = sizes >= window
    lengths = np.where(whole, sizes - window + 1, 0)
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, part.first[:-1][whole], 1)
    np.add.at(ok, (part.first[:-1] + lengths)[whole], -1)
    x = np.flatnonzero(np.cumsum(ok)[: n - window + 1])
    if not len(x):
        return Anchors(none, none, none, none.astype(_U), none)
    new = np.flatnonzero(np.concatenate(([True], (at[x[1:]] != at[x[:-1]]) | (np.diff(x) > 1))))
    first, last = x[new], x[np.concatenate((new[1:] - 1, [len(x) - 1]))]
    doc = np.searchsorted(part.first, first, side="right") - 1
    return Anchors(first, last, at[first], grams[at[first]], doc)


# --- the sketch ------------------------------------------------------------


def sketch_bits(anchors_expected: float) -> int:
    """Counters grow with the anchors of the table, up to the largest bitmap that is broadcast."""
    low, high = SKETCH_BITS
    return int(min(high, max(low, np.ceil(np.log2(max(1.0, anchors_expected * SKETCH_LOAD))))))


def buckets(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The counter of each anchor in a row of the sketch."""
    return ((hashes if row == 0 else mixed(hashes + _U(row))) >> _U(64 - bits)).astype(np.uint32)


def shard_bits(bits: int) -> int:
    return min(SHARDS_BITS, bits - 3)


def _heavy(hashes: np.ndarray, heavy: int, parts: int, first: int) -> list[tuple[int, bytes, bytes]]:
    """Rows of the hashes that may be heavy over all partitions, with their counts, in shards from ``first`` on."""
    values, counts = np.unique(hashes, return_counts=True)
    many = counts >= max(1, min(TASK_COUNT, heavy // 16))
    values, counts = values[many], counts[many]
    shards = (mixed(values) >> _U(64 - parts)).astype(np.int64)
    return [(first + k, values[shards == k].tobytes(), counts[shards == k].astype(np.int64).tobytes()) for k in np.unique(shards).tolist()]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]], heavy: int) -> tuple[bytes, bytes]:
    """The hashes of a shard that are heavy over all partitions, and their counts."""
    values, at = np.unique(np.concatenate([v for v, _ in lists]), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([c for _, c in lists])).astype(np.int64)
    return values[sums >= heavy].tobytes(), sums[sums >= heavy].tobytes()


def _sorted_heavy(most: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, sums = np.concatenate([np.zeros(0, _U), *most]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(values)
    return values[order], sums[order]


def _flushes(batches: Iterator[pa.RecordBatch], tokens: str, hashes_of: Callable[[Slice], np.ndarray], fold: np.ndarray | None) -> Iterator[np.ndarray]:
    """The hashes of all slices, SKETCH_FLUSH or some more at a time."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, tokens, fold=fold):
            held.append(hashes_of(part))
            size += len(held[-1])
            if size >= SKETCH_FLUSH:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _counted(hashes: np.ndarray, bits: int, heavy: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A partition sketch, sparse: by shard, the counters at 1 and those at 2 or more.

    With heavy, also the hashes that may reach it over all partitions, with their counts, in shards behind those.
    """
    parts, rows = shard_bits(bits), []
    cut = bits - parts
    for row in range(depth):
        values, counts = np.unique(buckets(hashes, bits, row), return_counts=True)
        bounds = np.searchsorted(values, np.arange((1 << parts) + 1, dtype=np.uint64) << np.uint64(cut))
        for shard in range(1 << parts):
            own, often = values[bounds[shard] : bounds[shard + 1]] & np.uint32((1 << cut) - 1), counts[bounds[shard] : bounds[shard + 1]] > 1
            if len(own):
                rows.append((row << parts | shard, own[~often].tobytes(), own[often].tobytes()))
    if heavy:
        rows += _heavy(hashes, heavy, parts, depth << parts)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "once", "often"])


def repeated_bitmap(docs: DataFrame, tokens: str, window: int, gram: int, bits: int) -> np.ndarray:
    return repeated_and_heavy(docs, tokens, window, gram, bits, 0)[0]


def repeated_and_heavy(docs: DataFrame, tokens: str, window: int, gram: int, bits: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of the anchors of all windows, and those that occur ``heavy`` times or more; see ``sketched``."""
    bitmap, most, _ = sketched(docs, tokens, lambda part: anchors(part, window, gram).hash, bits, heavy)
    return bitmap, most


def sketched(docs: DataFrame, tokens: str, hashes_of: Callable[[Slice], np.ndarray], bits: int, heavy: int, depth: int = DEPTH, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged count-min sketch as a bitmap for each row: bit b is set if counter b is 2 or more.

    Each task counts the hashes of its slices in a sketch of its own; the
    sketches are added shard by shard. Counters only overestimate, so what is
    repeated always has its bits set. The bitmaps have 64 MB together at most.

    Second and third, sorted, the hashes counted ``heavy`` times or more (0: none)
    and their counts. Counts under TASK_COUNT in one flush of a task are left out
    of the sum.
    """

    parts = shard_bits(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in _flushes(batches, tokens, hashes_of, fold):
            yield from _counted(hashes, bits, heavy, depth)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        often_seen: dict[int, list] = {}
        for batch in batches:
            for shard, once, often in zip(batch.column("shard").to_pylist(), batch.column("once"), batch.column("often"), strict=True):
                if shard >= depth << parts:
                    often_seen.setdefault(shard, []).append((np.frombuffer(once.as_py(), _U), np.frombuffer(often.as_py(), np.int64)))
                    continue
                own = counters.setdefault(shard, np.zeros(1 << (bits - parts), np.uint8))
                one, two = np.frombuffer(once.as_py(), np.uint32), np.frombuffer(often.as_py(), np.uint32)
                own[one] += own[one] < 2  # each value is in a partition's list once
                own[two] = 2
        for shard, lists in often_seen.items():
            values, sums = _summed(lists, heavy)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([values], pa.binary()), pa.array([sums], pa.binary())], names=["shard", "bits", "counts"])
        for shard, own in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(own >= 2).tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["shard", "bits", "counts"])

    tasks = min(depth << parts, max(8, 1 << max(0, bits - 20)))  # counters in a task stay within some MB
    sketches = docs.select("text").mapInArrow(count, "shard int, once binary, often binary").repartition(tasks, "shard")
    merged = sketches.mapInArrow(merge, "shard int, bits binary, counts binary").collect()  # a row a shard, 64 MB together at most
    out = np.zeros((depth << parts, 1 << (bits - parts - 3)), np.uint8)
    most, counts = [], []
    for row in merged:
        if row["shard"] < depth << parts:
            out[row["shard"]] = np.frombuffer(row["bits"], np.uint8)
        else:
            most.append(np.frombuffer(row["bits"], _U))
            counts.append(np.frombuffer(row["counts"], np.int64))
    return out.reshape(depth, -1), *_sorted_heavy(most, counts)


def is_repeated(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which anchors have an estimated count of 2 or more: the least counter over the rows."""
    out = np.ones(len(hashes), bool)
    for row in range(len(bitmap)):
        bucket = buckets(hashes, bits, row).astype(np.int64)
        out &= (bitmap[row, bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)
    return out


# --- repeats counted one by one ----------------------------------------------


@dataclass
class Filter:
    """A Bloom filter in 2^parts shards by the first bits of a hash, of two bits a hash."""

    bits: np.ndarray
    parts: int

    @property
    def width(self) -> int:
        """Bits of a shard, as a power of 2."""
        return self.bits.shape[1].bit_length() + 2

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are in the filter, all that were put in among them."""
        shard, value = _cut(hashes, self.parts)
        out = np.ones(len(hashes), bool)
        for at in _places(value, self.width):
            out &= (self.bits[shard, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _cut(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash and the FILTER_HASH_BITS that follow."""
    return (hashes >> _U(64 - parts)).astype(np.int64), (hashes >> _U(64 - parts - FILTER_HASH_BITS)).astype(np.uint32)


def _places(values: np.ndarray, width: int) -> list[np.ndarray]:
    spread = mixed(values.astype(_U) + _U(1))
    return [(x & _U((1 << width) - 1)).astype(np.int64) for x in (spread, spread >> _U(32))]


def repeated_filter(docs: DataFrame, tokens: str, hashes_of: Callable[[Slice], np.ndarray], expected: float, heavy: int, fold: np.ndarray | None = None) -> tuple[Filter, np.ndarray, np.ndarray]:
    """A filter that holds every hash that occurs more than once, and the heavy hashes with their counts as of ``sketched``.

    The hashes themselves are shuffled, some four bytes each, and those that
    occur once are left out by comparing 32 bits and more. So what passes by
    mistake depends on how many are repeated and not on how many there are.
    """
    low, high = FILTER_SHARDS_BITS
    parts = int(min(high, max(low, np.ceil(np.log2(max(1.0, expected / FILTER_SHARD))))))
    width = min(FILTER_BITS, sketch_bits(expected) + 1) - parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in _flushes(batches, tokens, hashes_of, fold):
            hashes = np.sort(hashes)
            shard, value = _cut(hashes, parts)
            again = np.zeros(len(hashes), bool)
            again[2:] = (shard[2:] == shard[:-2]) & (value[2:] == value[:-2])  # twice is enough
            shard, value = shard[~again], value[~again]
            bounds = np.searchsorted(shard, np.arange((1 << parts) + 1))
            # byte by byte, as the first bytes of sorted values compress
            rows = [(k, value[a:b].view(np.uint8).reshape(-1, 4).T.tobytes(), None) for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)) if a < b]
            rows += _heavy(hashes, heavy, parts, 1 << parts) if heavy else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "hashes", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, hashes, counts in zip(batch.column("shard").to_pylist(), batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if shard >> parts:
                    held.setdefault(shard, []).append((np.frombuffer(hashes, _U), np.frombuffer(counts, np.int64)))
                else:
                    held.setdefault(shard, []).append(np.ascontiguousarray(np.frombuffer(hashes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel())
        for shard in sorted(held):
            lists, counts = held.pop(shard), None
            if shard >> parts:
                found, counts = _summed(lists, heavy)
            else:
                values = np.concatenate(lists)
                values.sort()
                own = np.zeros(1 << width, bool)
                for at in _places(values[1:][values[1:] == values[:-1]], width):
                    own[at] = True
                found = np.packbits(own).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([found], pa.binary()), pa.array([counts], pa.binary())], names=["shard", "bits", "counts"])

    rows = docs.select("text").mapInArrow(cut, "shard int, hashes binary, counts binary").repartitionById(1 << parts, F.pmod("shard", F.lit(1 << parts)))
    merged = rows.mapInArrow(merge, "shard int, bits binary, counts binary").collect()  # a row a shard, 64 MB together at most
    out, most, sums = np.zeros((1 << parts, 1 << (width - 3)), np.uint8), [], []
    for row in merged:
        if row["shard"] >> parts:
            most.append(np.frombuffer(row["bits"], _U))
            sums.append(np.frombuffer(row["counts"], np.int64))
        else:
            out[row["shard"]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out, parts), *_sorted_heavy(most, sums)


# --- marks and their way back to the documents ------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text: a document row is known by its id and text, and ordered so."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def id_order(column: pa.Array) -> np.ndarray:
    """doc_id as int64; null stands before every other."""
    return pc.fill_null(column, -(1 << 63)).to_numpy(zero_copy_only=False)


def doc_rank(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The rank of each (doc_id, text_hash) in order, equal for equal pairs."""
    order = np.lexsort((hashes, ids))
    i, h = ids[order], hashes[order]
    out = np.zeros(len(ids), np.int64)
    out[order[1:]] = np.cumsum((i[1:] != i[:-1]) | (h[1:] != h[:-1]))
    return out


def shard_of(doc_ids: np.ndarray, text_hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(doc_ids.astype(_U) * _RADIX + text_hashes.astype(_U)) % _U(shards)).astype(np.int64)


def packed(keys: np.ndarray, shards: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of the columns by key, each column as bytes; rows of a key stay in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(shards + 1)) if shards < len(keys) else None
    if bounds is None:
        values, first = np.unique(keys[order], return_index=True)
        spans = zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)
    else:
        spans = ((k, int(bounds[k]), int(bounds[k + 1])) for k in range(shards) if bounds[k] < bounds[k + 1])
    for key, a, b in spans:
        yield key, [c[order[a:b]].tobytes() for c in columns]


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that touch or overlap joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.concatenate((at[1:] - 1, [len(ends) - 1]))] if len(at) else ends


MARKS = "shard long, doc_ids binary, text_hashes binary, starts binary, ends binary"


def mark_rows(doc_ids: np.ndarray, text_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, shards: int) -> pa.RecordBatch:
    """Marked spans of tokens, a row for each shard of documents."""
    rows = list(packed(shard_of(doc_ids, text_hashes, shards), shards, doc_ids, text_hashes, starts.astype(np.int32), ends.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[1][i] for r in rows], pa.binary()) for i in range(4)]],
        names=["shard", "doc_ids", "text_hashes", "starts", "ends"],
    )


def apply_marks(docs: DataFrame, marks: DataFrame, shards: int, finish: Callable, names: list[str], schema: str) -> DataFrame:
    """Bring the marks to their documents and finish each: finish(doc_id, text bytes, starts, ends) -> row.

    Documents and marks meet by shard, of which there are enough for a few MB
    of text in each; a shard that is large has large documents.
    """

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = [np.concatenate([np.frombuffer(v.as_py(), t) for v in right.column(c)] or [np.zeros(0, t)]) for c, t in (("doc_ids", np.int64), ("text_hashes", np.int64), ("starts", np.int32), ("ends", np.int32))]
        order = np.lexsort((spans[1], spans[0]))
        ids, hashes, starts, ends = (s[order] for s in spans)
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))) if len(ids) else np.zeros(0, np.int64)
        of = {(int(ids[a]), int(hashes[a])): (a, b) for a, b in zip(new, [*new[1:], len(ids)], strict=len(ids) > 0)}
        rows = []
        for doc_id, text_hash, text in zip(left.column("doc_id"), left.column("text_hash"), left.column("text"), strict=True):
            doc_id = doc_id.as_py()
            a, b = of.get((-(1 << 63) if doc_id is None else doc_id, text_hash.as_py()), (0, 0))
            s, e = merged_spans(starts[a:b].astype(np.int64), ends[a:b].astype(np.int64))
            rows.append(finish(doc_id, text.as_buffer().to_pybytes(), s, e))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(finish.types)], names=names)

    # the shard of a row, by the same rule as in mark_rows
    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = shard_of(id_order(batch.column("doc_id")), batch.column("text_hash").to_numpy(zero_copy_only=False), shards)
            yield pa.RecordBatch.from_arrays([pa.array(of), *batch.columns], names=["shard", *batch.schema.names])

    left = keyed(docs).mapInArrow(sharded, "shard long, doc_id long, text_hash long, text string")
    return left.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(join, schema)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def shard_count(total: int, shard_bytes: int, least: int) -> int:
    return max(least, -(-total // shard_bytes))
