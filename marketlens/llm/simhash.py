"""SimHash near-duplicates, found with BK-trees.

Fingerprints are 64 bits; two link where at most RADIUS bits differ. Cut into
RADIUS + 1 or more blocks, two linked fingerprints agree on all but RADIUS of
them, so they meet in a shard keyed by one choice of agreeing blocks. Each
shard has a BK-tree: the children of a node are keyed by their Hamming distance
to it, and a search follows only edges within the radius of its own distance.
A tree travels to the queries of its shard by that key; the trees of all shards
together grow with the corpus, so they are never broadcast as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import bitmap_docs, doc_key, filter_docs, same_doc, settled
from marketlens.operators.components import components, join_hot

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in one tree at most; larger shards are cut and each pair of cuts is searched.
TREE_NODES = 20_000
#: A shard holds about this many fingerprints; sets the number of blocks.
SHARD_NODES = 64
#: Rows up to which the documents that may go are broadcast.
BROADCAST_DOCS = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over XXH64 of the word shingles of a whole text, as a signed long; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8").astype(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; a null text counts as empty."""
    return doc_key(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "text").mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


class BkTree:
    """A BK-tree that also keeps which of its entries are connected by links."""

    def __init__(self, radius: int) -> None:
        self.radius, self.values, self.children, self.parent = radius, [], [], []

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, value: int) -> list[int]:
        """Insert; returns one linked entry of each component that the value newly joins.

        Below a node that is linked itself, children with an edge within the
        radius are linked to that node, so they need no visit.
        """
        new, radius, values, children = len(self.values), self.radius, self.values, self.children
        links = []
        self.parent.append(new)
        if new:
            stack = [0]
            while stack:
                node = stack.pop()
                distance = (value ^ values[node]).bit_count()
                low = distance - radius
                if low <= 0:
                    a, b = self._root(new), self._root(node)
                    if a != b:
                        self.parent[a] = b
                        links.append(values[node])
                    low = radius + 1
                for edge, child in children[node].items():
                    if low <= edge <= distance + radius:
                        stack.append(child)
            node = 0
            while True:
                distance = (value ^ values[node]).bit_count()
                below = children[node].get(distance)
                if below is None:
                    children[node][distance] = new
                    break
                node = below
        values.append(value)
        children.append({})
        return links


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            a, b = [], []
            for *key, value in zip(*(batch.column(c).to_pylist() for c in ("part", "masked", "cut", "fp")), strict=True):
                if key != shard:
                    shard, tree = key, BkTree(radius)
                for other in tree.add(value & 0xFFFFFFFFFFFFFFFF):
                    a.append(value)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.array(b, np.uint64).astype(np.int64))], names=["a", "b"])

    return run


def shard_masks(distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree, so that shards stay near SHARD_NODES."""
    blocks = radius + 1
    while distinct / 2 ** (64 * (blocks - radius) / blocks) > SHARD_NODES and blocks < radius + 4:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that lie within the radius."""
    spark = fps.sparkSession
    masks = shard_masks(fps.count(), radius)
    shards = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for i, m in enumerate(masks)])).alias("s")).select("s.*", "fp")
    large = settled(shards.groupBy("part", "masked").count().filter(F.col("count") > TREE_NODES).select("part", "masked", F.ceil(F.col("count") / TREE_NODES).cast("int").alias("cuts")))
    if large.head(1):
        shards = shards.join(large, ["part", "masked"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda t: F.least(own, t) * F.col("cuts") + F.greatest(own, t))
        shards = shards.select("part", "masked", "fp", F.explode(pair).alias("cut"))
    else:
        shards = shards.withColumn("cut", F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = shards.repartition(n, "part", "masked", "cut").sortWithinPartitions("part", "masked", "cut", "fp")
    return rows.mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id (smallest doc_id reachable over links) for every row.

    root names the component, also where ids repeat. Null and wordless texts
    have fingerprint 0 and link like any other. Null ids stay in their component
    but never name it, unless it has no other id. Repeated rows are all
    returned. An empty table gives no rows.
    """
    found = settled(fingerprints(docs))
    reps = settled(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(reps.select("fp"), radius))
    joined = settled(reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")))
    named = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    joined = settled(join_hot(joined, named, "root", "m", joined.count()).select("fp", "root", "component_id", "n"))
    return join_hot(found, joined, "fp", "n", found.count()).select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the smallest doc_id (then text hash); columns unchanged.

    Of rows that repeat the id and text of the one that stays, one stays.
    """
    return keep_best(docs, settled(near_duplicates(docs, radius)))


def keep_best(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay where found has doc_id, text_hash and root for each."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    best = settled(found.groupBy("root").agg(F.min(order).alias("b")).select("b.doc_id", "b.text_hash"))
    again = settled(found.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"))
    other = settled(same_doc(found.select("doc_id", "text_hash"), best, "left_anti").unionByName(again).distinct())
    few = other.count() <= BROADCAST_DOCS
    # only rows that go, and that are there more than once, are looked at one by one: the texts of the others are not shuffled
    kept = filter_docs(docs, F.broadcast(other), "left_anti") if few else bitmap_docs(docs, other, "left_anti")
    repeated = bool(again.head(1))
    if few and not repeated:
        return kept
    rest = filter_docs(filter_docs(docs, F.broadcast(other), "left_semi") if few else bitmap_docs(docs, other, "left_semi"), best, "left_semi")
    return kept.unionAll(rest.dropDuplicates(["doc_id", "text"]) if repeated else rest)


def hex_fingerprint(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
