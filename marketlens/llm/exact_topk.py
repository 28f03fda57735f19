"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``parts`` along their components. A part of all candidates
is a list: against a query it has a local score for each candidate, and the sum
over the lists is the score. Queries travel in chunks of bounded bytes to the
lists, which are scanned where they lie.

1. Each list gives its k best local scores. The gathered candidates are scored
   in full; the k-th best of them is a safe cutoff c, as the true k-th best is
   not lower.
2. Each list gives all local scores of c / parts or more. A candidate that no
   list gives has less than c in sum and is out.
3. Where all lists gave a candidate its score is known; elsewhere the sum so far
   and the share for each list not heard from bound it. What the bound leaves is
   scored from the whole vectors.

Integers throughout, so ties are exact. Equal vectors are searched once: a class
of them has the scores of all, and its k + 1 smallest ids are all that a result
can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import written

#: More lists leave less to add up in each, but let more local scores pass: of the pairs of a table of 10,256
#: vectors in ten clusters, 10 % pass with two lists and 42 % with four.
PARTS = 2
SCALE = 1_024
K = 10
#: Bytes of query vectors that are broadcast at once.
CHUNK_BYTES = 16 << 20
#: Scores computed at once.
TILE_SCORES = 1 << 22
#: Sums below this are exact in doubles.
EXACT = 1 << 53
LONG = np.iinfo(np.int64)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as long, of rows with an id and a vector of finite components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))


def matrices(sizes: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, rows as int64) for each length of vector in a batch."""
    sizes = sizes.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield size, rows, flat.astype(np.int64).reshape(len(rows), -1)


def largest(rows: np.ndarray) -> int:
    return max(int(rows.max()), -int(rows.min())) if rows.size else 0


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T in integers: by doubles where these are exact, by longs where those hold, else by Python's and held to longs."""
    bound = left.shape[1] * largest(left) * largest(right)
    if bound < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if bound <= LONG.max:
        return left @ right.T
    return np.clip(left.astype(object) @ right.T.astype(object), LONG.min, LONG.max).astype(np.int64)


def part_of(size: int, part: int, parts: int) -> slice:
    step = max(1, -(-size // parts))
    return slice(min(size, part * step), min(size, (part + 1) * step))


def cut(classes: DataFrame, parts: int) -> DataFrame:
    """The lists: class, size, part, v (that part's components)."""
    step = F.greatest(F.lit(1), F.ceil(F.col("size") / parts)).cast("int")
    split = classes.select("class", "size", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "v")
    return split.withColumn("v", F.slice("v", F.col("part") * step + 1, step))


class Chunk:
    """Queries by length of vector: numbers and rows. A plain object, so that it can be broadcast."""

    def __init__(self, rows: pa.Table):
        sizes, vectors = rows.column("size").combine_chunks(), rows.column("v").combine_chunks()
        self.by_size = {size: (at, q) for size, at, q in matrices(sizes, vectors)}
        self.rows = {int(n): (size, i) for size, (at, _) in self.by_size.items() for i, n in enumerate(at.tolist())}

    def tiles(self, batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, query numbers, classes, local scores) over a batch of the lists."""
        part_column, classes = batch.column("part").to_numpy(), batch.column("class").to_numpy()
        for part in np.unique(part_column).tolist():
            at = pa.array(np.flatnonzero(part_column == part))
            for size, rows, x in matrices(batch.column("size").take(at), batch.column("v").take(at)):
                if size not in self.by_size:
                    continue
                numbers, q = self.by_size[size]
                q, own = q[:, part_of(size, part, parts)], classes[at.to_numpy()[rows]]
                step = max(1, TILE_SCORES // max(1, len(q)))
                for i in range(0, len(own), step):
                    yield part, numbers, own[i : i + step], products(q, x[i : i + step])


def search_chunk(chunk_rows: DataFrame, lists: DataFrame, classes: DataFrame, k: int, parts: int) -> DataFrame:
    """query (class), class, first_id, score: the k best classes of each query of a chunk, ties to the smaller first_id."""
    spark = lists.sparkSession
    table = chunk_rows.select("class", "size", "v").toArrow()
    names = table.column("class").to_numpy()
    sent = spark.sparkContext.broadcast(Chunk(table))

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, numbers, own, scores in sent.value.tiles(batch, parts):
                held = best.setdefault(part, {})
                key = int(numbers[0])
                own = np.broadcast_to(own, scores.shape)
                if key in held:
                    scores, own = np.concatenate([held[key][1], scores], axis=1), np.concatenate([held[key][2], own], axis=1)
                if scores.shape[1] > k:
                    top = np.argpartition(scores, -k, axis=1)[:, -k:]
                    scores, own = np.take_along_axis(scores, top, axis=1), np.take_along_axis(own, top, axis=1)
                held[key] = (numbers, scores, np.array(own))
        for part, held in best.items():
            for numbers, scores, own in held.values():
                q = np.repeat(numbers, scores.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), part)), pa.array(own.ravel()), pa.array(scores.ravel())], names=["q", "part", "class", "s"])

    def in_full(pairs: DataFrame) -> DataFrame:
        """q, class, first_id, score of pairs (q, class), from the whole vectors."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, out = batch.column("q").to_numpy(), np.zeros(len(batch), np.int64)
                for size, rows, x in matrices(batch.column("size"), batch.column("v")):
                    own = sent.value.by_size[size][1]
                    left = own[[sent.value.rows[n][1] for n in q[rows].tolist()]]
                    if size * largest(left) * largest(x) <= LONG.max:
                        out[rows] = (left * x).sum(axis=1)
                    else:
                        out[rows] = np.clip((left.astype(object) * x).sum(axis=1), LONG.min, LONG.max).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("class"), batch.column("first_id"), pa.array(out)], names=["q", "class", "first_id", "score"])

        return pairs.join(classes, "class").select("q", "class", "first_id", "size", "v").mapInArrow(score, "q long, class long, first_id long, score long")

    def kth(scores: DataFrame, what: str) -> DataFrame:
        """q and its k-th best score, where there are k."""
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        return scores.withColumn("place", place).filter(F.col("place") <= k).groupBy("q").agg(F.min("score").alias(what), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")

    # phase 1: local lists, a cutoff from their candidates
    place = F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc("s"), "class"))
    gathered = lists.mapInArrow(local_best, "q long, part long, class long, s long").withColumn("place", place).filter(F.col("place") <= k)
    cutoffs = dict(kth(in_full(gathered.select("q", "class").distinct()), "c").collect())  # a row per query of the chunk
    share = np.array([-(-cutoffs[n] // parts) if n in cutoffs else LONG.min for n in range(len(names))], np.int64)
    cut_sent = spark.sparkContext.broadcast(share)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, numbers, own, scores in sent.value.tiles(batch, parts):
                i, j = np.nonzero(scores >= cut_sent.value[numbers][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(own[j]), pa.array(scores[i, j])], names=["q", "class", "s"])

    # phase 2: all that reaches its share of the cutoff
    heard = lists.mapInArrow(above, "q long, class long, s long").groupBy("q", "class").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    heard = written(heard, "heard")
    # phase 3: what is known lifts the cutoff; what may reach it is scored in full
    known = heard.filter(F.col("n") == parts).join(classes.select("class", "first_id"), "class").select("q", "class", "first_id", held_to_long("s").alias("score"))
    shares = spark.createDataFrame([(n, int(share[n]), cutoffs.get(n)) for n in range(len(names))], "q long, share long, c long")
    lifted = shares.join(kth(known, "c2"), "q", "left").select("q", "share", F.greatest("c", "c2").alias("c"))
    open_ = heard.filter(F.col("n") < parts).join(F.broadcast(lifted), "q")
    most = F.col("s") + (parts - F.col("n")) * (F.col("share").cast("decimal(38,0)") - 1)
    resolved = in_full(open_.filter(F.col("c").isNull() | (most >= F.col("c"))).select("q", "class"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first_id", "class"))
    found = known.union(resolved).withColumn("place", best).filter(F.col("place") <= k)
    numbers = spark.createDataFrame([(n, int(c)) for n, c in enumerate(names)], "q long, query long")
    out = written(found.join(F.broadcast(numbers), "q").select("query", "class", "first_id", "score"), "best")
    sent.unpersist()
    cut_sent.unpersist()
    return out


def held_to_long(total: str) -> Column:
    low, high = F.lit(int(LONG.min)).cast("decimal(38,0)"), F.lit(int(LONG.max)).cast("decimal(38,0)")
    return F.least(F.greatest(F.col(total), low), high).cast("long")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K, parts: int = PARTS, scale: int = SCALE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest integer inner product for each query row.

    is_query: a condition on vec_id. Components are floor(scale * x), held to 64
    bits, as scores are. Candidates of a query row are all rows but itself: rows
    that share its id or its vector count, repeated rows as often as they are
    there. Ties go to the smaller id; with fewer than k candidates all are
    returned. Rows without an id, and vectors that are null or hold null or
    non-finite components take no part; zero vectors do. Vectors meet only those
    of their length. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale).withColumns({"row": F.monotonically_increasing_id(), "same": F.sha2(F.concat_ws(",", F.transform("v", lambda c: c.cast("string"))), 256), "size": F.size("v")})
    rows = written(rows.withColumn("asks", is_query), "rows")
    order = Window.partitionBy("same").orderBy("vec_id", "row")
    # at most k + 1 rows a class leave a task: the filter on the number goes below the shuffle
    members = rows.withColumns({"number": F.row_number().over(order), "class": F.first("row").over(order)}).filter(F.col("number") <= k + 1)
    members = written(members.select("class", "same", "number", "vec_id", "row", "size", F.when(F.col("number") == 1, F.col("v")).alias("v")), "members")
    classes = members.filter("number = 1").select("class", "same", F.col("vec_id").alias("first_id"), "size", "v")
    asked = rows.filter("asks").select("same").distinct().join(classes, "same")
    asked = written(asked.withColumn("bytes", F.col("size") * 8), "asked")
    total = asked.agg(F.sum("bytes")).first()[0]
    if total is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks = max(1, -(-total // chunk_bytes))
    lists = written(cut(classes, parts), "lists")
    found = [search_chunk(asked.filter(F.pmod(F.xxhash64("same"), F.lit(chunks)) == n), lists, classes.drop("same"), k + 1, parts) for n in range(chunks)]
    best = reduce(DataFrame.union, found)
    # the k + 1 best rows of each class of queries; each query row then leaves out itself
    near = best.join(members.select("class", "vec_id", "row"), "class")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("place") <= k + 1)
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("near"))
    near = near.join(classes.select(F.col("class").alias("query"), "same"), "query").select("same", "near")
    own = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "same").join(near, "same")
    left = F.slice(F.filter("near", lambda x: x["row"] != F.col("own")), 1, k)
    out = own.select("query_id", F.posexplode(left).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
