"""Approximate-first nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every pair of blocks is one tile.
In a tile, unit vectors are quantised to int8 and multiplied as matrices. With
steps s and t, the product differs from the cosine by at most
(s * |v'|_1 + t * |v|_1) / 2. Pairs whose upper bound reaches the k-th best
lower bound are computed again in double precision and kept in a heap per
query; the heaps of the tiles are merged by a window. A tile holds as many rows
a side as fit its bytes, so a vector is copied once for each block of the other
side.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import written

#: Bytes of the vectors of one side of a tile, as doubles; more rows a block mean fewer copies of each vector.
BLOCK_BYTES = 32 << 20
#: Rows in a block at least.
LEAST_BLOCK = 1_024
#: Queries and candidates multiplied at once.
TILE = 1_024
#: Components of which products of int8 sum up exactly in float32; longer rows are multiplied in double.
EXACT_SIZE = 1_000
#: Room for rounding in the bounds themselves.
SLACK = 1e-6


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between 1/2 and 1: cosines stay the same to the bit, squares stay finite."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their steps, and the sums of absolute quantised values."""
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    return q, step, np.abs(q.astype(np.float64)).sum(axis=1) * step


def tile_search(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int, own: np.ndarray | None = None) -> list[list[tuple[float, int, int]]]:
    """For each query its k best (cosine, -id, -position) among the candidates.

    own: for each query the position of its row among the candidates, -1 if it is not there.
    """
    queries, candidates = scaled(queries), scaled(candidates)
    q_norm, c_norm = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((candidates * candidates).sum(axis=1))
    q_unit, c_unit = queries / q_norm[:, None], candidates / c_norm[:, None]
    exact = np.float32 if queries.shape[1] <= EXACT_SIZE else np.float64
    q8, q_step, _ = quantised(q_unit)
    c8, c_step, c_sum = quantised(c_unit)
    q_sum = np.abs(q_unit).sum(axis=1)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in q_ids]
    for from_ in range(0, len(q_ids), TILE):
        rows = slice(from_, from_ + TILE)
        left = q8[rows].astype(exact)
        for at in range(0, len(c_ids), TILE):
            cols = slice(at, at + TILE)
            near = (left @ c8[cols].T.astype(exact)).astype(np.float64) * q_step[rows, None] * c_step[cols][None, :]
            error = (q_sum[rows, None] * c_step[cols][None, :] + q_step[rows, None] * c_sum[cols][None, :]) / 2 + SLACK
            if own is not None:
                mine = np.flatnonzero((own[rows] >= at) & (own[rows] < at + TILE))
                near[mine, own[rows][mine] - at] = -np.inf
            lower = near - error
            worst = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(left), -np.inf)
            worst = np.maximum(worst, [h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
            keep = (near + error >= worst[:, None]) & np.isfinite(near)
            for i in np.flatnonzero(keep.any(axis=1)).tolist():
                j, q = np.flatnonzero(keep[i]) + at, from_ + i
                score = (candidates[j] * queries[q]).sum(axis=1) / (q_norm[q] * c_norm[j])
                best = np.lexsort((c_ids[j], -score))[:k]
                for s, c, p in zip(score[best].tolist(), c_ids[j[best]].tolist(), j[best].tolist(), strict=True):
                    if len(heaps[q]) < k:
                        heapq.heappush(heaps[q], (s, -c, -p))
                    else:
                        heapq.heappushpop(heaps[q], (s, -c, -p))
    return heaps


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and copies of the rows with an id and a vector that is not zero and has only finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    return rows.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))


def nearest(vectors: DataFrame, is_query, k: int = 5, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest cosine for each query row.

    is_query: a condition on vec_id. Candidates of a query row are all usable
    rows but itself: rows that share its id count, and so does each further copy
    of a row, as often as it is there. Ties go to the smaller id; with fewer than
    k candidates all are returned. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id; any finite
    magnitude is fine. Vectors meet
    only those of their length. Every pair is bounded and no pair that could
    matter is dropped. An empty table gives no rows.

    block_rows: rows in one side of a tile; by default as many as BLOCK_BYTES hold.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors).withColumn("size", F.size("embedding")).withColumn("h", F.xxhash64("vec_id", "embedding")), "vectors")
    queries = rows.filter(is_query)
    n, m, size = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max("size")).first()
    most = block_rows or max(LEAST_BLOCK, BLOCK_BYTES // (8 * max(1, size or 1)))
    q_blocks = max(1, -(-m // most))
    c_blocks = max(1, -(-n // most), min(-(-2 * spark.sparkContext.defaultParallelism // q_blocks), n // LEAST_BLOCK))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumns({"qb": F.pmod("h", F.lit(q_blocks)).cast("int"), "cb": numbers(c_blocks)})
    right = rows.withColumns({"cb": F.pmod("h", F.lit(c_blocks)).cast("int"), "qb": numbers(q_blocks)})
    names, types = ["query_id", "query_row", "query_copies", "vec_id", "copies", "score"], [pa.int64()] * 5 + [pa.float64()]

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        flat = []
        if len(q) and len(c):
            q_ids, c_ids = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
            q_vectors, c_vectors = matrix(q.column("embedding")), matrix(c.column("embedding"))
            copies, place = c.column("copies").to_pylist(), {}
            for j, key in enumerate(zip(c_ids.tolist(), c.column("h").to_pylist(), strict=True)):
                place.setdefault(key, []).append(j)
            own = np.full(len(q_ids), -1)
            for i, key in enumerate(zip(q_ids.tolist(), q.column("h").to_pylist(), strict=True)):
                same = [j for j in place.get(key, ()) if np.array_equal(c_vectors[j], q_vectors[i])]
                own[i] = same[0] if same else -1
            # a row that is there once is no candidate of its own; one with copies is, once less
            alone = np.array([j >= 0 and copies[j] == 1 for j in own.tolist()], bool)
            found = tile_search(q_ids, q_vectors, c_ids, c_vectors, k, np.where(alone, own, -1))
            for i, (row, times, heap) in enumerate(zip(q.column("h").to_pylist(), q.column("copies").to_pylist(), found, strict=True)):
                flat += [(int(q_ids[i]), row, times, -c, min(k, copies[-p] - (-p == own[i])), s) for s, c, p in heap]
        return pa.Table.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate(types)], names=names)

    schema = "query_id long, query_row long, query_copies long, vec_id long, copies long, score double"
    tiles = left.groupBy("size", "qb", "cb").cogroup(right.groupBy("size", "qb", "cb")).applyInArrow(tile, schema)
    times = lambda c: F.explode(F.sequence(F.lit(1), F.col(c)))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    best = tiles.withColumn("copy", times("copies")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("copy", times("query_copies")).select("query_id", "rank", "vec_id", "score")
