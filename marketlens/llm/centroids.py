"""Centroid clustering (k-means in integers) over a vector-approximation file.

Every component of a vector is compressed to the number of a cell. For a set of
centroids, lookup tables hold for each component and cell the least and the most
that it adds to the distance from each centroid; their sums give an interval per
centroid. The part of the distance that all centroids share cancels when they
are compared, so it is left out of the tables, which makes the intervals
narrower. A vector whose nearest interval lies below all others is assigned from
its cells alone.

The cells, the full vectors and the assignment are tables bucketed alike by row
number, so a round joins them without a shuffle. It reads the cells and fetches
full vectors for the rows whose intervals overlap and for those that change
cluster: sums of clusters are kept and only moved by what leaves and enters.
Tables of a round are removed when the next one is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import scratch_path, written

CLUSTERS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1_024
SEED = 3
#: Components are held to this, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27
#: Cells of a component, a byte each. Of 10,256 unit vectors with 64 components and 8 centroids, intervals overlap
#: for 97 % with 16 cells, 63 % with 64 and 20 % with 256.
CELLS = 256
#: Rows from whose components the edges of the cells are taken; every row is then put into cells or, beyond the edges, fetched.
SAMPLE = 4_096
#: Bytes of full vectors in one bucket.
BUCKET_BYTES = 64 << 20
#: Squared distances below this are exact in doubles.
EXACT = 1 << 52


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of vectors with exactly ``components`` components, all finite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(x.isNotNull() & (F.size(x) == components) & fine)
    held = lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return rows.select("vec_id", F.transform("embedding", held).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as longs; the column has no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def cell_edges(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """[cells + 1, components]: edges of equal counts of the sample inside, and one cell beyond either end as wide as the sample's range."""
    low, high = sample.min(axis=0), sample.max(axis=0) + 1
    inner = np.quantile(sample, np.linspace(0, 1, cells - 1), axis=0, method="lower")
    inner[-1] = high
    return np.concatenate([[low - (high - low)], inner, [high + (high - low)]]).astype(np.int64)


def cells_of(v: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells as bytes, whether all components lie within the edges)."""
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.clip(np.searchsorted(edges[:, d], v[:, d], side="right") - 1, 0, len(edges) - 2)
    return out, ((v >= edges[0]) & (v < edges[-1])).all(axis=1)


def tables(edges: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that [component, cell, centroid] adds to |c|^2 - 2 x (c - m), the distance without its common part; m is the middle of the centroids.

    In doubles, widened by more than their rounding.
    """
    c = centroids.astype(np.float64)
    off = (c - (c.max(axis=0) + c.min(axis=0)) / 2).T[:, None, :]
    low, high = edges[:-1].T[:, :, None].astype(np.float64), edges[1:].T[:, :, None] - 1.0
    a, b, square = -2 * low * off, -2 * high * off, (c * c).T[:, None, :]
    slack = (np.abs(a) + np.abs(b) + square) * 1e-12
    return np.minimum(a, b) + square - slack, np.maximum(a, b) + square + slack


def assigned(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cluster of each row of cells, -1 where intervals overlap (or touch)."""
    least, most = np.zeros((len(cells), low.shape[2])), np.zeros((len(cells), low.shape[2]))
    for d in range(cells.shape[1]):
        least += low[d, cells[:, d]]
        most += high[d, cells[:, d]]
    best = most.argmin(axis=1)
    rows = np.arange(len(cells))
    bound = most[rows, best]
    least[rows, best] = np.inf
    return np.where((least > bound[:, None]).all(axis=1), best, -1)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [row, centroid] as exact longs."""
    far = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max()))
    if v.shape[1] * (2 * far) ** 2 < EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """The rows dealt out by the number of their bucket: one task writes a bucket, into one file, however many tasks there are."""
    return df.repartitionById(buckets, F.pmod(F.hash("row"), F.lit(buckets)))


def bucketed(df: DataFrame, buckets: int, name: str) -> tuple[str, str]:
    """(table, path) of the rows, bucketed by ``row`` in the shared folder."""
    table, path = f"{name}_{uuid.uuid4().hex}", scratch_path(df.sparkSession, name)
    df.write.format("parquet").bucketBy(buckets, "row").sortBy("row").option("path", path).saveAsTable(table)
    return table, path


def dropped(spark: SparkSession, table: str, path: str) -> None:
    """Forgets a table of ``bucketed`` and removes its files."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and id, ties by their components; fewer where there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.orderBy(key, "v").limit(clusters).select("v").collect()], np.int64)


def approximated(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """row and cells of each row, null beyond the edges."""
    width = edges.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, inside = cells_of(matrix(batch.column("v"), width), edges)
            column = pa.array([c.tobytes() if ok else None for c, ok in zip(cells, inside.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), column], names=["row", "cells"])

    return rows.select("row", "v").mapInArrow(encode, "row long, cells binary")


def decided(cells: DataFrame, state: DataFrame, edges: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """row, before (its cluster so far) and sure, the cluster that its cells alone decide, or null."""
    width = edges.shape[1]
    low, high = tables(edges, centroids)

    @F.arrow_udf("int")
    def by_cells(cells: pa.Array) -> pa.Array:
        there = cells.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(cells), -1)
        out[there] = assigned(np.frombuffer(b"".join(cells.drop_null().to_pylist()), np.uint8).reshape(-1, width), low, high)
        return pa.array(out, pa.int32(), mask=out < 0)

    both = cells.join(state.select(F.col("row").alias("r"), F.col("cluster").alias("before")), F.col("row") == F.col("r"))
    return both.select("row", "before", by_cells("cells").alias("sure"))


def fetched(found: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row, before, cluster after this round, and v of the rows that changed cluster.

    Full vectors are joined only to rows that are not sure or change cluster.
    """
    width = centroids.shape[1]

    @F.arrow_udf("int")
    def by_vector(v: pa.Array) -> pa.Array:
        there = v.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(v), -1)
        out[there] = squared(matrix(v.drop_null(), width), centroids).argmin(axis=1)  # the smaller number of equals
        return pa.array(out, pa.int32(), mask=out < 0)

    fetch = F.col("sure").isNull() | (F.col("sure") != F.col("before"))
    out = found.join(vectors.select(F.col("row").alias("r"), "v"), (F.col("row") == F.col("r")) & fetch, "left")
    unsure = F.when(F.col("sure").isNull(), F.col("v"))
    out = out.select("row", "before", "v", F.coalesce("sure", by_vector(unsure)).alias("cluster"))
    return out.withColumn("v", F.when(F.col("cluster") != F.col("before"), F.col("v")))


def moved_sums(state: DataFrame, clusters: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the moves of a round add to each cluster: (sums of components, counts), a row per cluster and component at the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, width), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), width)
            for side, sign in (("cluster", 1), ("before", -1)):
                of = batch.column(side).to_numpy()
                for c in range(clusters):
                    sums[c] += sign * v[of == c].sum(axis=0)
                    counts[c] += sign * int((of == c).sum())
        at = np.arange(clusters)
        columns = [pa.array(np.repeat(at, width + 1), pa.int32()), pa.array(np.tile(np.arange(-1, width), clusters), pa.int32()), pa.array(np.column_stack([counts, sums]).ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "d", "n"])

    moved = state.filter(F.col("cluster") != F.col("before")).select("cluster", "before", "v")
    found = moved.mapInArrow(add, "c int, d int, n long").groupBy("c", "d").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((clusters, width + 1), np.int64)
    for r in found:
        out[r.c, r.d + 1] = r.n
    return out[:, 1:], out[:, 0]


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = COMPONENTS, buckets: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and distance of each row, the final centroids)."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    schema = "vec_id long, cluster int, distance long"
    if not n:
        return spark.createDataFrame([], schema), np.zeros((0, width), np.int64)
    centroids = first_centroids(rows, clusters, seed)
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toArrow()  # bounded
    edges = cell_edges(matrix(sample.column("v").combine_chunks(), width))
    buckets = buckets or max(1, -(-n * width * 4 // BUCKET_BYTES), min(2 * spark.sparkContext.defaultParallelism, n // 1_024))
    vectors = bucketed(by_bucket(rows.select("row", "v"), buckets), buckets, "vectors")
    cells = bucketed(by_bucket(approximated(rows, edges), buckets), buckets, "cells")
    state = bucketed(spark.table(cells[0]).select("row", F.lit(-1).alias("cluster")), buckets, "state")
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        found = bucketed(decided(spark.table(cells[0]), spark.table(state[0]), edges, centroids), buckets, "decided")
        dropped(spark, *state)  # what follows is written whole
        state = bucketed(fetched(spark.table(found[0]), spark.table(vectors[0]), centroids), buckets, "state")
        dropped(spark, *found)
        more, in_ = moved_sums(spark.table(state[0]), len(centroids), width)
        sums, counts = sums + more, counts + in_
        there = counts > 0
        centroids = np.where(there[:, None], sums // np.maximum(counts, 1)[:, None], centroids)  # // floors
    for made in (state, cells, vectors):
        dropped(spark, *made)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # distances need every full vector
            far = squared(matrix(batch.column("v"), width), centroids)
            best = far.argmin(axis=1)
            columns = [batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(last, schema), centroids


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, buckets: int | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Kept are vectors with exactly ``components`` components, none null or
    non-finite; components are floor(1024 * x), held to 2^27 either way, so that
    distances fit a long (inertias are held to a long too). Rows that share an
    id, or repeat, count each; a null id hashes as empty. Ties go to the smaller
    cluster; empty clusters keep their centroid; with fewer vectors than
    clusters there are as many clusters as vectors. An empty table gives no
    rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    found, centroids = clustered(integers(vectors, components), clusters, rounds, seed, components, buckets)
    found = written(found, "clusters")
    held = lambda total: F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    totals = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total")).collect()  # a row per cluster
    digests = [(r.cluster, r.total, sum(x.total for x in totals), ",".join(map(str, centroids[r.cluster].tolist()))) for r in totals]
    by_cluster = spark.createDataFrame(digests, "c int, own decimal(38,0), whole decimal(38,0), centroid string")
    by_cluster = by_cluster.select("c", held(F.col("own")).alias("cluster_inertia"), held(F.col("whole")).alias("inertia"), F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(by_cluster), F.col("cluster") == F.col("c")).drop("c")
