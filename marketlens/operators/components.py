"""Connected components by alternating stars, and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.shared import settled

#: A key with more than one row in so many is hot; so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Rows up to which one task could take all of one key.
FEW_ROWS = 20_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with side, which has one row per key and in ``weight`` how many rows have it.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS: that part
    of side is broadcast, so no task gets all rows of one key. The rest shuffles.
    """
    if total <= FEW_ROWS:
        return rows.join(side.drop(weight), key)
    hot = F.col(weight) * HOT_KEYS > total
    few = F.broadcast(side.filter(hot).drop(weight))
    met = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(side.filter(~hot).drop(weight), key)
    return met.unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(both, least, "u", "n", 2 * n).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(down, least, "u", "n", n).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another: root is the smallest node reachable.

    edges: a, b of one type that has an order; self-links are ignored. Rounds are
    logarithmic in the size of a component; each is written to the shared folder.
    """
    edges = settled(edges.filter("a <> b"))
    edges = settled(_small_star(edges, edges.count()))
    mark = _mark(edges)
    while mark[0]:
        star = settled(_large_star(edges, mark[0]))
        edges = settled(_small_star(star, star.count()))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
