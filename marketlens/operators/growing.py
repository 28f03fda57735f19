"""Duplicate classes that grow with their catalogue: a delta joins only what its keys touch.

Kept are the class of every key and of every product when they came in, and the
moves: which class has become which since. A delta is linked to the classes of
its keys, components are found among these links alone, and classes that meet
are moved. Nothing that came in before is written again; the table of moves is,
and has a row for each class that ever met another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.components import components
from marketlens.sources.shared import file_system, settled
from marketlens.sources.snapshots import Snapshots

#: Keys of a delta up to which they are broadcast to the table of keys, which is then not shuffled.
BROADCAST_KEYS = 200_000


class GrowingClasses:
    """Classes of ids (long) that share keys, under a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.moves = Snapshots(spark, f"{self.path}/moves", "node long, root long")

    def _so_far(self, name: str, schema: str) -> DataFrame:
        """Rows of the deltas that are done: a folder without its version of the moves is not there yet."""
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, delta int").parquet(f"{self.path}/{name}").filter(F.col("delta") <= self.moves.version()).drop("delta")

    def _now(self, rows: DataFrame) -> DataFrame:
        """Rows with ``class`` as the moves have it."""
        moved = self.moves.read().withColumnsRenamed({"node": "_n", "root": "_r"})
        return rows.join(moved, F.col("class") == F.col("_n"), "left").withColumn("class", F.coalesce("_r", "class")).drop("_n", "_r")

    def classes(self) -> DataFrame:
        """id, class of all products: class is the smallest id reachable over shared keys, as ``fusion.classes`` has it."""
        return self._now(self._so_far("members", "id long, class long"))

    def add(self, keyed: DataFrame, keys: list[str]) -> int:
        """Takes in new products, or more keys of known ones: id and the key columns. Returns the number of the delta.

        Null keys link nothing; repeated rows count once. A delta that fails
        half-way is written over by the next. Keys are never taken back: a
        product that loses a key needs the classes built anew.
        """
        delta = self.moves.version() + 1
        text = [F.concat(F.lit(f"{i}|"), F.col(k)) for i, k in enumerate(keys)]
        ids = settled(keyed.select(F.col("id").cast("long").alias("id"), F.array_compact(F.array(*text)).alias("keys")))
        links = ids.select("id", F.explode("keys").alias("key")).distinct()
        own = settled(links.groupBy("key").agg(F.min("id").alias("least")))
        n, m = own.count(), ids.count()
        few = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_KEYS else df
        # what the delta touches: classes of its keys, and of its ids where they are known
        touched = settled(self._now(self._so_far("keys", "key string, class long").join(few(own.select("key"), n), "key", "left_semi")))
        known = settled(self._now(self._so_far("members", "id long, class long").join(few(ids.select("id").distinct(), m), "id", "left_semi")))
        edges = links.join(own, "key").select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(touched.join(own, "key").select(F.col("class").alias("a"), F.col("least").alias("b")))
        edges = edges.unionByName(known.select(F.col("id").alias("a"), F.col("class").alias("b")))
        roots = settled(components(edges))
        of = lambda df, c: df.join(roots, F.col(c) == F.col("node"), "left").withColumn("class", F.coalesce("root", c)).drop("node", "root")
        fresh = of(ids.select("id").distinct().join(known.select("id"), "id", "left_anti"), "id")
        fresh.write.mode("overwrite").parquet(f"{self.path}/members/delta={delta}")
        new_keys = of(own.join(touched.select("key"), "key", "left_anti"), "least").select("key", "class")
        new_keys.write.mode("overwrite").parquet(f"{self.path}/keys/delta={delta}")
        old = touched.select("class").union(known.select("class")).distinct().withColumnRenamed("class", "was")
        met = settled(of(old, "was").filter("class <> was").select(F.col("was").alias("node"), F.col("class").alias("root")))
        again = met.withColumnsRenamed({"node": "_n", "root": "_r"})
        before = self.moves.read().join(again, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
        return self.moves.overwrite(before.unionByName(met), delta - 1)
