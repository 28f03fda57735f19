"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.shared import settled, shared_dir

__all__ = ["settled", "shared_dir"]

#: ASCII white space, the separator of words: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the bitmap that stands for documents in ``bitmap_docs``.
BITMAP_BITS = 1 << 27


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint only while the counted rows stay within ``most``; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def word_count(text: Column) -> Column:
    """Number of words of the text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder: columns, compressed, read in part by later plans."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_hash, text and further columns: what a document row is known and ordered by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def same_doc(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join on doc_id and text_hash, null-safe; the keys stay those of ``docs``."""
    found = found.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), how)
    return joined.drop("_d", "_t")


def filter_docs(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id and text are (left_semi) or are not (left_anti) in found (doc_id, text_hash).

    The keys of found take names that docs does not have.
    """
    taken, n = {c.lower() for c in docs.columns}, 0
    while {f"key{n}", f"hash{n}"} & taken:
        n += 1
    keys = found.select(F.col("doc_id").alias(f"key{n}"), F.col("text_hash").alias(f"hash{n}"))
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(f"key{n}")) & (text_hash == F.col(f"hash{n}")), how)


def bitmap_docs(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """As filter_docs, but by a bitmap of hashes (BITMAP_BITS) that is broadcast, so no row of docs is shuffled.

    Of the rows that are not in found a few count as if they were.
    """
    taken, n = {c.lower() for c in docs.columns}, 0
    while {f"bucket{n}", f"bits{n}"} & taken:
        n += 1

    def place(text_hash: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_hash), F.lit(BITMAP_BITS)) + 1

    bits = found.select(place(F.col("text_hash")).alias("h")).groupBy(F.bitmap_bucket_number("h").alias(f"bucket{n}")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(f"bits{n}"))
    h = place(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    byte = F.conv(F.hex(F.substr(f"bits{n}", (F.bitmap_bit_position(h) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    same = (F.bitmap_bucket_number(h) == F.col(f"bucket{n}")) & (F.getbit(byte, (F.bitmap_bit_position(h) % 8).cast("int")) == 1)
    return docs.join(F.broadcast(bits), same, how)


def let_go(spark: SparkSession) -> None:
    """Collects what nothing refers to any more, in Python and in the driver's JVM; only then Spark deletes the files of a shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
