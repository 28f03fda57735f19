"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id and text. A source that needs more than whole
copies of its documents takes those whose hash lies under a threshold. The
threshold comes from histograms: tokens are summed by source and hash bucket,
the bucket in which the budget runs out is split again by the next bits, and so
on. Only the rows of boundary buckets are read again; nothing is sorted.
Thresholds for growing budgets nest, so a larger mix holds the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, settled, word_count

HASH_BITS = 60
STEP_BITS = 12
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Sources up to which the table of sources is broadcast.
BROADCAST_SOURCES = 100_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of the id and, on a new line, the text; nulls count as empty."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, none above ``most`` times its size.

    Sources in code point order, null last, weigh ``weights`` in turn. A source
    whose share passes its cap stays at the cap and the rest is shared again.
    With sources by rising cap per weight this needs no rounds: the capped ones
    are a prefix, and the level of the others follows from running sums. One
    row per source reaches the windows, whatever the number of documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    rows = totals.withColumn("weight", weight).withColumn("cap", cap)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "source", "source_size", "weight", "cap", F.row_number().over(by_level).alias("place"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    # the level at the first source that is not capped holds for all that follow
    free = F.col("left") / F.col("left_weight") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("level", F.min_by(F.col("left") / F.col("left_weight"), F.when(free, F.col("place"))).over(Window.partitionBy(F.lit(0))))
    return rows.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents with hash < below have sizes that sum up nearest to the budget.

    hashed: source, size, hash. budgets: source, budget. Each level sums tokens
    by source and bucket of the next bits inside the boundary bucket found so far.
    """
    found = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("low"))
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        span = 1 << (shift + STEP_BITS)
        inside = hashed.join(broadcast_if_small(found.withColumnRenamed("source", "s"), found.count(), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + span))
        if shift == HASH_BITS - 2 * STEP_BITS:  # the rows of the first boundary buckets are all that later levels read
            inside = settled(inside.select("source", "size", "hash", "budget", "low"))
            hashed = inside.select("source", "size", "hash")
        histogram = inside.groupBy("source", F.shiftright(F.col("hash"), shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.first("budget").alias("budget"))
        run = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bucket with which the budget is passed
        edge = histogram.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("bucket", "tokens", (F.col("budget") - (F.col("upto") - F.col("tokens"))).alias("left")), "bucket").alias("e")
        )
        found = settled(edge.select("source", F.col("e.left").alias("budget"), F.shiftleft(F.col("e.bucket"), shift).alias("low"), F.col("e.tokens").alias("tokens")))
    # the last bucket is one hash value: in or out, whichever comes nearer
    return found.select("source", (F.col("low") + F.when(F.col("tokens") - F.col("budget") < F.col("budget"), 1).otherwise(0)).alias("below"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, whole: bool = False) -> DataFrame:
    """Words that a mix takes of each document.

    Returns doc_id, size, source_size, target, taken; with ``whole`` all columns
    of docs instead of doc_id, whatever their names, but for own columns of these
    four names in any case, which give way. A source takes
    floor(target / source_size) whole copies and, by threshold, part of one more.
    Null texts have size 0; null sources form one source, last in order; rows
    equal in id and text share a hash, so they are taken together; an empty
    table gives no rows. Where all sizes are 0, targets are 0.
    """
    sized = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")))
    targets = settled(source_targets(sized).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
    budgets = targets.filter((F.col("source_size") > 0) & (F.col("copies") * F.col("source_size") < F.col("target")))
    below = thresholds(sized, budgets.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")))
    plan = targets.join(below.withColumnRenamed("source", "b"), F.col("source").eqNullSafe(F.col("b")), "left")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"))
    columns = docs.columns if whole else ["doc_id"]
    if whole:
        rows = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
        at = {c.lower(): F.col(f"_c{i}") for i, c in enumerate(columns)}
        sized = rows.withColumns({"source": at["source"], "size": word_count(at["text"]), "hash": row_hash(at["doc_id"], at["text"])})
    out = sized.join(broadcast_if_small(plan, targets.count(), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    added = ("size", "source_size", "target", "taken")
    kept = [F.col(f"_c{i}" if whole else c).alias(c) for i, c in enumerate(columns) if c.lower() not in added]
    return out.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))
