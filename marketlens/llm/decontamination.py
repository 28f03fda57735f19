"""Benchmark decontamination by word windows, in DataFrame operations only.

A window is WINDOW consecutive words of a benchmark item, or all words of a
shorter one. Documents are not hashed at every word: of the n - g + 1 short
grams in a window of n words exactly one starts at a multiple of n - g + 1, so
grams of g words at that stride, looked up in the broadcast set of the
benchmark's grams, meet every window. Around each hit the whole windows are
compared with the benchmark's as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, broadcast_if_small, filter_docs, same_doc, settled

WINDOW = 10
#: Letters and digits of ASCII and all other characters; case is folded afterwards.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Benchmark windows up to which their sets are broadcast; beyond, Spark shuffles.
BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    """Words in order, letters as written; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ITEM_WORD), 0)


def gram(start: Column, n: int | Column) -> Column:
    """The n words from 0-based ``start``, ASCII letters lowered, joined by a space."""
    return ascii_lower(F.concat_ws(" ", F.slice("words", start + 1, n)))


def gram_plan(n: int) -> tuple[int, int]:
    """(gram words, stride) for windows of n words."""
    size = min(3, (n + 1) // 2)
    return size, n - size + 1


def _point(n: int, size: int):
    return lambda p: F.struct(F.lit(n).alias("n"), F.lit(size).alias("g"), p.alias("p"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, words): every window, once per item and text."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    return items.select("item_id", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("i")).select(
        "item_id", "n", F.slice("words", F.col("i") + 1, F.col("n")).alias("words"), gram(F.col("i"), F.col("n")).alias("window")
    ).dropDuplicates(["item_id", "window"])


def window_hits(keyed: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, start, n, item_id): each window of an item found in a document.

    One scan serves windows of all lengths: a document gives the grams of every
    length at that length's stride.
    """
    windows = settled(benchmark_windows(benchmark, window))
    lengths = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # at most `window` rows
    if not lengths:
        return keyed.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("item_id")).limit(0)
    count, keys = sum(lengths.values()), sum(c * gram_plan(n)[1] for n, c in lengths.items())
    grams, points = None, []
    for n in sorted(lengths):
        size, stride = gram_plan(n)
        at = F.explode(F.sequence(F.lit(0), F.lit(n - size))).alias("p")
        own = windows.filter(F.col("n") == n).select(at, "words").select(F.xxhash64(gram(F.col("p"), size), F.lit(n)).alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
        points.append(F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - size, F.lit(stride)), _point(n, size))))
    scan = keyed.select("doc_id", "text_hash", "words", F.inline(F.flatten(F.array_compact(F.array(*points)))))
    near = scan.withColumn("gram", F.xxhash64(gram(F.col("p"), F.col("g")), F.col("n"))).join(broadcast_if_small(grams.distinct(), keys, BROADCAST_WINDOWS), "gram", "left_semi")
    low, high = F.greatest(F.col("p") - (F.col("n") - F.col("g")), F.lit(0)), F.least(F.col("p"), F.size("words") - F.col("n"))
    near = near.select("doc_id", "text_hash", "n", low.alias("low"), F.slice("words", low + 1, high - low + F.col("n")).alias("words"))
    whole = near.select("doc_id", "text_hash", "n", "low", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("i"))
    whole = whole.select("doc_id", "text_hash", "n", (F.col("low") + F.col("i")).alias("start"), gram(F.col("i"), F.col("n")).alias("window"))
    return whole.join(broadcast_if_small(windows.select("item_id", "window"), count, BROADCAST_WINDOWS), "window").select("doc_id", "text_hash", "start", "n", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every document its words, the words inside benchmark windows, and the items.

    Returns doc_id, n_words, n_hit, items (sorted as text) and text_hash. A
    document row is known by doc_id and text, so rows that repeat an id with
    another text keep their own result and repeated rows share one. Null and
    empty texts have no words and no hits; an empty benchmark hits nothing;
    null item ids are not listed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(F.col("text")).alias("words"))
    hits = settled(window_hits(keyed, benchmark, window))
    key = ["doc_id", "text_hash"]
    covered = hits.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select(*key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_doc = covered.join(items, on=[covered[k].eqNullSafe(items[k]) for k in key]).select(covered["doc_id"].alias("d"), covered["text_hash"].alias("t"), "n_hit", "items")
    base = keyed.select(*key, F.size("words").cast("long").alias("n_words"))
    out = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, columns unchanged.

    Null and empty texts have no window and stay; of repeated rows all stay or
    all go; an empty benchmark drops nothing; columns may have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(F.col("text")).alias("words"))
    return filter_docs(docs, settled(window_hits(keyed, benchmark, window).select("doc_id", "text_hash").distinct()), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, without the words inside benchmark windows and what separates each from the word before it.

    Columns are those of docs, whatever their names; null and empty texts and
    documents without a hit are unchanged.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(F.col("text")).alias("words"))
    hits = window_hits(keyed, benchmark, window)
    at = hits.select("doc_id", "text_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    gone = settled(at.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone")))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    own = F.col(names["text"])
    rows = rows.withColumns({"doc_id": F.col(names["doc_id"]), "text_hash": F.xxhash64(F.coalesce(own, F.lit("")))})
    rows = same_doc(rows, gone, "left")
    pieces = F.regexp_extract_all(own, F.lit(ITEM_GAP + "*" + ITEM_WORD), 0)
    kept = F.filter(pieces, lambda piece, i: ~F.array_contains("gone", i))
    cut = F.concat(F.array_join(kept, ""), F.regexp_extract(own, ITEM_GAP + r"*\z", 0))
    return rows.select(*[(F.when(F.col("gone").isNull(), own).otherwise(cut) if c == "text" else F.col(n)).alias(c) for c, n in names.items()])
