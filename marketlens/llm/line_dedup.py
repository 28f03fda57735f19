"""Line deduplication within one edit, in DataFrame operations only.

Two lines are alike if at most one character is inserted, deleted or replaced.
Every variant of a line with a character deleted is a hashed key; lines meet
where variants are equal. To emit all variants of all lines would multiply the
text by its line length, so lines are first cut into segments: two lines within
one edit agree on all but one segment, taken from the left before it and from
the right behind it. Only lines that share such a context with another line,
first for halves, then for SEGMENTS, emit the variants of the one segment left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, doc_key, same_doc, written

SEGMENTS = 16
#: Rows of 8 to 40 bytes up to which a set of keys is broadcast.
BROADCAST_KEYS = 500_000
_FIRST = -(1 << 63)


def _bounds(segments: int) -> tuple[Column, Column, Column]:
    """(shorter length m, start of segment j, length of what follows it) for role r and segment j."""
    m = F.length("line") - F.col("r")
    edge = lambda j: F.floor(j * m / segments).cast("int")
    return m, edge(F.col("j")), m - edge(F.col("j") + 1)


def _context(segments: int) -> Column:
    m, before, after = _bounds(segments)
    return F.xxhash64(m, F.col("j"), F.substr("line", F.lit(1), before), F.substr("line", F.length("line") - after + 1, after))


def _middle(segments: int) -> Column:
    _, before, after = _bounds(segments)
    return F.substr("line", before + 1, F.length("line") - before - after)


def _without(text: str, at: Column) -> Column:
    """The text without the character at the index; the whole text for -1."""
    return F.concat(F.substr(text, F.lit(1), F.greatest(at, F.lit(0))), F.substr(text, at + 2))


def _roles(segments: int) -> Column:
    """Role 0: the line is the shorter or equal one of a pair; role 1: it is one longer."""
    return F.inline(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(j).alias("j")) for r in (0, 1) for j in range(segments)]))


def contexts(lines: DataFrame, segments: int, *keep: str) -> DataFrame:
    return lines.select(*keep, "line", _roles(segments)).withColumn("context", _context(segments))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one line has; partial sums keep one row per key and task."""
    keys = rows.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select(key)
    keys = written(keys, "keys")
    return broadcast_if_small(keys, keys.count(), BROADCAST_KEYS)


def near_lines(lines: DataFrame, texts: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(h1, h2, best): the earliest place of a line within one edit, for lines that have one earlier.

    lines: h1, h2, halves (contexts of the two halves in both roles).
    texts: h1, h2, line, place for any of the same lines, possibly repeated.
    """
    halves = lines.filter("halves is not null").select("h1", "h2", F.explode("halves").alias("context"))
    some = halves.join(_shared(halves, "context"), "context", "left_semi").select("h1", "h2").distinct()
    some = written(some, "lines")
    chosen = texts.join(broadcast_if_small(some, some.count(), BROADCAST_KEYS), ["h1", "h2"], "left_semi")
    chosen = written(chosen.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min("place").alias("place")), "lines")
    cut = contexts(chosen, segments, "h1", "h2", "place")
    cut = cut.join(_shared(cut, "context"), "context", "left_semi").withColumn("middle", _middle(segments))
    at = F.explode(F.sequence(F.col("r") - 1, F.length("middle") - 1))  # -1: nothing deleted, for role 0 only
    variants = cut.select("h1", "h2", "place", "context", "r", "middle", at.alias("at"))
    # role 1 deletes: within a run of equal characters any deletion gives the same rest, so the last stands for all
    last = F.substr("middle", F.col("at") + 1, F.lit(1)) != F.substr("middle", F.col("at") + 2, F.lit(1))
    variants = variants.filter((F.col("r") == 0) | last)
    rest = _without("middle", F.col("at"))
    replaced = (F.col("r") == 0) & (F.col("at") >= 0)  # equal rest at the same place: one character differs
    variants = variants.select(
        "h1", "h2", "place", "middle", "at", F.when(replaced, F.xxhash64("context", rest, "at")).otherwise(F.xxhash64("context", rest, F.lit(-1))).alias("variant"),
        F.when(replaced, "replaced").when(F.col("at") < 0, "whole").otherwise("deleted").alias("kind"),
    )
    variants = variants.join(_shared(variants, "variant"), "variant", "left_semi")
    # different lines with one variant differ in a character of it at most, so these groups stay small
    group = Window.partitionBy("variant")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("place", "h1", "h2", "middle", "at"))).over(group)
    variants = variants.withColumns({"_replaced": least("replaced"), "_whole": least("whole"), "_deleted": least("deleted")})
    other = F.when(F.col("kind") == "replaced", F.col("_replaced")).when(F.col("kind") == "whole", F.col("_deleted")).otherwise(F.col("_whole"))
    pairs = variants.select("h1", "h2", "place", "middle", "at", other.alias("other")).filter("other.place < place")
    # equal once each side's character is out: what follows compares few whole lines
    pairs = pairs.filter(_without("middle", F.col("at")) == _without("other.middle", F.col("other.at")))
    pairs = written(pairs.groupBy("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).agg(F.min("other.place").alias("best")), "pairs")
    near = broadcast_if_small(pairs, pairs.count(), BROADCAST_KEYS)
    both = chosen.select("h1", "h2", "line").join(near, ["h1", "h2"])
    other = chosen.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    both = other.join(both, ["o1", "o2"]).filter(F.levenshtein("line", "other", 1) >= 0)
    return both.groupBy("h1", "h2").agg(F.min("best").alias("best"))


def dropped_lines(docs: DataFrame, min_chars: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, text_hash, dropped): line numbers that repeat an earlier line within one edit."""
    keyed = doc_key(docs)
    line = F.col("line")
    cut = keyed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line <> ''")
    cut = cut.withColumns({"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(1), line)})
    cut = cut.withColumn("place", F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), F.col("text_hash").alias("t"), F.col("pos").alias("p")))
    parts = []
    for r in (0, 1):
        m = F.length(line) - r
        h = F.floor(m / 2).cast("int")
        parts += [F.xxhash64(m, F.lit(0), F.lit(""), F.substr(line, F.length(line) - (m - h) + 1, m - h)), F.xxhash64(m, F.lit(1), F.substr(line, F.lit(1), h), F.lit(""))]
    lines = written(cut.select("doc_id", "text_hash", "pos", "h1", "h2", F.when(F.length(line) >= min_chars, F.array(*parts)).alias("halves")), "lines")
    place = F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), F.col("text_hash").alias("t"), F.col("pos").alias("p"))
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    near = near_lines(lines, cut.select("h1", "h2", "line", "place"), segments)
    best = firsts.unionByName(near).groupBy("h1", "h2").agg(F.min("best").alias("best"))
    best = written(best, "lines")
    late = lines.select("doc_id", "text_hash", "pos", "h1", "h2").join(broadcast_if_small(best, best.count(), BROADCAST_KEYS), ["h1", "h2"]).filter(place > F.col("best"))
    return late.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """Drop each line that equals, or is within one edit of, a line that starts earlier.

    Returns all columns of docs with text replaced by the lines kept, and
    n_lines (lines that are not empty) and n_removed. Documents are ordered by
    doc_id, null first, then by a hash of the text; rows equal in both count as
    one document. Lines are judged on the input, at any length. Empty lines
    stay. By default lines of every length are compared; a caller who gives
    min_chars exempts shorter ones from the edit, which then go only for an equal
    line. Columns of docs named n_lines or n_removed are replaced. A null text
    has no lines and stays null. An empty table gives no rows.
    """
    found = dropped_lines(docs, min_chars, segments)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # columns of docs may have any name
    rows = docs.toDF(*names.values())
    rows = rows.withColumns({"doc_id": F.col(names["doc_id"]), "text_hash": F.xxhash64(F.coalesce(F.col(names["text"]), F.lit("")))})
    rows = same_doc(rows, found, "left").withColumn("lines", F.split(names["text"], "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col(names["text"])).otherwise(kept)
    n_lines = F.coalesce(F.size(F.filter("lines", lambda x: x != "")), F.lit(0)).cast("long")
    return rows.select(
        *[(text if c == "text" else F.col(n)).alias(c) for c, n in names.items() if c.lower() not in ("n_lines", "n_removed")],
        F.when(F.col(names["text"]).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_removed"),
    )
