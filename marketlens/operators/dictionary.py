"""Dictionary rules as joins: texts against tables of terms of any size.

A term fits where it stands in a text with a boundary on either side. Boundaries
lie between ASCII word characters and others, so a fitting term is a run of whole
segments, the text being cut at every boundary. Runs as long as some term has
segments are exploded and joined to the terms by equality, and the term that is
first in the order of the table decides. The plan does not grow with the table;
a table is broadcast only while it is counted to be small, and what comes of the
texts never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.rows import unbroadcast

#: Terms up to which their table is broadcast.
BROADCAST_TERMS = 200_000
_SEGMENT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def segments(text: Column) -> Column:
    """The text cut at every boundary, without what lies before its first and after its last word."""
    return F.regexp_extract_all(F.regexp_replace(text, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""), F.lit(_SEGMENT), 0)


def runs(text: Column, sizes: list[int]) -> Column:
    """The different runs of so many segments."""

    def of(parts: Column, size: int) -> Column:
        last = F.size(parts) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(parts, i + j) for j in range(size)]))

    # through an array of one, so that the text is cut once and not again for each run
    cut = F.transform(F.array(segments(text)), lambda parts: F.flatten(F.array(*[of(parts, n) for n in sizes])))
    return F.array_distinct(F.flatten(cut))


def first_entries(texts: DataFrame, lexicon: DataFrame, fold=ascii_lower) -> DataFrame:
    """key and ord: the least ord of the terms that each text holds; texts without one are left out.

    texts: key (unique), text; lexicon: ord, word. Case is ignored as ``fold``
    does. Null and empty words and texts fit nothing, nor do words that begin or
    end other than with a letter, digit or underscore. Of the lexicon, one row
    with the different numbers of segments in its terms comes to the driver.
    """
    terms = lexicon.select(fold(F.col("word")).alias("word"), F.col("ord").cast("long").alias("ord")).filter(F.col("word").rlike(r"(?s)^\w(.*\w)?$"))
    terms = terms.groupBy("word").agg(F.min("ord").alias("ord")).withColumn("size", F.size(segments(F.col("word"))))
    sizes, n = terms.agg(F.sort_array(F.collect_set("size")), F.count(F.lit(1))).first()
    if not n:
        return texts.select("key", F.lit(None).cast("long").alias("ord")).limit(0)
    found = texts.select("key", F.explode(runs(fold(F.col("text")), sizes)).alias("word"))
    terms = terms.drop("size")
    hits = found.join(F.broadcast(terms), "word") if n <= BROADCAST_TERMS else unbroadcast(found).join(terms, "word")
    return hits.groupBy("key").agg(F.min("ord").alias("ord"))


def entries(texts: DataFrame, lexicon: DataFrame, *columns: str, fold=ascii_lower) -> DataFrame:
    """key and columns of the lexicon's entry that decides each text. Rows that share an ord are one entry: the values of its least word."""
    best = first_entries(texts, lexicon, fold)
    values = lexicon.groupBy(F.col("ord").cast("long").alias("ord")).agg(*[F.min_by(c, "word").alias(c) for c in columns])
    return unbroadcast(best).join(values, "ord").select("key", *columns)


def first_words(texts: DataFrame, generic: DataFrame) -> DataFrame:
    """key and first_word: the first word of each text that the table of generic words does not have. Texts of such words alone are left out."""
    words = F.filter(F.split(F.regexp_replace("text", "[,;()]", " "), r"\s+"), lambda w: w != "")
    rows = texts.select("key", F.posexplode(words).alias("at", "first_word"))
    stop = generic.select(F.lower("word").alias("stop")).filter("stop is not null").distinct()
    rows = rows.join(stop, F.regexp_replace(F.lower("first_word"), T.MARKS, "") == F.col("stop"), "left_anti")
    least = rows.groupBy("key").agg(F.min("at").alias("at"))
    back = texts.select("key", words.alias("words")).join(unbroadcast(least), "key")
    return back.select("key", F.get("words", F.col("at")).alias("first_word"))


def brands(names: DataFrame, known: DataFrame, generic: DataFrame) -> DataFrame:
    """key and brand of each name, by the rule of ``discovery.brand``: vendor, else a known brand, a console's maker, the first word that is not generic, Unknown.

    names: key (unique), text, vendor; known: ord, word; generic: word.
    """
    texts = names.select("key", "text")
    found = names.join(unbroadcast(entries(texts, known.withColumn("brand", F.col("word")), "brand")), "key", "left").join(unbroadcast(first_words(texts, generic)), "key", "left")
    maker = F.when(F.col("text").rlike(rf"(?i)^\s*(u-)?(ps[45]|playstation\s*[45]){T.B}"), "Sony").when(F.col("text").rlike(rf"(?i)^\s*xbox{T.B}"), "Microsoft")
    vendor = F.when(~F.col("vendor").isin("Others", "Unknown", ""), F.col("vendor"))
    return found.select("key", F.coalesce(vendor, "brand", maker, "first_word", F.lit("Unknown")).alias("brand"))


def categories(texts: DataFrame, rules: DataFrame, default: tuple[str, str] = ("tjera", "Other")) -> DataFrame:
    """key, category, subcategory of each text by the first rule a word of which it holds. texts: key (unique), text; rules: ord, category, subcategory, word."""
    found = texts.select("key").join(unbroadcast(entries(texts, rules, "category", "subcategory", fold=F.lower)), "key", "left")
    none = F.col("category").isNull()
    return found.select("key", F.when(none, default[0]).otherwise(F.col("category")).alias("category"), F.when(none, default[1]).otherwise(F.col("subcategory")).alias("subcategory"))
