"""Search by an inverted table of character grams, for batches of queries.

A word may lie anywhere inside a field, so it cannot be looked up as a word; but
every gram of three characters in it (of two or one, where it is shorter) must
be in the product. Of all grams of a query the rarest decides: its postings are
the candidates, and these are verified by the rule of ``search.search`` on the
fields themselves. Postings are partitioned by a hash of the gram and sorted in
their files, so a batch reads only the parts of its own grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.rows import spread

GRAM = 3
PARTS = 64
#: Queries of a batch up to which their grams are broadcast.
BROADCAST_QUERIES = 100_000


def _fields() -> list[Column]:
    """The texts that a word may lie in; the search terms count as one text."""
    return [F.lower(F.coalesce("family", F.lit(""))), F.lower(F.coalesce("brand", F.lit(""))), F.lower(F.coalesce("model_number", F.lit(""))), F.lower(F.concat_ws(" ", "search_terms"))]


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(PARTS))


@dataclass(frozen=True)
class SearchIndex:
    """Where the postings (part, gram, id) and the counts (gram, n) of an index lie, and its products."""

    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        kind = self.products(spark).schema["id"].dataType.simpleString()
        return spark.read.schema(f"gram string, id {kind}, part int").parquet(f"{self.path}/postings")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, n long").parquet(f"{self.path}/counts")

    def products(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/products")


def build(products: DataFrame, path: str) -> SearchIndex:
    """Writes the index of products: id (unique), family, brand, model_number, search_terms and whatever else a search shall return."""
    products.write.parquet(f"{path}/products")
    index, spark = SearchIndex(path), products.sparkSession
    every = F.array_distinct(F.flatten(F.array(*[_grams(f, n) for f in _fields() for n in range(1, GRAM + 1)])))
    products = spread(index.products(spark), "id")  # their file may be one task
    rows = products.select("id", F.explode(every).alias("gram")).withColumn("part", _part(F.col("gram")))
    # rebalance keeps a common gram from becoming one task and one file
    rows.hint("rebalance", "part").sortWithinPartitions("part", "gram", "id").write.partitionBy("part").parquet(f"{path}/postings")
    index.postings(spark).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
    return index


def asked(queries: DataFrame) -> DataFrame:
    """query_id, q and words of queries: query_id (unique), query. Blank queries go."""
    q = F.lower(F.regexp_replace("query", r"^\s+|\s+$", ""))
    return queries.select("query_id", q.alias("q")).withColumn("words", F.filter(F.split("q", r"\s+"), lambda w: w != "")).filter(F.size("words") > 0)


def rarest(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """query_id and the gram of a query that the fewest products have; a query with a gram that none has is left out."""
    own = F.flatten(F.transform("words", lambda w: F.when(F.length(w) >= GRAM, _grams(w, GRAM)).otherwise(F.array(w))))
    grams = queries.select("query_id", F.explode(F.array_distinct(own)).alias("gram")).join(counts, "gram", "left")
    best = grams.groupBy("query_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lacking"))
    return best.filter("lacking = 0").select("query_id", "gram")


def candidates(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """query_id and id to verify. queries: as of ``asked``."""
    spark = queries.sparkSession
    chosen = rarest(queries, index.counts(spark)).withColumn("part", _part(F.col("gram")))
    if queries.count() <= BROADCAST_QUERIES:
        chosen = F.broadcast(chosen)
    return index.postings(spark).join(chosen, ["part", "gram"]).select("query_id", "id")


def search(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """query_id, score and the products of each query of a batch, by the rule and the score of ``search.search``.

    queries: query_id (unique), query. Null and blank queries find nothing.
    """
    spark = queries.sparkSession
    wanted = asked(queries)
    rows = candidates(index, wanted).join(wanted, "query_id").join(index.products(spark), "id")
    fields = _fields()
    held = lambda w: fields[0].contains(w) | fields[1].contains(w) | fields[2].contains(w) | fields[3].contains(w)
    rows = rows.filter(F.forall("words", held))
    family, q = fields[0], F.col("q")
    hits, n = F.size(F.filter("words", lambda w: family.contains(w))), F.size("words")
    score = (
        F.when(family.contains(q), 100.0).otherwise(0.0) + hits * 10 + F.when(hits == n, 20).otherwise(0) + F.when(family.startswith(q), 30).otherwise(0)
        + hits / F.size(F.split(family, r"\s+")) * 20 - F.length("family") * 0.15
    )
    return rows.withColumn("score", score).drop("words", "q")


def suggestions(index: SearchIndex, queries: DataFrame, k: int = 6) -> DataFrame:
    """The k best products of each query, with place from 1."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return search(index, queries).withColumn("place", place).filter(F.col("place") <= k)
