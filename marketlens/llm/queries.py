"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import ann, centroids, decontamination, exact_topk, line_dedup, mixing, quality, resampling, simhash, substring_dedup, suffix_dedup, toxicity, warc
from marketlens.plans.registry import Registry
from marketlens.sources.tables import table

REGISTRY = Registry()

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM d
"""


@REGISTRY.query(OP3_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, row_number() OVER lv AS place,
         ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM w WINDOW lv AS (ORDER BY cap / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least(coalesce((SELECT min_by(share, place) FROM f WHERE share <= cap / weight) * weight, cap), cap) AS target FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), g AS (
  SELECT d.source, h, sum(size) AS tokens, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d GROUP BY d.source, h
), cut AS (
  SELECT g.source, min(h) AS h, min_by(tokens, h) AS tokens, min_by(target - copies * source_size - (upto - tokens), h) AS rest
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
  WHERE copies * source_size < target AND upto > target - copies * source_size GROUP BY g.source
)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN d.h < cut.h OR (d.h = cut.h AND tokens - rest < rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""


@REGISTRY.query(OP8_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM w, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)
), hits AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), cov AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@REGISTRY.query(OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@REGISTRY.query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@REGISTRY.query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), digest=True)


@REGISTRY.query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), digest=True)


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), o AS (
  SELECT doc_id, pos, line, doc_id * 10000000 + pos AS place FROM l WHERE line <> ''
), u AS (
  SELECT line, length(line) AS n, min(place) AS place FROM o GROUP BY line
), k AS (
  SELECT line, n, place, n - r AS m, unnest([
    'p' || left(line, (n - r) // 2), 's' || right(line, (n - r) - (n - r) // 2)
  ]) AS half FROM u, (SELECT unnest([0, 1]) AS r)
), c AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n AS an, b.n AS bn, b.place AS place
  FROM k a JOIN k b ON a.m = b.m AND a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1
), near AS (
  SELECT a AS line, min(place) AS best FROM c
  WHERE len(list_filter(range(least(an, bn) + 1), lambda i: left(a, i) = left(b, i)
    AND substr(a, i + 1 + CASE WHEN an >= bn THEN 1 ELSE 0 END) = substr(b, i + 1 + CASE WHEN bn >= an THEN 1 ELSE 0 END))) > 0
  GROUP BY a
), j AS (
  SELECT o.*, o.place > least(u.place, coalesce(near.best, u.place)) AS late FROM o JOIN u USING (line) LEFT JOIN near USING (line)
)
SELECT l.doc_id, count(*) FILTER (WHERE l.line <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE late)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE late IS NOT TRUE), '')) AS kept_sha256
FROM l LEFT JOIN j USING (doc_id, pos) GROUP BY l.doc_id
"""


@REGISTRY.query(OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@REGISTRY.query()
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@REGISTRY.query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE bit_steps AS (
  SELECT b, b AS c, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit_steps WHERE k < 8
), steps AS (
  SELECT list(c ORDER BY b) AS step FROM bit_steps WHERE k = 8
), x AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT row_number() OVER () AS n, side, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x
), f AS (
  SELECT n, side, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS feature FROM w
), hexed AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)
), buckets AS (
  SELECT feature, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM hexed, steps
), fb AS (
  SELECT n, side, bucket FROM f JOIN buckets USING (feature)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM fb GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS g FROM counts
), weights AS (
  SELECT n, count(*)::BIGINT AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 0 GROUP BY n
), d AS (
  SELECT n, doc_id, len(ws) >= 20 AS fits, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weights USING (n) WHERE side = 0
), o AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST)::BIGINT AS place FROM d WHERE fits
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM o) // 100 THEN place END AS rank
FROM d LEFT JOIN o USING (n)
"""


@REGISTRY.query(OP11_SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_sql(rounds: int = 10) -> str:
    """The rounds one after another: c0 are the first centroids, a1 the first assignment, c1 the next centroids."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM v QUALIFY c < 8
)"""
    ]
    for r in range(1, rounds + 2):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, v, min(struct_pack(d := d, c := c)) AS m FROM (
    SELECT n, vec_id, v.v AS v, c, (list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c{r - 1}.v) + list_dot_product(c{r - 1}.v, c{r - 1}.v))::BIGINT AS d
    FROM v, c{r - 1}) GROUP BY n, vec_id, v
)""")
        if r <= rounds:
            steps.append(f"""c{r} AS MATERIALIZED (
  SELECT c, coalesce(u.v, c{r - 1}.v) AS v FROM c{r - 1} LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS v FROM (
      SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT m.c AS k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i) GROUP BY k
  ) AS u ON c = k
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
       (SELECT sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT::VARCHAR), ',')) FROM c{rounds} AS c WHERE c.c = a.m.c) AS centroid_sha256
FROM a{rounds + 1} AS a
"""


@REGISTRY.query(op12_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n AS qn, q.vec_id AS query_id, v.n, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON q.n <> v.n AND len(q.c) = len(v.c) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, n)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@REGISTRY.query(OP13_SQL)
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
