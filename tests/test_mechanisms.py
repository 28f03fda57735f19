"""Rejected payloads, pages in a language's order, merges without a shuffle of the stored side."""

import json

from pyspark.sql import functions as F

from marketlens.operators import search, state
from marketlens.sources import payloads
from marketlens.sources.snapshots import Snapshots


def test_broken_bodies_are_kept_with_their_reasons(spark):
    good = json.dumps({"products": [{"title": "A", "id": 1}, {"id": 2}, {"title": None, "id": 3}, "text", {"title": "B"}]})
    bodies = [good, "{", None, " \n", '{"products":{}}', "[1]", '{"products":[]}', '"text"', good[:-3]]
    rows = spark.createDataFrame([("s", i, b) for i, b in enumerate(bodies)], "store string, at int, body string")
    fine, rejected = payloads.quarantined(rows, "$.products", ("$.title",))
    assert sorted((r.at, r.pos, r.title) for r in fine.select("at", "pos", payloads.field("$.title").alias("title")).collect()) == [(0, 0, "A"), (0, 4, "B")]
    assert sorted((r.at, r.pos, r.reason) for r in rejected.collect()) == [
        *[(0, n, "item lacks $.title") for n in (1, 2, 3)], (1, 0, "unreadable body"), (2, 0, "empty body"), (3, 0, "empty body"), (4, 0, "no list"), (5, 0, "no list"), (7, 0, "no list"), (8, 0, "unreadable body")]
    kept = {(r.at, r.pos): r.body for r in rejected.collect()}
    assert kept[(8, 0)] == good[:-3] and json.loads(kept[(0, 1)]) == {"id": 2}
    assert {(r.reason, r.n) for r in payloads.rejections(rejected).collect()} == {("item lacks $.title", 3), ("unreadable body", 2), ("empty body", 2), ("no list", 3)}


def test_an_empty_table_of_payloads(spark):
    fine, rejected = payloads.quarantined(spark.createDataFrame([(None,), ("[]",)], "body string"), "$")
    assert fine.collect() == [] and [r.reason for r in rejected.collect()] == ["empty body"]


NAMES = ["zebra", "Éclair", "eclair", "Eclair", "ëndërr", "endrra", "çaj", "caj", "Çaj 2", "dash", "a b", "ab", "A", "a", "eclair", None, None, "Ünder", "under"]


def test_pages_follow_the_language_without_gap_or_repeat(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, family string")
    pages, after = [], None
    while found := search.collated_page(rows, after, size=4).collect():
        pages += found
        after = (found[-1].family, found[-1].id)
    assert sorted(r.id for r in pages) == list(range(len(NAMES)))
    assert [r.family for r in pages] == ["a", "A", "a b", "ab", "caj", "çaj", "Çaj 2", "dash", "eclair", "eclair", "Eclair", "Éclair", "ëndërr", "endrra", "under", "Ünder", "zebra", None, None]
    loose = [r.family for r in search.collated_page(rows, None, collation="UNICODE_CI_AI", size=4).collect()]
    assert loose == ["A", "a", "a b", "ab"]  # equal names go by id


def test_a_page_is_a_top_k(spark):
    plan = search.collated_page(spark.range(1000).select("id", F.col("id").cast("string").alias("family")), ("500", 500))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Filter" in plan


STATE = "product_id long, lowest_price double, store_count long, last_seen date, status string"


def test_a_merge_shuffles_its_updates_only(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path / "s"), STATE, (("product_id",), 8))
    day = F.to_date(F.lit("2024-01-01"))
    stored.overwrite(spark.range(5000).select(F.col("id").alias("product_id"), F.col("id").cast("double").alias("lowest_price"), F.lit(1).cast("long").alias("store_count"), day.alias("last_seen"), F.lit("discovered").alias("status")))
    new = spark.range(4990, 5010).select(F.col("id").alias("product_id"), F.lit(0.5).alias("lowest_price"), F.lit(9).cast("long").alias("store_count"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.merge_state(stored.read(), new, day)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored_side, new_side = plan.split("SortMergeJoin")[1].split("FileScan parquet")[0], plan.split("Range (4990")[0].rsplit("FileScan parquet", 1)[1]
    assert "Exchange" not in stored_side and "Exchange" in new_side
    plain = state.merge_state(spark.read.parquet(str(tmp_path / "s" / stored.log()[1]["data"])), new, day)
    expected = sorted(map(str, plain.collect()))
    stored.merge(lambda rows: state.merge_state(rows, new, day))
    assert sorted(map(str, stored.read().collect())) == expected and len(expected) == 5010
    # another session knows the buckets from the definition that read makes
    other = Snapshots(spark.newSession(), str(tmp_path / "s"), STATE, (("product_id",), 8))
    assert other.read().count() == 5010
    assert stored.vacuum(1) == [1] and stored.read().count() == 5010
