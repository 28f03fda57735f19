"""The streaming forms give what the batch rules give, once, and forget what they may."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import pricequery, state
from marketlens.sources import adapters as A
from marketlens.streaming import facade
from marketlens.streaming.refresh import ALERTS, MAPPINGS, STATE, RefreshTables

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 3, 1, 12)


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def stream_of(spark, path, schema, *files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_probe_flips_match_the_batch_rule(spark, tmp_path):
    probes = A.probes(spark, SF).selectExpr("service", "id", "cast(at as timestamp) as at", "status")
    probes.coalesce(1).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(probes.schema).parquet(f"{tmp_path}/p")
    expected = sorted((r.service, r.id) for r in state.probe_flips(probes).collect())
    assert sorted((r.service, r.id) for r in run(spark, facade.probe_flips(stream), "flips")) == expected


def test_daily_minimum(spark, tmp_path):
    rows = A.observations(spark, SF).selectExpr("product_id", "store_id", "cast(day as timestamp) as at", "price")
    rows.coalesce(1).write.parquet(f"{tmp_path}/o")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/o")
    out = run(spark, facade.daily_minimum(stream), "low", "update")
    assert len(out) == rows.select("product_id", "store_id", "at").distinct().count()


def test_alert_notices_keep_silent_and_forget(spark, tmp_path):
    at = lambda hours: NOW + timedelta(hours=hours)
    hit = lambda subscriber, hours: (1, subscriber, at(hours), float(hours))
    files = [[hit(1, 0), hit(1, 5), hit(2, 3)], [hit(1, 24), hit(1, 24.5), hit(1, 49)], [hit(3, 200)], [hit(3, 201), hit(2, 201)]]
    stream = stream_of(spark, tmp_path / "h", "product_id long, subscriber long, at timestamp, price double", *files)
    query = facade.alert_notices(stream).writeStream.outputMode("append").format("memory").queryName("notices").trigger(availableNow=True).start()
    query.awaitTermination()
    sent = sorted((r.subscriber, r.price) for r in spark.table("notices").collect())
    assert sent == [(1, 0.0), (1, 24.5), (1, 49.0), (2, 3.0), (2, 201.0), (3, 200.0)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 2 and states[-1] == 2  # subscriber 1 is forgotten


def test_probe_states_fall(spark, tmp_path):
    at = lambda hours: NOW + timedelta(hours=hours)
    files = [[(1, 1, at(0), "up"), (2, 2, at(0), "up")], [(1, 3, at(300), "up")], [(1, 4, at(301), "up"), (2, 5, at(301), "up")], [(2, 6, at(302), "up")]]
    stream = stream_of(spark, tmp_path / "p", "service long, id long, at timestamp, status string", *files)
    flips = sorted(r.id for r in run(spark, facade.probe_flips(stream, forget_hours=200), "forgotten"))
    assert flips == [1, 2, 3, 5]  # both were forgotten after 200 hours


OFFER = "product_id long, store_id long, price double, in_stock boolean, error string, store_product_id string, confidence double, suspicious boolean, overpriced boolean, at timestamp"


def offer(product, store, price, minutes, error=None, suspicious=False):
    return (product, store, price, True, error, f"n{product}" if store == 3 else None, 80.0 if store == 3 else None, suspicious, False, NOW + timedelta(minutes=minutes))


FILES = [
    [offer(1, 1, 10.0, 0), offer(1, 2, 1.0, 0, suspicious=True), offer(2, 3, 20.0, 0), offer(2, 1, None, 0, "timeout")],
    [offer(1, 3, 9.0, 60), offer(3, 3, 5.0, 60), offer(4, 1, None, 60, "not_found")],
    [offer(2, 1, 18.0, 120), offer(3, 3, 4.0, 120)],
]


def tables(spark, path):
    out = RefreshTables(spark, str(path))
    old = NOW - timedelta(days=3)
    out.load(
        spark.createDataFrame([(2, 7.0, 1, old.date(), "discontinued")], STATE), spark.createDataFrame([(3, "n1", 77, 50, "approved"), (3, "n2", 77, 50, "pending")], MAPPINGS),
        spark.createDataFrame([(1, 5, 10, None), (2, 5, 19, old), (2, 6, 100, NOW - timedelta(hours=2)), (3, 5, 5, None)], ALERTS),
    )
    return out


def contents(t):
    text = lambda df: sorted(map(str, df.collect()))
    return [text(df) for df in (t.state.read(), t.mappings.read(), t.alerts.read(), t.history.read(), t.notices().drop("batch"), t.errors().drop("batch"))]


def by_hand(spark, path):
    """The batch rule, file after file."""
    t = tables(spark, path)
    for n, rows in enumerate(FILES):
        t.apply(spark.createDataFrame(rows, OFFER), n)
    return t


def test_refresh_tables_hold_what_the_rules_say(spark, tmp_path):
    t = by_hand(spark, tmp_path / "t")
    assert {(r.product_id, r.lowest_price, r.store_count, r.status) for r in t.state.read().collect()} == {(1, 9.0, 1, "discovered"), (2, 18.0, 1, "discontinued"), (3, 4.0, 1, "discovered")}
    assert {(r.store_product_id, r.product_id, r.status) for r in t.mappings.read().collect()} == {("n1", 77, "approved"), ("n2", 2, "pending"), ("n3", 3, "pending")}
    # 2 is told to subscriber 5 only when 18 comes; 3 is told once, not again an hour later; 6 had a notice two hours ago
    assert sorted((r.product_id, r.subscriber, r.lowest_price) for r in t.notices().collect()) == [(1, 5, 10.0), (2, 5, 18.0), (3, 5, 5.0)]
    assert [(r.product_id, r.message) for r in t.errors().collect()] == [(2, "timeout")]
    assert {(r.product_id, r.store_id, r.price) for r in t.history.read().collect()} == {(1, 1, 10.0), (1, 2, 1.0), (1, 3, 9.0), (2, 1, 18.0), (2, 3, 20.0), (3, 3, 4.0), (4, 1, None)}


@pytest.mark.parametrize("broken", ["state", "mappings", "alerts"])
def test_a_restart_changes_nothing_twice(spark, tmp_path, broken, monkeypatch):
    expected = contents(by_hand(spark, tmp_path / "plain"))
    t = tables(spark, tmp_path / "stream")
    stream = stream_of(spark, tmp_path / "in", OFFER, *FILES)
    table, failed = getattr(t, broken), []
    whole = table.overwrite

    def overwrite(rows, based_on=None, batch=None):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost")
        return whole(rows, based_on, batch)

    monkeypatch.setattr(table, "overwrite", overwrite)
    with pytest.raises(Exception, match="lost"):
        t.run(stream).awaitTermination()
    assert failed == [1]
    t.run(stream).awaitTermination()
    assert contents(t) == expected
    t.apply(spark.createDataFrame(FILES[2], OFFER), 2)  # a batch that is done comes again
    assert contents(t) == expected


def test_an_empty_batch(spark, tmp_path):
    t = tables(spark, tmp_path / "t")
    before = contents(t)
    t.apply(spark.createDataFrame([], OFFER), 0)
    assert contents(t) == before and t.alerts.batch() == -1
