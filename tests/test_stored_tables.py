"""Partitioned history and versioned overwrites: what is rewritten, pruned, kept after failures and between writers."""

import os
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import history
from marketlens.sources.history_table import HistoryTable
from marketlens.sources.snapshots import Conflict, Snapshots

LAST = date(2024, 3, 31)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "product_id long, day date, store_id long, price double")


def day(ago):
    return LAST - timedelta(days=ago)


def filled(spark, path):
    stored = HistoryTable(spark, str(path))
    base = rows(spark, *[(p, day(ago), s, float(p + ago)) for p in range(4) for ago in range(0, 90, 9) for s in (1, 2)])
    stored.upsert(base, LAST)
    return stored, base


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_only_its_days(spark, tmp_path):
    stored, base = filled(spark, tmp_path / "h")
    before = files(tmp_path / "h")
    new = rows(spark, (0, day(0), 1, 50.0), (9, day(9), 3, None), (1, day(4), 2, 7.0), (1, day(4), 2, 6.0), (1, day(4), 2, None), (5, day(300), 1, 1.0))
    assert stored.upsert(new, LAST) == [day(9), day(4), day(0)]
    after = files(tmp_path / "h")
    changed = {f.split("day=")[1][:10] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {d.isoformat() for d in (day(9), day(4), day(0))}
    clean = rows(spark, (0, day(0), 1, 50.0), (9, day(9), 3, None), (1, day(4), 2, 6.0))
    assert sorted(map(str, stored.read().collect())) == sorted(map(str, history.upsert(base, clean).collect()))


def test_retention_drops_partitions_and_reads_prune(spark, tmp_path):
    stored, base = filled(spark, tmp_path / "h")
    later = LAST + timedelta(days=20)
    assert stored.prune(later) == [day(81), day(72)] and len(stored.days()) == 8
    assert sorted(map(str, stored.read().collect())) == sorted(map(str, history.retain(base, F.lit(later)).collect()))
    plan = stored.range(LAST, 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert "(day#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(product_id,3)" in plan.split("PushedFilters: [")[1]
    assert {r.day for r in stored.range(LAST, 10, 3).collect()} == {day(0), day(9)}


def test_failed_upsert_changes_nothing(spark, tmp_path):
    stored, _ = filled(spark, tmp_path / "h")
    before = files(tmp_path / "h")
    broken = rows(spark, (0, day(0), 1, 50.0), (1, day(9), 1, 3.0)).withColumn("price", F.when(F.col("product_id") == 1, F.raise_error(F.lit("no price"))).otherwise(F.col("price")).cast("double"))
    with pytest.raises(Exception, match="no price"):
        stored.upsert(broken, LAST)
    assert files(tmp_path / "h") == before


def test_an_empty_history(spark, tmp_path):
    stored = HistoryTable(spark, str(tmp_path / "none"))
    assert stored.days() == [] and stored.read().collect() == [] and stored.prune(LAST) == [] and stored.upsert(rows(spark), LAST) == []


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def held(stored):
    return sorted(r.n for r in stored.read().collect())


def test_versions(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path / "s"), "n long")
    assert stored.version() == 0 and held(stored) == []
    assert stored.overwrite(numbers(spark, 1, 2)) == 1
    reader = stored.read()
    assert stored.overwrite(numbers(spark, 3)) == 2 and held(stored) == [3]
    assert sorted(r.n for r in reader.collect()) == [1, 2] and sorted(r.n for r in stored.read(1).collect()) == [1, 2]
    stored.merge(lambda df: df.union(numbers(spark, 4)))
    assert held(stored) == [3, 4] and stored.vacuum(1) == [1, 2]
    assert held(stored) == [3, 4] and len([f for f in os.listdir(tmp_path / "s") if f.startswith("data-")]) == 1


def test_a_job_that_fails_half_way_loses_nothing(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path / "s"), "n long")
    stored.overwrite(numbers(spark, 1, 2))
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        stored.overwrite(broken)
    assert held(stored) == [1, 2] and len([f for f in os.listdir(tmp_path / "s") if f.startswith("data-")]) == 1


def test_a_stale_base_is_a_conflict(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path / "s"), "n long")
    stored.overwrite(numbers(spark, 1))
    with pytest.raises(Conflict):
        stored.overwrite(numbers(spark, 2), based_on=0)
    assert held(stored) == [1]
    os.makedirs(tmp_path / "s/_log", exist_ok=True)
    (tmp_path / "s/_log/000000000002").write_text('{"data": "da')  # an entry that is still being written
    assert held(stored) == [1]


def test_two_writers_lose_no_change(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path / "s"), "n long")
    stored.overwrite(numbers(spark, 0))
    failed = []

    def add(value):
        try:
            Snapshots(spark, str(tmp_path / "s"), "n long").merge(lambda df: df.union(numbers(spark, value)), tries=20)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    writers = [threading.Thread(target=add, args=(v,)) for v in (1, 2, 3, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and held(stored) == [0, 1, 2, 3, 4] and stored.version() == 5
