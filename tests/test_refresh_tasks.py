"""The refresh deals its joins out by counted rows, so that the rows of a task do not grow with the tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.functions import rows
from marketlens.operators import pricequery
from marketlens.sources import adapters as A
from marketlens.streaming.refresh import ALERTS, MAPPINGS, STATE, RefreshTables

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 3, 1, 12)


def _offers(spark, n):
    store = F.col("id") % 10
    return spark.range(n).select(
        F.floor(F.col("id") / 10).alias("product_id"), store.alias("store_id"), (F.col("id") % 97 + 1).cast("double").alias("price"), F.lit(True).alias("in_stock"), F.lit(None).cast("string").alias("error"),
        F.concat(F.lit("n"), "id").alias("store_product_id"), F.lit(50.0).alias("confidence"), F.lit(False).alias("suspicious"), F.lit(False).alias("overpriced"), F.lit(NOW).cast("timestamp").alias("at"),
    )


@pytest.mark.parametrize("table", ["mappings", "alerts", "history"])
def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch, table):
    monkeypatch.setattr(rows, "TASK_ROWS", 100)
    tables = RefreshTables(spark, str(tmp_path / "t"))
    alerts = spark.range(2000).selectExpr("id div 10 as product_id", "id % 10 as subscriber", "1000L as threshold", "cast(null as timestamp_ntz) as last_notified")
    tables.load(spark.createDataFrame([], STATE), spark.createDataFrame([], MAPPINGS), alerts)
    dealt = []
    monkeypatch.setattr("marketlens.sources.history_table.dealt", lambda df, tasks, *by: dealt.append(tasks) or rows.dealt(df, tasks, *by))
    tables.apply(_offers(spark, 2000), 0)
    if table == "history":
        assert dealt and set(dealt) == {20} and tables.history.read().count() == 2000
        return
    stored = getattr(tables, table).read()
    files = stored.groupBy(F.input_file_name()).count().collect()
    assert stored.count() == 2000 and len(files) >= 18 and max(r["count"] for r in files) < 200  # one file of 2000 where Spark joined the partitions


def test_dealt_and_undealt_agree(spark):
    offers = _offers(spark, 500)
    tables = {
        "history": spark.createDataFrame([], "product_id long, day date, store_id long, price double"), "state": A.catalogue_state(spark, SF),
        "mappings": spark.createDataFrame([(1, "n1", -1, 1, "approved"), (2, "n2", -1, 1, "pending")], MAPPINGS),
        "alerts": spark.createDataFrame([(i % 7, i, i % 5, None) for i in range(40)], ALERTS),
    }
    plain, dealt = (pricequery.refresh(offers, tables, F.lit(NOW).cast("timestamp_ntz"), n) for n in (None, 13))
    for name in plain:
        assert sorted(map(str, plain[name].collect())) == sorted(map(str, dealt[name].collect())), name
    for adapter in (A.offers, A.alerts, A.catalogue_state):
        assert sorted(map(str, adapter(spark, SF).collect())) == sorted(map(str, adapter(spark, SF, 5).collect()))
