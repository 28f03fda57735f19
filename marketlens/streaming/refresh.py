"""The refresh as a stream: each micro-batch of offers changes the tables exactly once.

A batch goes through the rules of ``pricequery.refresh``. Every table's newest
version names the batch that made it, so a batch that comes again after a
failure skips the tables it has already changed. Notices and errors are folders
by batch, which are overwritten; they are written before the alerts are marked,
so a replay finds the alerts as they were and writes the same notices. History is
an upsert by key and may be repeated. Time is that of the data, never the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.functions.rows import tasks_for
from marketlens.operators import pricequery
from marketlens.sources.history_table import HistoryTable
from marketlens.sources.shared import file_system
from marketlens.sources.snapshots import Snapshots

STATE = "product_id long, lowest_price double, store_count long, last_seen date, status string"
MAPPINGS = "store_id long, store_product_id string, product_id long, confidence int, status string"
ALERTS = "product_id long, subscriber long, threshold long, last_notified timestamp_ntz"
NOTICES = "product_id long, subscriber long, threshold long, lowest_price double, at timestamp_ntz"
ERRORS = "store_id long, error_type string, message string, product_id long"


class RefreshTables:
    """The tables that a refresh changes, under a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.history = HistoryTable(spark, f"{self.path}/history")
        self.state, self.mappings, self.alerts = (Snapshots(spark, f"{self.path}/{n}", s) for n, s in (("state", STATE), ("mappings", MAPPINGS), ("alerts", ALERTS)))

    def load(self, state: DataFrame, mappings: DataFrame, alerts: DataFrame) -> None:
        """The tables as they are before the first batch."""
        for table, rows in ((self.state, state), (self.mappings, mappings), (self.alerts, alerts)):
            table.overwrite(rows)

    def apply(self, offers: DataFrame, batch: int) -> None:
        """One batch of offers: product_id, store_id, price, in_stock, error, store_product_id, confidence, suspicious, overpriced, at. An empty batch changes nothing."""
        offers = offers.persist()
        try:
            now, n = offers.agg(F.max("at"), F.count(F.lit(1))).first()
            if now is None:
                return
            at = F.lit(now).cast("timestamp_ntz")
            tables = {"history": self.spark.createDataFrame([], self.history.schema).select("product_id", "day", "store_id", "price"), "state": self.state.read(), "mappings": self.mappings.read(), "alerts": self.alerts.read()}
            day = self.history.read().filter(F.col("day") == F.lit(now.date()))
            tasks = tasks_for(self.spark, n, day.count(), *(tables[t].count() for t in ("state", "mappings", "alerts")))
            found = pricequery.refresh(offers, tables, at, tasks)
            if self.alerts.batch() < batch:
                due = found["due"].select("product_id", "subscriber", "threshold", "lowest_price", at.alias("at"))
                due.write.mode("overwrite").parquet(f"{self.path}/notices/batch={batch}")
                found["errors"].write.mode("overwrite").parquet(f"{self.path}/errors/batch={batch}")
            self.history.upsert(offers.select("product_id", at.cast("date").alias("day"), "store_id", "price"), now.date(), tasks)
            for name in ("state", "mappings", "alerts"):  # alerts last: they tell that the batch is done
                table = getattr(self, name)
                if table.batch() < batch:
                    table.overwrite(found[name], table.version(), batch)
        finally:
            offers.unpersist()

    def _by_batch(self, name: str, schema: str) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}") if fs.exists(at) else self.spark.createDataFrame([], f"{schema}, batch long")

    def notices(self) -> DataFrame:
        """Notices that were due, with the batch that found them."""
        return self._by_batch("notices", NOTICES)

    def errors(self) -> DataFrame:
        return self._by_batch("errors", ERRORS)

    def run(self, offers: DataFrame, **trigger) -> StreamingQuery:
        """Starts the stream; it goes on after the last batch that was done. By default all that is there is read."""
        writer = offers.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
