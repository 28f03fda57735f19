"""Keyed state as merges: full outer joins and anti-joins instead of in-place writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCONTINUE_DAYS = 30
ALERT_HOURS = 24


def merge_state(state: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Price, times and (if given) store count of updated products; status never comes back."""
    old, new = state.alias("o"), updates.alias("n")
    hit = F.col("n.product_id").isNotNull()
    return old.join(new, F.col("o.product_id") == F.col("n.product_id"), "full").select(
        F.coalesce("o.product_id", "n.product_id").alias("product_id"), F.when(hit, F.col("n.lowest_price")).otherwise(F.col("o.lowest_price")).alias("lowest_price"),
        F.coalesce("n.store_count", "o.store_count").alias("store_count"), F.when(hit, as_of).otherwise(F.col("o.last_seen")).alias("last_seen"), F.coalesce("o.status", F.lit("discovered")).alias("status"),
    )


def discontinue(state: DataFrame, as_of: Column, days: int = DISCONTINUE_DAYS) -> DataFrame:
    """Products not seen for `days` (or never) become discontinued."""
    old = F.coalesce(F.col("last_seen") < F.date_sub(as_of, days), F.lit(True))
    return state.withColumn("status", F.when(old, "discontinued").otherwise(F.col("status")))


def merge_mappings(mappings: DataFrame, found: DataFrame) -> DataFrame:
    """Matches by store and store product; a mapping that is not pending stays as it is, of several new ones the last wins."""
    last = found.groupBy("store_id", "store_product_id").agg(F.max_by(F.struct("product_id", "confidence"), "ord").alias("f"))
    new = last.select("store_id", "store_product_id", "f.product_id", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("f.confidence") + 0.5))).cast("int").alias("confidence"))
    o, n = mappings.alias("o"), new.alias("n")
    keep = F.col("n.product_id").isNull() | (F.col("o.status").isNotNull() & (F.col("o.status") != "pending"))
    pick = lambda c: F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    same = (F.col("o.store_id") == F.col("n.store_id")) & (F.col("o.store_product_id") == F.col("n.store_product_id"))
    return o.join(n, same, "full").select(
        F.coalesce("o.store_id", "n.store_id").alias("store_id"), F.coalesce("o.store_product_id", "n.store_product_id").alias("store_product_id"),
        pick("product_id"), pick("confidence"), F.coalesce("o.status", F.lit("pending")).alias("status"),
    )


def bounded_log(log: DataFrame, most: int) -> DataFrame:
    """The newest rows by id."""
    return log.orderBy(F.desc("id")).limit(most)


def upsert_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """New thresholds for known alerts, whose other columns stay; unknown alerts are added."""
    key = ["product_id", "subscriber"]
    changed = new.withColumnRenamed("threshold", "wanted")
    return alerts.join(changed, key, "full").select(*key, F.coalesce("wanted", "threshold").alias("threshold"), "last_notified")


def due_alerts(alerts: DataFrame, lowest: DataFrame, as_of: Column) -> DataFrame:
    """Alerts whose threshold is reached and that were not sent within 24 hours."""
    quiet = F.col("last_notified").isNull() | (F.col("last_notified") < as_of - F.expr(f"INTERVAL {ALERT_HOURS} HOURS"))
    return alerts.join(lowest, "product_id").filter((F.col("threshold") >= F.col("lowest_price")) & quiet)


def mark_alerts(alerts: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Alerts that were sent get the time of sending."""
    key = ["product_id", "subscriber"]
    hit = sent.select(*key).distinct().withColumn("hit", F.lit(True))
    return alerts.join(hit, key, "left").select(*key, "threshold", F.when(F.col("hit"), as_of).otherwise(F.col("last_notified")).alias("last_notified"))


def probe_flips(probes: DataFrame) -> DataFrame:
    """Probes at which a service came up: up now, and down or unknown before."""
    before = F.lag("status").over(Window.partitionBy("service").orderBy("at", "id"))
    return probes.withColumn("before", before).filter("status = 'up' and (before is null or before <> 'up')").select("service", "id", "at")


def record_probes(services: DataFrame, probes: DataFrame, notified: DataFrame) -> DataFrame:
    """service, last_status, last_checked, last_notified after new probes; the time of the last notice stays until there is another.

    services: as returned; probes: service, id, at, status; notified: service, at
    of notices that went out.
    """
    last = probes.groupBy("service").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.max("at").alias("at"))
    told = notified.groupBy("service").agg(F.max("at").alias("told"))
    rows = services.join(last, "service", "full").join(told, "service", "left")
    return rows.select("service", F.coalesce("status", "last_status").alias("last_status"), F.coalesce("at", "last_checked").alias("last_checked"), F.greatest("told", "last_notified").alias("last_notified"))


def latest_probe(probes: DataFrame) -> DataFrame:
    return probes.groupBy("service").agg(F.max(F.struct("at", "id", "status")).alias("m")).select("service", F.col("m.status").alias("status"), F.col("m.at").alias("at"))
