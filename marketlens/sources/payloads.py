"""Captured bodies, parsed once: items that can be read, and a side table of what cannot, with the reason.

A body that is no JSON, lacks its list or holds items without what they need
does not vanish: it is kept with its reason, and the rest goes on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.sources.shared import shared_dir

EMPTY, UNREADABLE, NO_LIST, LACKING = "empty body", "unreadable body", "no list", "item lacks "


def parsed(payloads: DataFrame, items: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """The columns of payloads, and pos, item (variant, null where there is none) and reason (null where all is well).

    payloads: body and others. items: path of the list in a body, such as
    ``$.products`` or ``$``; needed: paths that every item must have a value at,
    such as ``$.title``. A body without a list has one row; a list without items
    has none.
    """
    body = F.col("body")
    rows = payloads.withColumn("_v", F.try_parse_json(body))
    rows = rows.withColumn("_items", F.try_variant_get("_v", items, "array<variant>"))
    whole = F.when(F.coalesce(body, F.lit("")).rlike(r"^\s*$"), EMPTY).when(F.col("_v").isNull(), UNREADABLE).when(F.col("_items").isNull(), NO_LIST)
    rows = rows.withColumn("_whole", whole).drop("_v")
    none = F.array(F.lit(None).cast("variant"))
    rows = rows.select(*payloads.columns, "_whole", F.posexplode(F.when(F.col("_whole").isNull(), F.col("_items")).otherwise(none)).alias("pos", "item"))
    lacks = [F.when(F.try_variant_get("item", p, "string").isNull(), LACKING + p) for p in needed]
    return rows.withColumn("reason", F.coalesce("_whole", *lacks)).drop("_whole")


def quarantined(payloads: DataFrame, items: str, needed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(items that can be read, rejected): both from one parse, which is written to the shared folder.

    The first has the columns of payloads but body, with pos and item; the
    second all columns, pos and reason, the item as text where one is to blame.
    """
    path = f"{shared_dir(payloads.sparkSession)}/parsed-{uuid.uuid4().hex}"
    parsed(payloads, items, needed).withColumn("body", F.when(F.col("reason").isNotNull(), F.coalesce(F.to_json("item"), "body"))).write.partitionBy("reason").parquet(path)
    rows = payloads.sparkSession.read.option("basePath", path).parquet(path)
    rest = [c for c in payloads.columns if c != "body"]
    return rows.filter("reason is null").select(*rest, "pos", "item"), rows.filter("reason is not null").select(*rest, "body", "pos", "reason")


def rejections(rejected: DataFrame, *by: str) -> DataFrame:
    """Rejected bodies and items by reason (and other columns)."""
    return rejected.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def field(path: str, kind: str = "string") -> Column:
    """A value of an item, null where it is missing or of another kind."""
    return F.try_variant_get("item", path, kind)
