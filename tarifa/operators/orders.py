"""Own orders: revenue and units, by order and by product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(orders: DataFrame) -> DataFrame:
    """One row over orders that aren't excluded: orders, units, revenue in cents."""
    units = F.aggregate(F.coalesce("items", F.array().cast("array<struct<sku:bigint,qty:bigint,cents:bigint>>")), F.lit(0).cast("long"), lambda a, i: a + i["qty"])
    cents = F.aggregate(F.coalesce("items", F.array().cast("array<struct<sku:bigint,qty:bigint,cents:bigint>>")), F.lit(0).cast("long"), lambda a, i: a + i["cents"])
    return orders.where("NOT excluded").agg(F.count("*").alias("orders"), F.sum(units).alias("units"), F.sum(cents).alias("revenue"))


def by_sku(orders: DataFrame) -> DataFrame:
    items = orders.where("NOT excluded").select(F.explode("items").alias("i"))
    return items.groupBy("i.sku").agg(F.sum("i.qty").alias("units"), F.sum("i.cents").alias("revenue"))
