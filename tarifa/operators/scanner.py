"""The opportunity scanner: own and rival prices per product, with odd listings set aside."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.model import OUTLIER_SHARE, VARIANT_SHARE
from tarifa.operators.rollups import PAIR, windowed


def listings(rows: DataFrame) -> DataFrame:
    """Per pair the price at its newest crawl: the least of those that aren't a quarter of the run's largest, and how many were."""
    newest = rows.withColumn("newest", F.max("crawled_at").over(Window.partitionBy(*PAIR))).where("crawled_at = newest AND cents > 0")
    most = newest.withColumn("most", F.max("cents").over(Window.partitionBy(*PAIR)))
    kept = F.col("cents") >= VARIANT_SHARE * F.col("most")
    return most.groupBy(*PAIR).agg(F.min(F.when(kept, F.col("cents"))).alias("cents"), F.count_if(~kept).alias("variants"), F.max("qty").alias("qty"))


def opportunities(snaps: DataFrame, own_skus: DataFrame, own_store: str, as_of: datetime, days: int) -> DataFrame:
    """Every store's row of products that the own store and another sell, with its gap over the least rival price."""
    rows = listings(windowed(snaps, as_of, days).join(own_skus.select("sku"), "sku", "left_semi"))
    rival = F.when(F.col("store_id") != own_store, F.col("cents"))
    by_sku = rows.groupBy("sku").agg(F.count("*").alias("sellers"), F.bool_or(F.col("store_id") == own_store).alias("has_own"), F.min(rival).alias("low"), (F.sum(rival) / F.count(rival)).alias("mean"), F.collect_list(rival).alias("prices"))
    others = F.array_sort(F.filter("prices", lambda p: p != F.col("low")))
    n = F.size(others)
    middle = F.when(n > 0, (F.element_at(others, ((n + 1) / 2).cast("int")) + F.element_at(others, (n / 2).cast("int") + 1)) / 2)
    by_sku = by_sku.where("has_own AND sellers >= 2").withColumn("odd_low", F.coalesce(F.col("low") < OUTLIER_SHARE * middle, F.lit(False))).drop("prices", "has_own")
    scored = rows.join(by_sku, "sku").withColumn("gap_pct", F.round((F.col("cents") - F.col("low")) * 100 / F.col("low"), 2)).withColumn("uplift", F.col("cents") - F.col("low"))
    badge = F.when(F.col("gap_pct") >= 25, "overpriced_risk").when((F.col("uplift") >= 50_000) & (F.col("qty") > 0), "quick_win").otherwise("overpriced")
    return scored.where("gap_pct >= 10").select(*PAIR, "cents", "low", F.round("mean", 3).alias("mean"), "sellers", "variants", "odd_low", "gap_pct", badge.alias("badge"))
