"""Discounts: the deepest, their streaks, and how aggressive stores are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.operators.rollups import PAIR, latest, windowed


def streaks(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Per pair the run of discounted readings that the newest one ends: its start, days and readings; none if that isn't discounted.

    Where no reading of the rows is at the full price, the run may have begun before them: its start is a lower bound.
    """
    plain = F.max(F.when(F.coalesce("discount_pct", F.lit(0)) <= 0, F.struct("crawled_at", "seq"))).over(Window.partitionBy(*PAIR))
    run = rows.withColumn("plain", plain).where(F.col("plain").isNull() | (F.struct("crawled_at", "seq") > F.col("plain")))
    found = run.groupBy(*PAIR).agg(F.min("crawled_at").alias("started_at"), F.count("*").alias("readings"), F.bool_and(F.col("plain").isNull()).alias("is_lower_bound"))
    days = F.floor((F.lit(as_of).cast("long") - F.col("started_at").cast("timestamp").cast("long")) / 86400)
    return found.withColumn("days_on_discount", F.greatest(days, F.lit(0)))


def deepest(snaps: DataFrame, daily: DataFrame, stores: DataFrame, as_of: datetime, days: int, top: int = 50, by: str = "discount_pct") -> DataFrame:
    """The deepest discounts by percent or by saving (cents): the latest discounted row of each pair, its streak, and units since it began.

    The rows are filtered before they are limited, so none that qualifies is missed.
    """
    rows = windowed(snaps, as_of, days)
    newest = latest(rows.where("discount_pct > 0 AND list_cents > cents")).withColumn("saving", F.col("list_cents") - F.col("cents"))
    first = newest.orderBy(F.desc(by), F.desc("saving"), *PAIR).limit(top).join(streaks(rows, as_of), PAIR, "left").join(stores, "store_id")
    sold = first.join(daily.select(*PAIR, "day", "units_sold", "units_qty"), PAIR).where(F.col("day") >= F.to_date("started_at"))
    sold = sold.groupBy(*PAIR).agg(F.sum("units_sold").alias("s"), F.sum("units_qty").alias("q"))
    units = F.when(~F.col("measurable"), F.lit(None)).when(F.col("started_at").isNull(), F.lit(None)).otherwise(F.coalesce(F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("q")), F.lit(0)))
    return first.join(sold, PAIR, "left").select(*PAIR, "cents", "list_cents", "discount_pct", "saving", "started_at", F.coalesce("days_on_discount", F.lit(0)).alias("days_on_discount"), units.cast("long").alias("units"))


def timeline(snaps: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Discounted readings by store and week: calendar year with ISO week, as the label has it."""
    rows = windowed(snaps, as_of, days).where("discount_pct > 0")
    week = F.concat(F.year("crawled_at"), F.lit("-W"), F.lpad(F.weekofyear("crawled_at").cast("string"), 2, "0"))
    return rows.groupBy("store_id", week.alias("week")).agg(F.count("*").alias("n"), F.round(F.avg("discount_pct"), 3).alias("avg_discount"))


def aggression(snaps: DataFrame, stores: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """A score for each store from depth, frequency and maximum of its discounts; a store without readings has zeros."""
    rows = windowed(snaps, as_of, days)
    by_sku = rows.groupBy("store_id", "sku").agg(F.avg(F.when(F.col("discount_pct") > 0, F.col("discount_pct"))).alias("depth"), F.max("discount_pct").alias("most"), F.count_if(F.col("discount_pct") > 0).alias("hits"), F.count("*").alias("n"))
    by_store = by_sku.groupBy("store_id").agg(F.avg("depth").alias("depth"), F.count("depth").alias("skus"), F.max("most").alias("most"), (F.sum("hits") * 100 / F.sum("n")).alias("frequency"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.least(F.lit(100.0), 0.4 * zero(F.col("depth")) + 0.35 * zero(F.col("frequency")) + 0.25 * zero(F.col("most")))
    rows = stores.select("store_id").join(by_store, "store_id", "left")
    return rows.select("store_id", F.round(zero(F.col("depth")), 3).alias("avg_depth"), zero(F.col("skus")).alias("skus"), zero(F.col("most")).alias("max_discount"), F.round(zero(F.col("frequency")), 3).alias("frequency"), F.round(score, 2).alias("score"))
