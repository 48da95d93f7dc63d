"""Sales estimates from consecutive readings. The variants differ in filters, clamps and prices, and stay separate."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions.numbers import monday_week
from tarifa.model import MAX_BADGE_STEP, MAX_DAILY_UNITS, MAX_QTY_STEP, MAX_SOLD_STEP, MIN_CONFIDENCE, PLACEHOLDER_QTY
from tarifa.operators.rollups import PAIR, usable_qty, windowed


def _in_time():
    return Window.partitionBy(*PAIR).orderBy("crawled_at", "seq")


def window_sales(snaps: DataFrame, as_of: datetime, days: int, floor: int = MIN_CONFIDENCE) -> DataFrame:
    """Units and revenue (cents) of each pair in the window, and the method: counter steps, else falls of usable stock.

    Revenue is units times the mean price of all readings, a null price counting as zero.
    """
    rows = windowed(snaps, as_of, days, floor)
    usable = usable_qty(F.col("qty"))
    before_usable = F.last(F.when(usable, F.coalesce("qty", F.lit(0))), ignorenulls=True).over(_in_time().rowsBetween(Window.unboundedPreceding, -1))
    sold = F.coalesce("sold", F.lit(0))
    rows = rows.withColumn("step", sold - F.lag(sold).over(_in_time())).withColumn("drop", F.when(usable, before_usable - F.coalesce("qty", F.lit(0))))
    cap = MAX_DAILY_UNITS * max(1, days)
    sums = rows.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.count_if(usable).alias("n_usable"), F.max(sold).alias("most"), (F.sum(F.coalesce("cents", F.lit(0))) / F.count("*")).alias("mean_cents"),
        F.coalesce(F.sum(F.when(F.col("step") > 0, F.least("step", F.lit(MAX_SOLD_STEP)))), F.lit(0)).alias("steps"), F.coalesce(F.sum(F.when(F.col("drop") > 0, F.col("drop"))), F.lit(0)).alias("drops"),
    )
    method = (
        F.when(F.col("n") < 2, "insufficient_data").when((F.col("most") > 0) & (F.col("steps") > 0), "sold_count_diff").when(F.col("n_usable") < 2, "insufficient_signal")
        .when(F.col("drops") < 1, "no_depletion").otherwise("qty_positive_delta_sum")
    )
    units = F.when(F.col("method") == "sold_count_diff", F.least("steps", F.lit(cap))).when(F.col("method") == "qty_positive_delta_sum", F.least("drops", F.lit(cap))).otherwise(0).cast("long")
    sums = sums.withColumn("method", method).withColumn("units", units)
    return sums.select(*PAIR, "units", F.round(F.col("units") * F.col("mean_cents")).cast("long").alias("revenue"), "method")


def steps(snaps: DataFrame, as_of: datetime, days: int, floor: int = MIN_CONFIDENCE) -> DataFrame:
    """Readings of the window with the units since the one before; a pair's first reading only starts it."""
    rows = windowed(snaps, as_of, days, floor)
    sold, qty = F.coalesce("sold", F.lit(0)), F.coalesce("qty", F.lit(0))
    counted = F.max(sold).over(Window.partitionBy(*PAIR)) > 0
    before = F.lag(qty).over(_in_time())
    step = F.least(F.greatest(sold - F.lag(sold).over(_in_time()), F.lit(0)), F.lit(MAX_DAILY_UNITS))
    odd = before.isin(*PLACEHOLDER_QTY) | qty.isin(*PLACEHOLDER_QTY) | (before > 500)
    drop = F.when(odd, 0).otherwise(F.least(F.greatest(before - qty, F.lit(0)), F.lit(MAX_QTY_STEP)))
    return rows.withColumn("units", F.coalesce(F.when(counted, step).otherwise(drop), F.lit(0)).cast("long"))


def weekly(snaps: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Units and revenue (cents) of each store by week of the year from Monday."""
    rows = steps(snaps, as_of, days)
    return rows.groupBy("store_id", monday_week(F.col("crawled_at")).alias("week")).agg(F.sum("units").alias("units"), F.sum(F.col("units") * F.coalesce("cents", F.lit(0))).alias("revenue"))


def velocity(snaps: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Units and revenue (cents) by day over the last days, days without sales included."""
    rows = steps(snaps, as_of, days)
    by_day = rows.groupBy(F.to_date("crawled_at").alias("day")).agg(F.sum("units").alias("units"), F.sum(F.col("units") * F.coalesce("cents", F.lit(0))).alias("revenue"))
    first, last = (as_of - timedelta(days=days)).date(), as_of.date()
    calendar = snaps.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return calendar.join(by_day, "day", "left").select("day", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("revenue", F.lit(0)).alias("revenue"))


def honest_velocity(snaps: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Units of each pair from usable stock alone; fewer than three usable readings give no row."""
    rows = windowed(snaps, as_of, days).where(usable_qty(F.col("qty")))
    drop = F.least(F.greatest(F.lag("qty").over(_in_time()) - F.col("qty"), F.lit(0)), F.lit(MAX_QTY_STEP))
    rows = rows.withColumn("units", F.coalesce(drop, F.lit(0)).cast("long"))
    return rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.sum(F.col("units") * F.col("cents")).alias("revenue")).where("n >= 3")


def badge_velocity(readings: DataFrame) -> DataFrame:
    """Units between badge readings (sku, store_id, crawled_at, seq, sold, capped, cents), and their value at the latest price.

    Capped readings are skipped; a step down is a reset; a step above MAX_BADGE_STEP is clamped. Units are null where
    nothing was measured, which isn't zero.
    """
    exact = F.when(~F.coalesce("capped", F.lit(False)), F.col("sold"))
    before = F.last(exact, ignorenulls=True).over(_in_time().rowsBetween(Window.unboundedPreceding, -1))
    rows = readings.withColumn("step", exact - before).withColumn("exact", exact)
    sums = rows.groupBy(*PAIR).agg(
        F.count("sold").alias("n"), F.count("exact").alias("n_exact"), F.sum(F.when(F.col("step") >= 0, F.least("step", F.lit(MAX_BADGE_STEP)))).alias("units"),
        F.count_if(F.col("step") < 0).alias("resets"), F.count_if(F.col("step") > MAX_BADGE_STEP).alias("clamped"), F.max_by(F.when(F.col("cents") > 0, F.col("cents")), F.when(F.col("cents") > 0, F.struct("crawled_at", "seq"))).alias("price"),
    )
    status = F.when(F.col("n") == 0, "no_data").when(F.col("n_exact") == 0, "all_capped").when(F.col("n_exact") == 1, "baseline_only").otherwise("measured_approx")
    units = F.when(status == "measured_approx", F.coalesce("units", F.lit(0)))
    return sums.select(*PAIR, status.alias("status"), units.alias("units"), "resets", "clamped", (units * F.col("price")).alias("revenue"))


def pools(sales: DataFrame, least: int, by_store: bool = False) -> DataFrame:
    """Sums and counts of units by category of sales (store_id, sku, category, units), zeros included; by store, for leaving one out."""
    keys = ["category", "store_id"] if by_store else ["category"]
    return sales.groupBy(*keys).agg(F.sum("units").alias("s"), F.count("*").alias("n"))


def back_test(sales: DataFrame, least: int) -> DataFrame:
    """Per store: its revenue, and what the other stores' velocities say it should be; sales has units, revenue, cents, category.

    A store is left out by taking its sums from the totals, so nothing is computed store by store. A category with fewer than
    `least` observations left falls back on all categories.
    """
    by_store = pools(sales, least, True)
    total = pools(sales, least).withColumnsRenamed({"s": "ts", "n": "tn"})
    everything = by_store.groupBy("store_id").agg(F.sum("s").alias("ss"), F.sum("n").alias("sn")).crossJoin(total.agg(F.sum("ts").alias("gs"), F.sum("tn").alias("gn")))  # one row
    left_n, left_s = F.col("tn") - F.coalesce("n", F.lit(0)), F.col("ts") - F.coalesce("s", F.lit(0))
    overall = F.when(F.col("gn") > F.col("sn"), (F.col("gs") - F.col("ss")) / (F.col("gn") - F.col("sn")))
    rates = total.crossJoin(everything).join(by_store, ["category", "store_id"], "left").select("category", "store_id", F.when(left_n >= least, left_s / left_n).otherwise(overall).alias("rate"))  # categories x stores
    rows = sales.join(rates, ["category", "store_id"])
    sums = rows.groupBy("store_id").agg(F.sum("revenue").alias("actual"), F.round(F.sum(F.col("rate") * F.col("cents")), -2).cast("long").alias("estimated"))
    return sums.withColumn("error_pct", F.round((F.col("estimated") - F.col("actual")) * 100 / F.col("actual"), 1))
