"""Latest rows, and the tables that are kept per pair, per store and day, and per pair and day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.model import MAX_DAILY_UNITS, MAX_SOLD_STEP, MIN_CONFIDENCE, PLACEHOLDER_QTY, USABLE_QTY

PAIR = ["sku", "store_id"]


def since(as_of: datetime, days: int) -> Column:
    return F.lit(as_of - timedelta(days=days))


def usable_qty(qty: Column) -> Column:
    """Whether a quantity is a real count."""
    return ~F.coalesce(qty, F.lit(0)).isin(*PLACEHOLDER_QTY) & (F.coalesce(qty, F.lit(0)) <= USABLE_QTY)


def windowed(snaps: DataFrame, as_of: datetime, days: int, floor: int = MIN_CONFIDENCE) -> DataFrame:
    """Readings of the last days at or above the confidence floor; a null confidence fails."""
    return snaps.where((F.col("crawled_at") >= since(as_of, days)) & (F.col("confidence") >= floor))


def latest(snaps: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """The newest row of each pair: one partial and one final aggregation, no sort."""
    rest = [c for c in snaps.columns if c not in keys]
    return snaps.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("crawled_at", "seq")).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def coverage(snaps: DataFrame) -> DataFrame:
    """Per pair, five latest rows under conditions of their own, in one aggregation; an absent one is null."""
    return coverage_of(coverage_state(snaps))


def coverage_state(snaps: DataFrame) -> DataFrame:
    """What coverage() is made of, a row a pair: the newest accepted and the newest priced reading as structs that begin with their time, and times."""
    accepted = F.col("confidence") >= MIN_CONFIDENCE
    positive = accepted & (F.col("cents") > 0)
    at = F.struct("crawled_at", "seq")
    newest = lambda value, when: F.max_by(F.when(when, value), F.when(when, at))
    return snaps.groupBy(*PAIR).agg(
        F.max("crawled_at").alias("last_seen_any_at"),
        newest(F.struct("crawled_at", "seq", "cents", "confidence", "in_stock", "qty"), accepted & F.col("cents").isNotNull()).alias("l"),
        newest(F.struct("crawled_at", "seq", "cents"), positive).alias("p"),
        F.max(F.when(positive & (F.col("sold") > 0), F.col("crawled_at"))).alias("last_sold_pos_at"),
        F.max(F.when(positive & (F.col("qty") > 0) & (F.col("qty") <= USABLE_QTY), F.col("crawled_at"))).alias("last_usable_qty_at"),
    )


def merged_coverage(states: DataFrame) -> DataFrame:
    """One coverage_state() of several."""
    return states.groupBy(*PAIR).agg(*(F.max(c).alias(c) for c in states.columns if c not in PAIR))


def coverage_of(state: DataFrame) -> DataFrame:
    return state.select(
        *PAIR, "last_seen_any_at", F.col("l.crawled_at").alias("last_seen_at"), F.col("l.cents").alias("last_cents"), F.col("l.confidence").alias("last_confidence"),
        F.col("l.in_stock").alias("last_in_stock"), F.col("l.qty").alias("last_qty"), F.col("p.crawled_at").alias("last_priced_at"), F.col("p.cents").alias("last_priced_cents"),
        "last_sold_pos_at", "last_usable_qty_at",
    )


def day_closes(snaps: DataFrame) -> DataFrame:
    """The last accepted, priced row of each pair and UTC day."""
    accepted = snaps.where((F.col("confidence") >= MIN_CONFIDENCE) & F.col("cents").isNotNull())
    return latest(accepted.withColumn("day", F.to_date("crawled_at")), [*PAIR, "day"])


def with_drops(closes: DataFrame) -> DataFrame:
    """Day closes with `dropped`: 1 where the price is below that of the close before, else 0."""
    before = F.lag("cents").over(Window.partitionBy(*PAIR).orderBy("day"))
    return closes.withColumn("dropped", F.coalesce(F.col("cents") < before, F.lit(False)).cast("long"))


def trust(snaps: DataFrame) -> DataFrame:
    """store_id, day, conf_sum, conf_count: confidence over every accepted row."""
    accepted = snaps.where(F.col("confidence") >= MIN_CONFIDENCE)
    return accepted.groupBy("store_id", F.to_date("crawled_at").alias("day")).agg(F.sum("confidence").alias("conf_sum"), F.count("*").alias("conf_count"))


def daily_rollups(snaps: DataFrame) -> DataFrame:
    """store_id, day, drops, conf_sum, conf_count: price drops between day closes; confidence over every accepted row."""
    return rollups_of(with_drops(day_closes(snaps)), trust(snaps))


def rollups_of(closes: DataFrame, trust: DataFrame) -> DataFrame:
    """daily_rollups() from day closes with `dropped` and from trust()."""
    drops = closes.groupBy("store_id", "day").agg(F.sum("dropped").alias("drops"))
    return drops.join(trust, ["store_id", "day"], "full").select("store_id", "day", F.coalesce("drops", F.lit(0)).alias("drops"), F.coalesce("conf_sum", F.lit(0)).alias("conf_sum"), F.coalesce("conf_count", F.lit(0)).alias("conf_count"))


def sales_daily(snaps: DataFrame) -> DataFrame:
    """store_id, sku, day, units_sold, rev_sold, units_qty, rev_qty, qty_drop of days on which anything sold; revenue in cents.

    Day closes without a positive price are left out; the counter goes against the close before, stock against the last usable one.
    """
    return sales_of(day_closes(snaps)).where(SOLD)


#: Days on which anything sold.
SOLD = "units_sold > 0 OR units_qty > 0 OR qty_drop > 0"


def sales_of(closes: DataFrame) -> DataFrame:
    """sales_daily() of all day closes with a positive price, also of those on which nothing sold."""
    return with_sales(closes.where("cents > 0")).select("store_id", "sku", "day", "units_sold", "rev_sold", "units_qty", "rev_qty", "qty_drop")


def with_sales(closes: DataFrame) -> DataFrame:
    """Day closes with the columns of sales_of(): zeros at those without a positive price, which the others pass over."""
    priced = F.coalesce(F.col("cents") > 0, F.lit(False))
    earlier = Window.partitionBy(*PAIR).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(priced & usable_qty(F.col("qty")), F.col("qty"))
    closes = closes.withColumn("_before", F.last(F.when(priced, F.struct("sold", "qty")), ignorenulls=True).over(earlier)).withColumn("_last_valid", F.last(valid, ignorenulls=True).over(earlier))
    within = lambda value, most: F.when(priced, F.coalesce(F.least(F.greatest(value, F.lit(0)), F.lit(most)) if most else F.greatest(value, F.lit(0)), F.lit(0))).otherwise(0).cast("long")
    closes = closes.withColumns({
        "units_sold": within(F.col("sold") - F.col("_before.sold"), MAX_SOLD_STEP), "units_qty": within(F.col("_last_valid") - valid, MAX_DAILY_UNITS), "qty_drop": within(F.col("_before.qty") - F.col("qty"), None),
    })
    money = lambda units: F.when(priced, F.col(units) * F.col("cents")).otherwise(0)
    return closes.withColumns({"rev_sold": money("units_sold"), "rev_qty": money("units_qty")}).drop("_before", "_last_valid")


def sales_pairs(daily: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """store_id, sku, units, revenue, qty_drop: the counter where it moved, else stock."""
    recent = daily.where(F.col("day") >= F.lit((as_of - timedelta(days=days)).date()))
    sums = recent.groupBy("store_id", "sku").agg(*(F.sum(c).alias(c) for c in ("units_sold", "rev_sold", "units_qty", "rev_qty", "qty_drop")))
    counted = F.col("units_sold") > 0
    return sums.select("store_id", "sku", F.when(counted, F.col("units_sold")).otherwise(F.col("units_qty")).alias("units"), F.when(counted, F.col("rev_sold")).otherwise(F.col("rev_qty")).alias("revenue"), "qty_drop")


def changes(snaps: DataFrame) -> DataFrame:
    """Rows that a change-only writer keeps: the first of each pair's day, and those that differ from the one before."""
    day = Window.partitionBy(*PAIR, F.to_date("crawled_at")).orderBy("crawled_at", "seq")
    watched = F.struct("cents", "qty", "in_stock", "sold")
    return snaps.withColumn("_before", F.lag(watched).over(day)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(watched)).drop("_before")
