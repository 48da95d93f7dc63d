"""Alerts on the last readings, and audits of the own catalogue against the own store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.model import VAT


def last_two_alerts(snaps: DataFrame, low: int = 10, keys: tuple[str, ...] = ("sku",)) -> DataFrame:
    """Price falls, restocks and low-stock crossings between the last two readings of each product.

    With keys ("sku",) the two readings may come from different stores; ("sku", "store_id") compares within a store.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("crawled_at"), F.desc("store_id"), F.desc("seq"))
    rows = snaps.withColumn("n", F.row_number().over(order)).where("n <= 2")
    now, before = (F.max(F.when(F.col("n") == i, F.struct("cents", "qty", "in_stock"))) for i in (1, 2))
    both = rows.groupBy(*keys).agg(now.alias("now"), before.alias("before")).where("before IS NOT NULL")
    return both.select(
        *keys, (F.col("now.cents") < F.col("before.cents")).alias("price_drop"), (F.col("now.in_stock") & ~F.col("before.in_stock")).alias("back_in_stock"),
        (~F.col("now.in_stock") & F.col("before.in_stock")).alias("out_of_stock"), ((F.col("now.qty") < low) & (F.col("before.qty") >= low)).alias("low_stock"),
    )


def fired(alerts: DataFrame, snaps: DataFrame, low: int = 10) -> DataFrame:
    """id, sku, alert_type, change_pct of active alerts (id, sku, alert_type, threshold, is_active) that the last two readings of their product set off.

    The readings may come from different stores. Price alerts need a change of at least the threshold in percent (0 if null), stock ones a crossing of
    the threshold, or of `low` where there is none.
    """
    order = Window.partitionBy("sku").orderBy(F.desc("crawled_at"), F.desc("store_id"), F.desc("seq"))
    rows = snaps.join(alerts.where("is_active").select("sku").distinct(), "sku", "left_semi").withColumn("n", F.row_number().over(order)).where("n <= 2")
    now, before = (F.max(F.when(F.col("n") == i, F.struct("cents", "qty", "in_stock"))) for i in (1, 2))
    return judged(alerts, rows.groupBy("sku").agg(now.alias("now"), before.alias("before")), low)


def judged(alerts: DataFrame, both: DataFrame, low: int = 10) -> DataFrame:
    """fired() by each product's newest reading and the one before: both (sku, now, before), each a struct with cents, qty and in_stock."""
    asked = alerts.where("is_active").select("id", "sku", "alert_type", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    both = asked.join(both.where("before IS NOT NULL"), "sku").withColumn("mark", F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(low))
    pct = F.when(F.col("before.cents") > 0, F.round((F.col("now.cents") - F.col("before.cents")) * 100 / F.col("before.cents"), 1)).otherwise(0.0)
    is_ = lambda kind: F.col("alert_type") == kind
    price = (is_("price_drop") & (F.col("now.cents") < F.col("before.cents")) & (-pct >= F.col("threshold"))) | (is_("price_increase") & (F.col("now.cents") > F.col("before.cents")) & (pct >= F.col("threshold")))
    stock = (is_("out_of_stock") & ~F.col("now.in_stock") & F.col("before.in_stock")) | (is_("back_in_stock") & F.col("now.in_stock") & ~F.col("before.in_stock"))
    crossed = is_("low_stock") & (F.coalesce("now.qty", F.lit(0)) <= F.col("mark")) & (F.coalesce("before.qty", F.lit(0)) > F.col("mark"))
    return both.where(price | stock | crossed).select("id", "sku", "alert_type", F.when(is_("price_drop") | is_("price_increase"), pct).alias("change_pct"))


def generated(own: DataFrame, links: DataFrame, newest: DataFrame, gaps: DataFrame, sure: int = 75, least_gap_cents: int = 1_000_000) -> DataFrame:
    """sku, store_id, alert_type, category, threshold of alerts to set up: where the cheapest verified match undercuts by over 15 percent, one stock watch of each product that the own store
    has, and catalogue gaps (sku, revenue) worth `least_gap_cents` or more.
    """
    price = F.coalesce(F.when(F.col("sale_cents") != 0, F.col("sale_cents")), F.col("cents"))
    mine = own.select("sku", price.alias("my_cents"), F.coalesce("qty", F.lit(0)).alias("qty"))
    live = newest.select(F.col("sku").alias("rival_sku"), "store_id", F.col("cents").alias("rival_cents"), "in_stock")
    pairs = links.where(F.col("confidence") >= sure).join(live, ["rival_sku", "store_id"]).withColumnRenamed("my_sku", "sku").join(mine, "sku")
    row = lambda rows, kind, category, threshold: rows.select("sku", "store_id", F.lit(kind).alias("alert_type"), F.lit(category).alias("category"), F.lit(threshold).alias("threshold"))
    cheapest = pairs.where("my_cents > 0 AND rival_cents > 0").groupBy("sku").agg(F.min_by(F.struct("store_id", "rival_cents", "my_cents"), F.struct("rival_cents", "store_id")).alias("m")).select("sku", "m.*")
    dearer = cheapest.where(F.round((F.col("my_cents") - F.col("rival_cents")) * 100 / F.col("rival_cents"), 1) > 15)
    watched = pairs.where("qty > 0 AND in_stock").groupBy("sku").agg(F.min("store_id").alias("store_id"))
    missing = gaps.where(F.col("revenue") >= least_gap_cents).select("sku", F.lit("").alias("store_id"))
    return row(dearer, "price_drop", "", 5).unionByName(row(watched, "out_of_stock", "", 0)).unionByName(row(missing, "back_in_stock", "catalog_gap", 0))


def price_audit(own: DataFrame, shown: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Products of the own catalogue and of the own store's latest rows (sku, cents): where each is, and how the prices relate."""
    both = own.select("sku", F.col("cents").alias("own_cents")).join(shown.select("sku", F.col("cents").alias("shown_cents")), "sku", "full")
    where = F.when(F.col("shown_cents").isNull(), "only_in_catalogue").when(F.col("own_cents").isNull(), "only_in_store").otherwise("both")
    ratio = F.when((F.col("own_cents") > 0) & (F.col("shown_cents") > 0), F.col("shown_cents") / F.col("own_cents"))
    kind = F.when(ratio.isNull(), "unusable").when(F.abs(ratio - (1 + VAT)) <= tolerance, "with_vat").when(F.abs(ratio - 1) <= tolerance, "equal").otherwise("other")
    return both.select("sku", where.alias("found"), kind.alias("ratio"))
