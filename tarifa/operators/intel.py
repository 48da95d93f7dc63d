"""Price intelligence: own products against live prices of their matches, and decisions on matches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.operators.catalogue import truthy
from tarifa.operators.rollups import since

#: Matches below this confidence are listed apart; gaps in percent from which an own price is red or yellow.
VERIFIED, RED, YELLOW = 75, 15.0, 5.0


def _pct(a, b):
    return F.round((a - b) * 100 / b, 1)


def table(own: DataFrame, links: DataFrame, newest: DataFrame) -> DataFrame:
    """A row an own product and side (verified matches or not): sellers, the cheapest live price, the gap, and what it says.

    Prices are those of `newest`, the window's latest readings; a product whose matches have none is stale: shown, without a gap. Null stock is
    neither in nor out.
    """
    mine = own.select(F.col("sku").alias("my_sku"), F.coalesce(truthy(F.col("sale_cents")), F.col("cents")).alias("my_cents"), F.coalesce("qty", F.lit(0)).alias("my_qty")).where("my_cents > 0")
    live = newest.where("cents > 0").select(F.col("sku").alias("rival_sku"), "store_id", F.col("cents").alias("rival_cents"), "in_stock")
    pairs = links.where("confidence > 0").join(live, ["rival_sku", "store_id"], "left").withColumn("verified", F.col("confidence") >= VERIFIED)
    priced = F.col("rival_cents").isNotNull()
    best = F.struct("store_id", "confidence", "method", "rival_cents")
    sums = pairs.groupBy("my_sku", "verified").agg(
        F.countDistinct("store_id").alias("sellers"), F.count("rival_cents").alias("live"), F.min_by(best, F.when(priced, F.struct("rival_cents", "store_id"))).alias("cheap"),
        F.max_by(best, F.struct("confidence", "store_id")).alias("sure"), F.count_if(priced & ~F.col("in_stock")).alias("out"),
    )
    rows = sums.join(mine, "my_sku").withColumn("pick", F.when(F.col("live") > 0, F.col("cheap")).otherwise(F.col("sure"))).withColumn("low", F.col("cheap.rival_cents"))
    gap = _pct(F.col("my_cents"), F.col("low"))
    return rows.select(
        "my_sku", "verified", "my_cents", "sellers", F.col("pick.store_id").alias("store_id"), F.col("low").alias("cheapest_cents"), gap.alias("diff_pct"), F.when(F.col("live") > 0, "live").otherwise("stale").alias("price_status"),
        F.col("pick.confidence").alias("confidence"), F.col("pick.method").alias("method"), F.when(gap > RED, "red").when(gap > YELLOW, "yellow").alias("severity"),
        F.when(F.col("my_cents") <= F.col("low"), F.col("low") - F.col("my_cents")).alias("saving_cents"), ((F.col("live") > 0) & (F.col("out") == F.col("live")) & (F.col("my_qty") > 0)).alias("competitor_oos"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The widest gaps first, those without one last."""
    return rows.orderBy(F.abs("diff_pct").desc_nulls_last(), "my_sku")


def summary(rows: DataFrame) -> DataFrame:
    """The dashboard's counts, one row; stale rows are in no bucket."""
    sure = F.col("verified")
    return rows.agg(
        F.count_if(sure).alias("matched_products"), F.count_if(~sure).alias("unverified_products"), F.count_if(sure & (F.col("severity") == "red")).alias("overpriced_red"), F.count_if(sure & (F.col("severity") == "yellow")).alias("overpriced_yellow"),
        F.count_if(sure & F.col("saving_cents").isNotNull()).alias("cheapest_count"), F.count_if(sure & F.col("competitor_oos")).alias("oos_opportunities"), F.count_if(sure & (F.col("price_status") == "stale")).alias("rows_without_live_price"),
    )


def confidence_distribution(links: DataFrame) -> DataFrame:
    """Matches by the first label that fits; a match that none fits is counted nowhere."""
    c, m = F.col("confidence"), F.coalesce("method", F.lit(""))
    label = (
        F.when(F.coalesce("confirmed", F.lit(False)), "confirmed_100").when((c == 99) & m.contains("barcode"), "barcode_99").when((c == 95) & m.contains("sku"), "sku_95").when(c == 85, "name_85")
        .when((c == 80) & m.contains("name"), "name_80").when((c == 80) & (m == "baseline"), "baseline_80").when(c == 70, "name_70")
    )
    return links.groupBy(label.alias("label")).agg(F.count("*").alias("matches")).where("label IS NOT NULL")


def cards(own: DataFrame, links: DataFrame, newest: DataFrame, snaps: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """A card a match: the live price against the own one, the trend of its readings' prices, and when it was last seen.

    The trend holds the mean of the last three readings of the window against that of the first three; beyond three percent it rises or falls.
    """
    mine = own.select(F.col("sku").alias("my_sku"), F.coalesce(truthy(F.col("sale_cents")), F.col("cents")).alias("my_cents"))
    live = newest.where("cents > 0").select(F.col("sku").alias("rival_sku"), "store_id", F.col("cents").alias("rival_cents"), F.col("in_stock").alias("rival_in_stock"))
    seen = snaps.where(F.col("crawled_at") >= since(as_of, days)).select(F.col("sku").alias("rival_sku"), "store_id", "crawled_at", "seq", truthy(F.col("cents")).alias("cents"))
    last_seen = seen.groupBy("rival_sku", "store_id").agg(F.max("crawled_at").alias("last_crawled_at"))
    pair = Window.partitionBy("rival_sku", "store_id")
    placed = seen.where("cents IS NOT NULL").select("*", F.row_number().over(pair.orderBy("crawled_at", "seq")).alias("f"), F.row_number().over(pair.orderBy(F.desc("crawled_at"), F.desc("seq"))).alias("l"))
    mean = lambda c: F.sum(F.when(F.col(c) <= 3, F.col("cents"))) / F.count_if(F.col(c) <= 3)
    trends = placed.groupBy("rival_sku", "store_id").agg(mean("f").alias("older"), mean("l").alias("recent"))
    rows = links.join(mine, "my_sku").join(live, ["rival_sku", "store_id"], "left").join(last_seen, ["rival_sku", "store_id"], "left").join(trends, ["rival_sku", "store_id"], "left")
    trend = F.when(F.col("recent") > F.col("older") * 1.03, "rising").when(F.col("recent") < F.col("older") * 0.97, "falling").otherwise("stable")
    diff = F.col("rival_cents") - F.col("my_cents")
    return rows.select(
        "my_sku", "rival_sku", "store_id", "my_cents", "rival_cents", F.when(F.col("rival_cents").isNotNull(), F.coalesce("rival_in_stock", F.lit(False))).alias("rival_in_stock"), F.when(F.col("rival_cents").isNotNull(), "live").otherwise("stale").alias("price_status"), diff.alias("diff_cents"),
        F.when(F.col("my_cents") > 0, _pct(F.col("rival_cents"), F.col("my_cents"))).alias("diff_pct"), F.when(diff > 0, "cheaper").when(diff == 0, "equal").when(diff < 0, "expensive").alias("position"), trend.alias("price_trend"), "last_crawled_at",
    )


def decided(links: DataFrame, confirmed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Matches after decisions: confirmed ones (my_sku, rival_sku, store_id) have confidence 100, rejected pairs (my_sku, rival_sku) go at every store."""
    yes = confirmed.select("my_sku", "rival_sku", "store_id").distinct().withColumn("yes", F.lit(True))
    kept = links.join(rejected.select("my_sku", "rival_sku").distinct(), ["my_sku", "rival_sku"], "left_anti").join(yes, ["my_sku", "rival_sku", "store_id"], "left")
    sure = F.coalesce("yes", F.lit(False)) | F.coalesce("confirmed", F.lit(False))
    return kept.select("my_sku", "rival_sku", "store_id", F.when(sure, 100).otherwise(F.col("confidence")).alias("confidence"), "method", sure.alias("confirmed"))


def rematched(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The matches after a batch run: confirmed old ones stay, all others give way to fresh ones. Nothing fresh means that the run failed: the old ones stay."""
    if not fresh.limit(1).count():
        return old
    kept = old.where("confirmed")
    return kept.unionByName(fresh.join(kept.select("my_sku", "rival_sku", "store_id"), ["my_sku", "rival_sku", "store_id"], "left_anti").select(*old.columns))


def best_matches(links: DataFrame) -> DataFrame:
    """The most confident match of each rival product at a store."""
    first = F.row_number().over(Window.partitionBy("rival_sku", "store_id").orderBy(F.desc("confidence"), "my_sku"))
    return links.withColumn("first", first).where("first = 1").drop("first")


def report_summary(rows: DataFrame, links: DataFrame) -> DataFrame:
    """A report's counts: own products by how they stand, over verified live rows, and matched rival products; one row."""
    live = rows.where("verified AND price_status = 'live'")
    counts = live.agg(F.count_if(F.col("diff_pct") < 0).alias("cheaper"), F.count_if(F.col("diff_pct") == 0).alias("equal"), F.count_if(F.col("diff_pct") > 0).alias("expensive"), F.countDistinct("my_sku").alias("matched_skus"))
    return counts.crossJoin(best_matches(links).agg(F.count("*").alias("rival_rows")))  # one row each
