"""Where an own price stands among sellers, and how stores rank."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.model import FRESH_HOURS, MIN_CONFIDENCE, WEIGHTS
from tarifa.operators.rollups import PAIR, since


def market_position(own: DataFrame, rivals: DataFrame) -> DataFrame:
    """Rank, percentile and tag of each own price (sku, cents) among rivals' (sku, store_id, cents) positive prices.

    A product needs two sellers, the own one included. Equal prices share the lower rank.
    """
    both = own.select("sku", "cents", F.lit(True).alias("mine")).unionByName(rivals.select("sku", "cents", F.lit(False).alias("mine"))).where("cents > 0")
    by_price, all_ = Window.partitionBy("sku").orderBy("cents"), Window.partitionBy("sku")
    rows = both.select(
        "*", F.rank().over(by_price).alias("rank"), F.round(F.percent_rank().over(by_price) * 100, 1).alias("percentile"), F.count("*").over(all_).alias("sellers"),
        F.min("cents").over(all_).alias("low"), F.max("cents").over(all_).alias("high"), F.median("cents").over(all_).alias("middle"),
    )
    tag = F.when(F.col("cents") == F.col("low"), "cheapest").when(F.col("cents") == F.col("high"), "most_expensive").when(F.col("cents") > F.col("middle"), "above_median").when(F.col("cents") < F.col("middle"), "below_median").otherwise("at_median")
    return rows.where("mine AND sellers >= 2").select("sku", "cents", "rank", "percentile", "sellers", "low", "high", "middle", tag.alias("tag"))


def seller_ranks(own: DataFrame, rivals: DataFrame, own_store: str, as_of: datetime, stale_days: int = 7, floor: int = MIN_CONFIDENCE) -> DataFrame:
    """sku, sellers, stale_sellers, low_confidence_sellers of what market_position() ranks: every seller in the order of the price, for a range bar.

    own: sku, cents; rivals: sku, store_id, cents, crawled_at, confidence. sellers: an array of (rank, cents, is_mine, store_id); equal prices share the lower rank, among
    them the own one stands first, then stores by name. A product has a row a store at most.
    """
    old = F.col("crawled_at") < since(as_of, stale_days)
    theirs = rivals.select("sku", "store_id", "cents", F.lit(False).alias("is_mine"), old.cast("int").alias("old"), (F.coalesce("confidence", F.lit(0)) < floor).cast("int").alias("unsure"))
    both = own.select("sku", F.lit(own_store).alias("store_id"), "cents", F.lit(True).alias("is_mine"), F.lit(0).alias("old"), F.lit(0).alias("unsure")).unionByName(theirs).where("cents > 0")
    ranked = both.withColumn("rank", F.rank().over(Window.partitionBy("sku").orderBy("cents")))
    one = F.struct("rank", "cents", (~F.col("is_mine")).alias("theirs"), "store_id")
    rows = ranked.groupBy("sku").agg(F.array_sort(F.collect_list(one)).alias("s"), F.sum("old").alias("stale_sellers"), F.sum("unsure").alias("low_confidence_sellers"), F.bool_or("is_mine").alias("mine"))
    listed = F.transform("s", lambda x: F.struct(x["rank"].alias("rank"), x["cents"].alias("cents"), (~x["theirs"]).alias("is_mine"), x["store_id"].alias("store_id")))
    return rows.where(F.col("mine") & (F.size("s") >= 2)).select("sku", listed.alias("sellers"), "stale_sellers", "low_confidence_sellers")


def position_summary(positions: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("tag") == t).alias(t) for t in ("cheapest", "most_expensive", "above_median", "below_median", "at_median")]
    return positions.agg(F.count("*").alias("ranked"), *counts, F.round(F.avg("percentile"), 3).alias("avg_percentile"))


def product_metrics(newest: DataFrame) -> DataFrame:
    """Per product over each store's latest row: prices, stock, confidence."""
    return newest.groupBy("sku").agg(
        F.count("*").alias("num_sellers"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.median("cents").alias("middle"), (F.sum("cents") / F.count("cents")).alias("mean"),
        F.max("qty").alias("most_qty"), F.bool_or("in_stock").alias("in_stock"), F.round(F.avg("confidence"), 1).alias("confidence"),
    )


def kpis(own: DataFrame, metrics: DataFrame, pairs: DataFrame, own_store: str) -> DataFrame:
    """One row on the own catalogue: coverage by competitors, how often it is cheapest, market and own units."""
    sold = pairs.groupBy("sku").agg(F.sum("units").alias("market_units"), F.sum(F.when(F.col("store_id") == own_store, F.col("units"))).alias("my_units"))
    rows = own.join(metrics, "sku", "left").join(sold, "sku", "left")
    priced = F.col("num_sellers") >= 1
    return rows.agg(
        F.count("*").alias("products"), F.count_if(priced).alias("matched"), F.round(F.count_if(priced) * 100 / F.count("*"), 1).alias("coverage_pct"), F.count_if(F.col("cents") <= F.col("low")).alias("cheapest"),
        F.count_if(F.col("cents") > F.col("high")).alias("dearest"), F.coalesce(F.sum("market_units"), F.lit(0)).alias("market_units"), F.coalesce(F.sum("my_units"), F.lit(0)).alias("my_units"),
        F.round(F.avg(F.when(priced & (F.col("market_units") > 0), F.coalesce("my_units", F.lit(0)) * 100 / F.col("market_units"))), 3).alias("share_pct"),
    )


def price_trend(snaps: DataFrame, each: int = 3, band: float = 3.0) -> DataFrame:
    """Per pair, the mean of the last readings against the first: up, down or stable within the band."""
    first, last = Window.partitionBy(*PAIR).orderBy("crawled_at", "seq"), Window.partitionBy(*PAIR).orderBy(F.desc("crawled_at"), F.desc("seq"))
    rows = snaps.where("cents > 0").withColumn("f", F.row_number().over(first)).withColumn("l", F.row_number().over(last))
    mean = lambda c: F.sum(F.when(F.col(c) <= each, F.col("cents"))) / F.count_if(F.col(c) <= each)
    sums = rows.groupBy(*PAIR).agg(mean("f").alias("first_mean"), mean("l").alias("last_mean"))
    change = (F.col("last_mean") - F.col("first_mean")) * 100 / F.col("first_mean")
    return sums.withColumn("trend", F.when(change > band, "up").when(change < -band, "down").otherwise("stable"))


def store_ranking(cover: DataFrame, stores: DataFrame, pairs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Stores by revenue, then by a score of breadth, price, stock and freshness; a null revenue stands last."""
    age = F.lit(as_of).cast("long") - F.col("last_seen_any_at").cast("timestamp").cast("long")
    priced = cover.where((F.col("last_priced_cents") > 0) & (F.col("last_priced_at") >= since(as_of, days))).withColumn("standing", F.percent_rank().over(Window.partitionBy("sku").orderBy("last_priced_cents"))).withColumn("others", F.count("*").over(Window.partitionBy("sku")))
    parts = priced.groupBy("store_id").agg(
        F.count("*").alias("products"), F.coalesce(1 - F.avg(F.when(F.col("others") > 1, F.col("standing"))), F.lit(0.5)).alias("price"),
        F.avg(F.coalesce("last_in_stock", F.lit(False)).cast("int")).alias("stock"), F.avg((age <= FRESH_HOURS * 3600).cast("int")).alias("freshness"),
    )
    sales = pairs.groupBy("store_id").agg(F.sum("revenue").alias("sold"))
    rows = stores.join(parts, "store_id", "left").join(sales, "store_id", "left").withColumn("most", F.max("products").over(Window.partitionBy()))  # a row a store
    breadth = F.log1p(F.coalesce("products", F.lit(0))) / F.log1p("most")
    score = sum(WEIGHTS[k] * F.coalesce(v, F.lit(0.0)) for k, v in (("breadth", breadth), ("price", F.col("price")), ("stock", F.col("stock")), ("freshness", F.col("freshness"))))
    revenue = F.when(F.col("is_own"), F.lit(None)).otherwise(F.when(F.col("sold") > 0, F.col("sold")))
    rows = rows.select("store_id", F.coalesce("products", F.lit(0)).alias("products"), revenue.cast("long").alias("revenue"), F.round(score * 100, 3).alias("score"))
    order = Window.orderBy(F.col("revenue").desc_nulls_last(), F.desc("score"), F.desc("products"), "store_id")  # a row a store
    return rows.withColumn("rank", F.row_number().over(order))
