"""Market insights over the kept tables; every ranking has a tie-break, so it has one result."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.operators.rollups import PAIR, latest, since


def priced(cover: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return cover.where((F.col("last_priced_at") >= since(as_of, days)) & (F.col("last_priced_cents") > 0))


def whole_median(rows: DataFrame, name: str, keys: tuple[str, ...] = (), bits: int = 12) -> DataFrame:
    """keys, median: the exact median of a whole-number column by keys, null where there is none; no task holds all values of a key.

    Values are counted by the bits above their last `bits`, and one by one only in the one or two buckets that hold the middle. Buckets and keys
    are few. Without keys there is one row.
    """
    value, by = F.col(name), list(keys)
    rows = rows.where(value.isNotNull()).select(*by, value.alias("value"), F.shiftright(value, bits).alias("bucket"))
    wide = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row a key and bucket
    placed = wide.select("*", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    hit = placed.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    counts = rows.join(F.broadcast(hit), [*by, "bucket"]).groupBy(*by, "bucket", "value").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("upto", "n", "total")))
    within = F.sum("m").over(Window.partitionBy(*by, "bucket").orderBy("value"))  # 2 ** bits values at most
    counts = counts.withColumn("upto", F.col("upto") - F.col("n") + within)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
    return counts.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def summary(cover: DataFrame, rollups: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """One row: drops, gaps, median spread, mean confidence, and how fresh the pairs are."""
    day = F.lit((as_of - timedelta(days=days)).date())
    kept = rollups.where(F.col("day") >= day).agg(F.coalesce(F.sum("drops"), F.lit(0)).alias("price_drops"), (F.sum("conf_sum") / F.sum("conf_count")).alias("mean_confidence"))
    by_sku = cover.where(F.col("last_seen_at") >= since(as_of, days)).groupBy("sku").agg(F.count("*").alias("n"), (F.max("last_cents") - F.min("last_cents")).alias("spread"))
    middle = whole_median(by_sku.where("spread > 0"), "spread").select(F.coalesce("median", F.lit(0.0)).alias("median_spread_cents"))
    spread = by_sku.agg(F.count_if(F.col("n") < 3).alias("gaps")).crossJoin(middle)
    age = F.lit(as_of).cast("long") - F.col("last_seen_any_at").cast("timestamp").cast("long")
    fresh = cover.agg(
        F.count("*").alias("pairs"), F.count_if(age <= 86400).alias("today"), F.count_if((age > 86400) & (age <= 7 * 86400)).alias("this_week"),
        F.count_if((age > 7 * 86400) & (age <= 30 * 86400)).alias("this_month"), F.count_if(age > 30 * 86400).alias("stale"),
    )
    return kept.crossJoin(spread).crossJoin(fresh)  # one row each


def gaps(cover: DataFrame, products: DataFrame, n_stores: int, as_of: datetime, days: int, top: int = 15) -> DataFrame:
    """Products that the fewest stores price; the limit comes before the join, so there may be fewer rows."""
    seen = priced(cover, as_of, days).groupBy("sku").agg(F.count("*").alias("n_stores"))
    first = seen.where(F.col("n_stores") < n_stores).orderBy("n_stores", "sku").limit(top)
    score = F.round((n_stores - F.col("n_stores")) / n_stores * 100).cast("int")
    return first.join(products, "sku").select("sku", "name", "category", "n_stores", score.alias("opportunity_score"))


def price_wars(cover: DataFrame, products: DataFrame, as_of: datetime, days: int, top: int = 10) -> DataFrame:
    """The widest relative spreads among products that three stores or more price."""
    by_sku = priced(cover, as_of, days).groupBy("sku").agg(F.count("*").alias("n_stores"), F.min("last_priced_cents").alias("low"), F.max("last_priced_cents").alias("high"), F.array_sort(F.collect_list(F.struct("store_id", "last_priced_cents"))).alias("prices"))
    wide = by_sku.where("n_stores >= 3").withColumn("spread", F.col("high") - F.col("low")).withColumn("spread_pct", F.col("spread") * 100 / F.col("low"))
    first = wide.orderBy(F.desc("spread_pct"), "sku").limit(top)
    listed = F.array_join(F.transform("prices", lambda p: F.concat_ws(":", p["store_id"], p["last_priced_cents"].cast("string"))), ",")
    return first.join(products, "sku").select("sku", "name", "n_stores", "spread", "spread_pct", listed.alias("prices"))


def restock(cover: DataFrame, products: DataFrame, as_of: datetime, days: int, top: int = 15) -> DataFrame:
    """Products out of stock at some stores and in stock at others; an unknown stock counts as out."""
    stocked = F.coalesce("last_in_stock", F.lit(False))
    by_sku = cover.where(F.col("last_seen_at") >= since(as_of, days)).groupBy("sku").agg(F.count_if(~stocked).alias("out_of_stock"), F.count_if(stocked).alias("in_stock"))
    both = by_sku.where("out_of_stock > 0 AND in_stock > 0").join(products, "sku")
    return both.select("sku", "name", "out_of_stock", "in_stock").orderBy(F.desc("out_of_stock"), "sku").limit(top)


def leaderboard(cover: DataFrame, pairs: DataFrame, stores: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Per competitor: products, stock, sales, and whether sales could be computed."""
    counted = priced(cover, as_of, days).groupBy("store_id").agg(
        F.count("*").alias("products"), F.count_if(F.coalesce("last_in_stock", F.lit(False))).alias("in_stock"), F.count_if(F.col("last_sold_pos_at").isNotNull() | F.col("last_usable_qty_at").isNotNull()).alias("with_signal")
    )
    sales = pairs.groupBy("store_id").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    status = F.when(F.coalesce("units", F.lit(0)) > 0, "computed").when(F.col("with_signal") == 0, "sales_data_unavailable").otherwise("insufficient_history")
    rows = counted.join(stores.where("NOT is_own"), "store_id").join(sales, "store_id", "left")
    rows = rows.select("store_id", "products", "in_stock", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("revenue", F.lit(0)).alias("revenue"), status.alias("status"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), F.desc("products"), "store_id")))  # a row a store


def top_sellers(pairs: DataFrame, products: DataFrame, top: int = 20) -> DataFrame:
    sold = pairs.groupBy("sku").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue")).where("units > 0").join(products, "sku")
    return sold.select("sku", "name", "brand", "units", "revenue").orderBy(F.desc("units"), F.desc("revenue"), "sku").limit(top)


def trending(pairs: DataFrame, products: DataFrame, each: int = 5) -> DataFrame:
    """Stock that went, by category, with each category's first products."""
    dropped = pairs.groupBy("sku").agg(F.sum("qty_drop").alias("qty_drop")).join(products, "sku")
    part = F.pmod(F.xxhash64("sku"), F.lit(64))
    in_part = Window.partitionBy("category", part).orderBy(F.desc("qty_drop"), "sku")
    first = dropped.withColumn("place", F.row_number().over(in_part)).where(F.col("place") <= each)  # a few of each part of a category
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("qty_drop"), "sku"))).where(F.col("place") <= each)
    listed = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sku"))), lambda x: x["sku"].cast("string")), ",").alias("first_products"))
    return dropped.groupBy("category").agg(F.sum("qty_drop").alias("qty_drop")).join(listed, "category")


def trending_kinds(pairs: DataFrame, products: DataFrame, each: int = 5) -> DataFrame:
    """Stock that went, by food form where the name says it and by category else, of all products (sku, name): kinds where nothing went too, with the first products of which some did."""
    kind = text.category(F.col("name"))
    named = products.select("sku", kind.alias("kind"), "name").select("sku", F.coalesce(text.food_form(F.col("kind"), F.col("name")), "kind").alias("category"))
    went = named.join(pairs.groupBy("sku").agg(F.sum("qty_drop").alias("qty_drop")), "sku", "left").fillna(0, ["qty_drop"])
    some = went.where("qty_drop > 0")
    listed = trending(some.select("sku", "qty_drop"), some.select("sku", "category"), each).select("category", "first_products")
    return went.groupBy("category").agg(F.sum("qty_drop").alias("qty_drop")).join(listed, "category", "left")


def brand_share(pairs: DataFrame, products: DataFrame, top: int = 20) -> DataFrame:
    """Units and revenue by brand; shares are of all brands."""
    brand = F.when(F.coalesce(F.trim("brand"), F.lit("")) == "", "Unknown").otherwise(F.trim("brand"))
    by_brand = pairs.join(products, "sku").groupBy(brand.alias("brand")).agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    total = by_brand.agg(F.sum("revenue").alias("total"))
    rows = by_brand.crossJoin(F.broadcast(total)).withColumn("share_pct", F.col("revenue") * 100 / F.col("total")).drop("total")  # one row
    return rows.orderBy(F.desc("revenue"), "brand").limit(top)


def digest(snaps: DataFrame, as_of: datetime, days: int, least_drop: float = 0.05) -> DataFrame:
    """Per pair: the drop from first to last price where it is large, and whether it went out of stock on the way."""
    recent = snaps.where(F.col("crawled_at") >= since(as_of, days))
    order = Window.partitionBy(*PAIR).orderBy("crawled_at", "seq")
    steps = recent.withColumn("went_out", F.lag("in_stock").over(order) & ~F.col("in_stock"))
    ends = steps.groupBy(*PAIR).agg(F.min_by("cents", F.struct("crawled_at", "seq")).alias("first_cents"), F.max_by("cents", F.struct("crawled_at", "seq")).alias("last_cents"), F.bool_or("went_out").alias("went_out"))
    drop = F.when((F.col("first_cents") - F.col("last_cents")) >= least_drop * F.col("first_cents"), F.col("first_cents") - F.col("last_cents"))
    return ends.withColumn("drop_cents", drop).withColumn("went_out", F.coalesce("went_out", F.lit(False))).where("drop_cents IS NOT NULL OR went_out")


def market_share(newest: DataFrame) -> DataFrame:
    """Per store, over latest rows: catalogue share, stock, discounts, mean price."""
    all_skus = newest.agg(F.countDistinct("sku").alias("all_skus"))
    by_store = newest.groupBy("store_id").agg(
        F.countDistinct("sku").alias("skus"), (F.count_if("in_stock") * 100 / F.count("*")).alias("in_stock_pct"), (F.count_if(F.col("discount_pct") > 0) * 100 / F.count("*")).alias("discounted_pct"),
        F.avg(F.when(F.col("discount_pct") > 0, F.col("discount_pct"))).alias("avg_discount"), (F.sum("cents") / F.count("cents")).alias("avg_cents"),
    )
    return by_store.crossJoin(all_skus).withColumn("catalog_share_pct", F.col("skus") * 100 / F.col("all_skus")).drop("all_skus")  # one row


def freshness(cover: DataFrame, stores: DataFrame, as_of: datetime) -> DataFrame:
    """Per store, pairs by age; a store without pairs has zeros."""
    age = F.floor((F.lit(as_of).cast("long") - F.col("last_seen_any_at").cast("timestamp").cast("long")) / 86400)
    counted = cover.withColumn("age", age).groupBy("store_id").agg(
        F.max("last_seen_any_at").alias("newest"), F.count_if(F.col("age") < 1).alias("today"), F.count_if(F.col("age").between(1, 6)).alias("this_week"),
        F.count_if(F.col("age").between(7, 29)).alias("this_month"), F.count_if(F.col("age") >= 30).alias("stale"), F.count("sku").alias("pairs"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("today", "this_week", "this_month", "stale", "pairs")]
    return stores.join(counted, "store_id", "left").select("store_id", "newest", *zero)  # a row a store on both sides


def freshness_bottleneck(cover: DataFrame, stores: DataFrame) -> DataFrame:
    """The competitor that was read longest ago, and when: what the market view is as fresh as; one row."""
    newest = cover.groupBy("store_id").agg(F.max("last_seen_any_at").alias("newest")).join(stores.where("NOT is_own").select("store_id"), "store_id")
    return newest.agg(F.min("newest").alias("as_fresh_as"), F.min_by("store_id", F.struct("newest", "store_id")).alias("bottleneck"))  # a row a store


def age_shares(cover: DataFrame, as_of: datetime) -> DataFrame:
    """Shares of pairs by age in percent, of at least one pair; one row."""
    age = F.lit(as_of).cast("long") - F.col("last_seen_any_at").cast("timestamp").cast("long")
    total = F.greatest(F.count("*"), F.lit(1))
    share = lambda low, high: F.round(F.count_if((age > low) & (age <= high)) * 100 / total, 1)
    day = 86400
    return cover.agg(share(-(1 << 62), day).alias("today_pct"), share(day, 7 * day).alias("this_week_pct"), share(7 * day, 30 * day).alias("this_month_pct"), share(30 * day, 1 << 62).alias("stale_pct"))


def horizon(snaps: DataFrame, stores: DataFrame) -> DataFrame:
    """Readings by day, own and competitors'."""
    return snaps.join(stores, "store_id").groupBy(F.to_date("crawled_at").alias("day"), "is_own").agg(F.count("*").alias("readings"))


def percentile_histogram(cover: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Per store: how its prices of shared products stand among sellers, in four buckets, and the median of their ratio to the product's median price."""
    rows = priced(cover, as_of, days).select("sku", "store_id", F.col("last_priced_cents").alias("cents"))
    whole = Window.partitionBy("sku")
    rows = rows.select("*", F.percent_rank().over(whole.orderBy("cents")).alias("standing"), F.count("*").over(whole).alias("sellers"), F.median("cents").over(whole).alias("middle")).where("sellers >= 2")
    bucket = F.least(F.lit(3), F.floor(F.col("standing") * 4).cast("int"))
    counts = rows.groupBy("store_id").agg(*(F.count_if(bucket == b).alias(f"from_{25 * b}") for b in range(4)), F.count("*").alias("shared"))
    ratio = whole_median(rows.withColumn("ratio", F.round(F.col("cents") * 1_000_000 / F.col("middle")).cast("long")), "ratio", ("store_id",))
    return counts.join(ratio, "store_id", "left").withColumn("median_price_ratio", F.round(F.col("median") / 1_000_000, 3)).drop("median")


def digest_summary(snaps: DataFrame, seen: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """The digest's figures, one row: products, price drops of five percent, stock-outs, new products (seen: sku, first_seen_at), the most active store, readings."""
    recent = snaps.where(F.col("crawled_at") >= since(as_of, days))
    found = digest(snaps, as_of, days).agg(F.count("drop_cents").alias("total_price_drops"), F.count_if("went_out").alias("total_oos_events"))
    active = recent.groupBy(*PAIR).agg(F.count("*").alias("n")).where("n >= 2").groupBy("store_id").agg(F.count("*").alias("pairs"))
    most = active.agg(F.max_by("store_id", F.struct("pairs", "store_id")).alias("most_active_store"))
    fresh = seen.agg(F.count("*").alias("total_skus"), F.count_if(F.col("first_seen_at") >= since(as_of, days)).alias("total_new_products"))
    return found.crossJoin(most).crossJoin(fresh).crossJoin(recent.agg(F.count("*").alias("snapshots")))  # one row each


def new_products(seen: DataFrame, as_of: datetime, days: int, top: int = 3) -> DataFrame:
    """The newest products of the window."""
    return seen.where(F.col("first_seen_at") >= since(as_of, days)).orderBy(F.desc("first_seen_at"), "sku").limit(top)


def store_profiles(snaps: DataFrame, sales: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Per store: catalogue size, products active in the last week, mean discount of its latest discounted rows, span, and revenue by month and day.

    sales: window_sales() without a confidence floor; products with fewer than two readings have none.
    """
    skus = snaps.groupBy("store_id").agg(F.countDistinct("sku").alias("catalog_size"))
    active = snaps.where(F.col("in_stock") & (F.col("crawled_at") >= since(as_of, 7))).groupBy("store_id").agg(F.countDistinct("sku").alias("active_skus"))
    newest = latest(snaps.select(*PAIR, "crawled_at", "seq", "discount_pct"))
    cut = newest.groupBy("store_id").agg(F.round(F.avg(F.when(F.col("discount_pct") > 0, F.col("discount_pct"))), 1).alias("avg_discount_rate"))
    recent = snaps.where(F.col("crawled_at") >= since(as_of, days))
    whole_days = F.floor((F.max("crawled_at").cast("timestamp").cast("long") - F.min("crawled_at").cast("timestamp").cast("long")) / 86400)
    span = recent.groupBy("store_id").agg(F.greatest(whole_days, F.lit(1)).alias("data_span_days"))
    sold = sales.where("units > 0").groupBy("store_id").agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"))
    rows = skus.join(active, "store_id", "left").join(cut, "store_id", "left").join(span, "store_id", "left").join(sold, "store_id", "left").fillna(0, ["active_skus", "avg_discount_rate", "revenue", "units"]).fillna(1, ["data_span_days"])
    rate = lambda c, n, digits: F.round(F.col(c) * n / F.col("data_span_days"), digits)
    return rows.select("store_id", "catalog_size", "active_skus", "avg_discount_rate", "data_span_days", rate("revenue", 30, 0).cast("long").alias("est_monthly_revenue"), rate("revenue", 1, 0).cast("long").alias("est_daily_revenue"), rate("units", 1, 1).alias("est_daily_units"))


def profile_days(steps: DataFrame, sales: DataFrame) -> DataFrame:
    """Revenue of each store by day, of products that sold anything in the window; days without are left out."""
    sold = steps.join(sales.where("units > 0").select(*PAIR), PAIR, "left_semi").withColumn("revenue", F.col("units") * F.coalesce("cents", F.lit(0)))
    return sold.groupBy("store_id", F.to_date("crawled_at").alias("day")).agg(F.sum("revenue").alias("revenue")).where("revenue > 0")


def profile_categories(newest: DataFrame, products: DataFrame) -> DataFrame:
    """How many of a store's products are in each category."""
    return newest.select(*PAIR).join(products.select("sku", "category"), "sku").groupBy("store_id", "category").agg(F.count("*").alias("products"))
