"""Revenue of stores on one axis: from the ledger or stock, from badges, else estimated from other stores' velocity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.model import MIN_CATEGORY
from tarifa.operators.rollups import since

#: The estimate's band in percent, whatever its coverage: it is the back-test's error.
BAND_PCT = 50


def observed(cover: DataFrame, pairs: DataFrame, products: DataFrame, stores: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """store_id, sku, category, cents, units: every product that a measurable competitor prices in the window, with 0 where nothing was sold."""
    shown = priced(cover, products, as_of, days).join(stores.where("measurable AND NOT is_own").select("store_id"), "store_id")
    return shown.join(pairs.select("store_id", "sku", "units"), ["store_id", "sku"], "left").fillna(0, ["units"])


def priced(cover: DataFrame, products: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """store_id, sku, category, cents of products with a positive price in the window."""
    recent = cover.where((F.col("last_priced_at") >= since(as_of, days)) & (F.col("last_priced_cents") > 0))
    return recent.select("store_id", "sku", F.col("last_priced_cents").alias("cents")).join(products.select("sku", "category"), "sku")


def estimates(shown: DataFrame, seen: DataFrame, least: int = MIN_CATEGORY) -> DataFrame:
    """Per store of shown (store_id, sku, category, cents): its products' prices times the mean units of the product, else of its category, else of all.

    seen: observed(). A category needs `least` observations. Counts say which pool each product rests on; the band is fixed.
    """
    by_sku = seen.groupBy("sku").agg((F.sum("units") / F.count("*")).alias("of_sku"))
    by_category = seen.groupBy("category").agg((F.sum("units") / F.count("*")).alias("of_category"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    rows = shown.join(by_sku, "sku", "left").join(F.broadcast(by_category), "category", "left").crossJoin(F.broadcast(seen.agg((F.sum("units") / F.count("*")).alias("of_all"))))  # a row a category; one row
    units = F.coalesce("of_sku", "of_category", "of_all")
    sums = rows.groupBy("store_id").agg(
        F.round(F.sum(units * F.col("cents")), -2).cast("long").alias("revenue_est"), F.count("of_sku").alias("per_sku"), F.count_if(F.col("of_sku").isNull() & F.col("of_category").isNotNull()).alias("per_category"),
        F.count_if(F.col("of_sku").isNull() & F.col("of_category").isNull() & F.col("of_all").isNotNull()).alias("per_global"),
    )
    priced_ = F.col("per_sku") + F.col("per_category") + F.col("per_global")
    share = (F.col("per_sku") + F.col("per_category")) / priced_
    confidence = F.when(priced_ == 0, "none").when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")
    low, high = (F.round(F.col("revenue_est") * (100 + sign * BAND_PCT) / 100).cast("long") for sign in (-1, 1))
    return sums.select("*", priced_.alias("priced_products"), confidence.alias("confidence"), low.alias("range_low"), high.alias("range_high"), F.round(F.col("per_sku") / priced_, 4).alias("coverage"))


def badge_revenue(badges: DataFrame) -> DataFrame:
    """Per store, revenue that badge steps measured (badge_velocity() rows), and the share of products that it rests on."""
    measured = F.count_if((F.col("status") == "measured_approx") & F.col("revenue").isNotNull())
    return badges.groupBy("store_id").agg(
        F.coalesce(F.sum(F.when(F.col("status") == "measured_approx", F.col("revenue"))), F.lit(0)).alias("revenue"), measured.alias("products_measured"), F.count_if(F.col("status") == "baseline_only").alias("products_baseline_only"),
        F.count_if(F.col("status") == "all_capped").alias("products_capped"), F.count("*").alias("products_total"), F.round(measured * 100 / F.count("*"), 1).alias("coverage_pct"), (measured > 0).alias("usable"),
    )


def badge_coverage(readings: DataFrame, badges: DataFrame, meta: DataFrame) -> DataFrame:
    """Per store, how many products show a badge and how many can be measured; a store without readings has zeros."""
    shown = readings.groupBy("store_id", "sku").agg(F.bool_or(F.coalesce(F.col("sold") > 0, F.lit(False))).alias("has_badge"), F.bool_or(F.coalesce("capped", F.lit(False))).alias("capped"))
    seen = shown.groupBy("store_id").agg(F.count("*").alias("products_seen"), F.count_if("has_badge").alias("products_with_badge"), F.count_if("capped").alias("products_with_capped_reading"))
    done = badges.groupBy("store_id").agg(
        F.count_if(F.col("status") == "measured_approx").alias("products_diffable"), F.count_if(F.col("status") == "baseline_only").alias("products_baseline_only"), F.coalesce(F.sum(F.when(F.col("status") == "measured_approx", F.col("units"))), F.lit(0)).alias("units_in_window")
    )
    rows = meta.select("store_id", "platform").join(seen, "store_id", "left").join(done, "store_id", "left").na.fill(0)
    verdict = F.when(F.col("products_diffable") > 0, "measured_approx").when(F.col("products_with_badge") > 0, "awaiting_second_crawl").otherwise("no_badge_stays_estimated")
    return rows.withColumn("verdict", verdict)


def axis(cover: DataFrame, stores: DataFrame, pairs: DataFrame, own_revenue: DataFrame, badges: DataFrame, estimated: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Stores with priced products by revenue: what the ledger or stock say, else badges, else the estimate, else nothing, which is last and isn't zero.

    own_revenue: one row (revenue, orders) of the own ledger; badges: badge_revenue(); estimated: estimates().
    """
    recent = cover.where((F.col("last_priced_at") >= since(as_of, days)) & (F.col("last_priced_cents") > 0))
    signals = recent.groupBy("store_id").agg(F.count("*").alias("products"), F.bool_or(F.col("last_sold_pos_at").isNotNull()).alias("sold_sig"), F.bool_or(F.col("last_usable_qty_at").isNotNull()).alias("qty_sig"))
    sold = pairs.groupBy("store_id").agg(F.sum("revenue").alias("sold"))
    rows = stores.join(signals, "store_id").join(sold, "store_id", "left").crossJoin(F.broadcast(own_revenue.select(F.when(F.col("orders") > 0, F.col("revenue")).alias("ledger"))))  # one row
    rows = rows.join(badges.select("store_id", F.col("revenue").alias("approx"), "usable"), "store_id", "left").join(estimated.select("store_id", "revenue_est"), "store_id", "left")
    exact = F.when(F.col("is_own"), F.col("ledger")).when(F.col("measurable") & (F.col("sold") > 0), F.col("sold"))
    status = F.when(F.col("is_own"), F.when(F.col("ledger").isNotNull(), "ledger").otherwise("accumulating")).when(exact.isNotNull(), "computed").when(~F.col("sold_sig") & ~F.col("qty_sig"), "not_measurable").otherwise("accumulating")
    approx = F.when(~F.col("is_own") & F.col("usable") & (F.col("approx") > 0), F.col("approx"))
    guess = F.when(~F.col("is_own") & ~F.col("measurable") & approx.isNull() & (F.col("revenue_est") > 0), F.col("revenue_est"))
    basis = F.when(exact.isNotNull(), "exact").when(approx.isNotNull(), "measured_approx").when(guess.isNotNull(), "estimated").otherwise("none")
    rows = rows.select("store_id", "products", status.alias("revenue_status"), F.coalesce(exact, approx, guess).cast("long").alias("revenue"), basis.alias("basis"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("revenue").desc_nulls_last(), F.desc("products"), "store_id")))  # a row a store


def back_test_summary(tested: DataFrame) -> DataFrame:
    """One row over back_test(): stores, mean, median and worst absolute error, how many are within 30 percent, and what that says."""
    error = F.abs("error_pct")
    found = tested.where("actual > 0").agg(F.count("*").alias("stores_tested"), F.round(F.avg(error), 1).alias("mean_abs_error_pct"), F.round(F.median(error), 1).alias("median_abs_error_pct"), F.max(error).alias("worst_abs_error_pct"), F.count_if(error <= 30).alias("within_30pct"))  # a row a store
    middle = F.col("median_abs_error_pct")
    verdict = F.when(F.col("stores_tested") < 3, "inconclusive").when(middle <= 30, "trustworthy").when(middle <= 100, "weak").otherwise("too_weak")
    return found.withColumn("verdict", verdict)


def overlap(links: DataFrame) -> DataFrame:
    """How many own products each store has a match for."""
    return links.groupBy("store_id").agg(F.countDistinct("my_sku").alias("overlap"))


def own_counts(own: DataFrame, as_of: datetime) -> DataFrame:
    """Own products with a price, in stock (flag or quantity), and synced within 48 hours; one row."""
    price = F.coalesce(F.when(F.col("sale_cents") != 0, F.col("sale_cents")), F.col("cents"))
    return own.agg(
        F.count_if(price > 0).alias("priced"), F.count_if(F.coalesce("in_stock", F.lit(False)) | (F.coalesce("qty", F.lit(0)) > 0)).alias("in_stock"), F.count_if(F.col("synced_at") >= F.lit(as_of) - F.expr("INTERVAL 48 HOURS")).alias("fresh")
    )
