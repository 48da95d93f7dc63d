"""The pack of report files on the market: shares, comparisons, discounts, stock, new products, and their summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def pack(newest: DataFrame, matches: DataFrame, products: DataFrame, own: DataFrame, stores: DataFrame, as_of: datetime, days: int = 30, recent_days: int = 14) -> dict[str, DataFrame]:
    """The report's tables by file name. newest: each pair's newest reading in the window (sku, store_id, cents, list_cents, discount_pct, qty, in_stock, crawled_at); matches: as matching.matches() gives them;
    products: sku, name, brand, category, first_seen_at; own: sku; stores: store_id, domain, platform.
    """
    share = newest.groupBy("store_id").agg(
        F.count("*").alias("skus_tracked"), F.count_if("in_stock").alias("stocked"), F.count_if(F.col("discount_pct") > 0).alias("discounted"),
        F.sum(F.when(F.col("discount_pct") > 0, F.col("discount_pct"))).alias("off"), F.sum("cents").alias("cents"),
    )
    total = share.agg(F.sum("skus_tracked").alias("total"))
    pct = lambda part, whole: F.round(F.col(part) * 100 / F.col(whole), 1)
    shares = share.crossJoin(F.broadcast(total)).join(F.broadcast(stores.select("store_id", "domain", "platform")), "store_id", "left").select(  # one row; a row a store
        "store_id", "domain", "platform", "skus_tracked", pct("skus_tracked", "total").alias("catalog_share_pct"), pct("stocked", "skus_tracked").alias("in_stock_rate_pct"), pct("discounted", "skus_tracked").alias("pct_skus_on_discount"),
        F.coalesce(F.round(F.col("off") / F.when(F.col("discounted") > 0, F.col("discounted")), 1), F.lit(0.0)).alias("avg_discount_pct_when_discounted"), F.round(F.col("cents") / F.col("skus_tracked") / 100, 2).alias("avg_price_sar"),
    )
    off = newest.where("discount_pct > 0").select("store_id", "sku", "cents", "list_cents", "discount_pct", "in_stock", "qty", "crawled_at")
    out = newest.where(~F.coalesce("in_stock", F.lit(False))).select("store_id", "sku", "cents", "crawled_at")
    new = products.where(F.col("first_seen_at") >= F.lit(as_of - timedelta(days=recent_days))).select("sku", "name", "brand", "category", "first_seen_at")
    positions = matches.groupBy("position").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("position", "n"))).alias("p"))
    summary = (
        positions.select(F.transform("p", lambda x: F.concat_ws("=", x["position"], x["n"].cast("string"))).alias("price_position_counts"))
        .crossJoin(matches.agg(F.countDistinct("my_sku").alias("my_skus_matched_to_competitors"), F.count("*").alias("match_rows")))
        .crossJoin(share.agg(F.count("*").alias("stores_with_data"), F.coalesce(F.sum("skus_tracked"), F.lit(0)).alias("competitor_skus_tracked"), F.coalesce(F.sum("discounted"), F.lit(0)).alias("competitor_skus_on_discount"), F.coalesce(F.sum(F.col("skus_tracked") - F.col("stocked")), F.lit(0)).alias("competitor_skus_out_of_stock")))
        .crossJoin(own.agg(F.count("*").alias("my_products"))).crossJoin(new.agg(F.count("*").alias("products_recently_added"))).crossJoin(stores.agg(F.count("*").alias("stores_total")))
        .select(F.lit(days).alias("window_days"), "*")
    )  # fmt: skip  # one row each
    return {"market_share": shares, "price_comparison": matches, "discounts": off, "out_of_stock": out, "recently_added": new, "summary": summary}


def written(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a pack in a folder of its own: CSV with a byte-order mark and a header, the summary as JSON."""
    for name, rows in tables.items():
        if name == "summary":
            rows.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
            continue
        flat = rows.select(*(F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes))
        first = flat.columns[0]
        flat.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{name}")
