"""The own catalogue against the market: rows, KPIs, pages, sellers, and looking up own rows by heterogeneous keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import numbers, text

#: A row older than this is labelled stale; a seller's rows are looked for this far back.
STALE_DAYS, LOOKBACK_DAYS = 7, 180
_LEAD = r"^([0-9]{8,14})(?=[^0-9]|$)"


def truthy(value: Column) -> Column:
    """A number, null where it is 0: what a coalesce chain falls through."""
    return F.when(value != 0, value)


def on_store(own: DataFrame) -> DataFrame:
    """Own rows that the store still has; one never flagged counts as present."""
    return own.where(F.coalesce("present", F.lit(True)))


def stitched(products: DataFrame, own: DataFrame) -> DataFrame:
    """Catalogue rows of own products, and own products that the catalogue lacks, with an empty category."""
    known = products.join(own.select("sku"), "sku", "left_semi").select("sku", "category", F.lit(True).alias("in_catalogue"))
    missing = own.join(products.select("sku"), "sku", "left_anti").select("sku", F.lit("").alias("category"), F.lit(False).alias("in_catalogue"))
    return known.unionByName(missing)


def competitors(own: DataFrame, links: DataFrame, newest: DataFrame, own_store: str) -> DataFrame:
    """my_sku, store_id, cents, confidence, source: each competitor of an own product once.

    Matches come first, the most confident and then the least rival_sku of a store; stores without one are filled from shops whose sku is the
    own barcode (code_sku). A reading without a price counts as a competitor.
    """
    rows = newest.select(F.col("sku").alias("rival_sku"), "store_id", "cents")
    matched = links.join(own.select(F.col("sku").alias("my_sku")), "my_sku", "left_semi").select("my_sku", "rival_sku", "store_id", "confidence").join(rows, ["rival_sku", "store_id"]).withColumn("source", F.lit(0))
    coded = own.where("code_sku IS NOT NULL").select(F.col("sku").alias("my_sku"), F.col("code_sku").alias("rival_sku")).join(rows, "rival_sku")
    coded = coded.where(F.col("store_id") != own_store).withColumn("confidence", F.lit(0)).withColumn("source", F.lit(1))
    both = matched.unionByName(coded.select(*matched.columns))
    first = F.row_number().over(Window.partitionBy("my_sku", "store_id").orderBy("source", F.desc("confidence"), "rival_sku"))
    return both.withColumn("first", first).where("first = 1").drop("first")


def rows(own: DataFrame, products: DataFrame, links: DataFrame, newest: DataFrame, sales: DataFrame, orders_by_sku: DataFrame, own_store: str) -> DataFrame:
    """A row an own product on the store: its price and stock, the market's prices and units, its competitors, its share.

    newest: the window's latest reading of each pair; sales: units and revenue of each pair in the window. A product without readings stays, with
    zeros. An unknown stock is null, never a level.
    """
    mine = on_store(own)
    price = F.coalesce(truthy(F.col("sale_cents")), F.col("cents"))
    market = newest.groupBy("sku").agg(F.count("*").alias("num_sellers"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.median("cents").alias("middle"), (F.sum("cents") / F.count("cents")).alias("mean"))
    sold = sales.groupBy("sku").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    rivals = competitors(mine, links, newest, own_store).groupBy(F.col("my_sku").alias("sku")).agg(
        F.count("*").alias("num_competitors"), F.count("cents").alias("num_priced"), F.min("cents").alias("rival_low"), F.max("cents").alias("rival_high"), F.max("confidence").alias("confidence")
    )
    base = stitched(products, mine).join(mine.select("sku", "name", "barcode", price.alias("my_cents"), "qty", "in_stock", "url"), "sku")
    all_ = base.join(market, "sku", "left").join(sold, "sku", "left").join(rivals, "sku", "left").join(orders_by_sku.select("sku", F.col("units").alias("o_units"), F.col("revenue").alias("o_revenue")), "sku", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    over = lambda a, b: F.round((a - b) * 100 / b, 1)
    shares = (zero("num_priced") >= 1) & (zero("units") > 0)
    stock = F.when(F.col("qty").isNotNull() | F.col("in_stock").isNotNull(), numbers.stock_signal(F.col("in_stock"), F.col("qty")))
    url = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.concat(F.lit("https://own.example/search?keyword="), F.col("sku").cast("string")))
    return all_.select(
        "sku", "name", "barcode", "category", "in_catalogue", "my_cents", stock.alias("my_stock"), url.alias("product_url"), zero("num_sellers").alias("num_sellers"), "low", "high", "middle",
        F.when(F.col("low") > 0, over(F.col("mean"), F.col("low"))).alias("vs_lowest_pct"), F.when(F.col("middle") > 0, over(F.col("mean"), F.col("middle"))).alias("vs_median_pct"),
        zero("units").cast("long").alias("market_units"), zero("revenue").cast("long").alias("market_revenue"), zero("num_competitors").alias("num_competitors"), zero("num_priced").alias("num_priced"), "rival_low", "rival_high",
        F.when(F.col("my_cents") > 0, over(F.col("rival_low"), F.col("my_cents"))).alias("vs_my_price_pct"), zero("confidence").alias("confidence"), zero("o_units").cast("long").alias("my_units"), zero("o_revenue").cast("long").alias("my_revenue"),
        F.when(shares, F.round(zero("o_units") * 100 / F.col("units"), 1)).alias("share_pct"), shares.alias("has_share"),
    )


def kpis(table: DataFrame, order_totals: DataFrame) -> DataFrame:
    """The page's KPIs from rows() and the order ledger's totals (orders, units, revenue): one row."""
    share = lambda c: F.sum(F.when(F.col("has_share"), F.col(c)))
    found = table.agg(
        F.count("*").alias("total_products"), F.coalesce(F.sum("market_units"), F.lit(0)).alias("total_units_sold"), F.coalesce(F.sum("market_revenue"), F.lit(0)).alias("market_revenue"),
        F.coalesce(F.round(share("my_units") * 100 / share("market_units"), 1), F.lit(0.0)).alias("avg_market_share"), F.count_if(F.col("num_priced") >= 1).alias("matched_products"),
        F.coalesce(F.round(F.count_if(F.col("num_priced") >= 1) * 100 / truthy(F.count("*")), 1), F.lit(0.0)).alias("market_coverage_pct"), F.count_if("has_share").alias("share_sample_size"),
        F.coalesce(F.sum(F.coalesce("my_cents", F.lit(0)) * F.col("market_units")), F.lit(0)).alias("total_revenue"),
    )
    ledger = order_totals.select(F.col("orders").alias("my_orders_count"), F.col("units").alias("my_units_sold"), F.col("revenue").alias("my_revenue"), F.when(F.col("orders") > 0, "orders").otherwise("estimated").alias("my_revenue_source"))
    return found.crossJoin(ledger)  # one row each


def searched(table: DataFrame, needle: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of which a column holds the needle as it stands, upper and lower case alike; an empty needle keeps all."""
    found = F.lit(not needle)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False))
    return table.where(found)


def of_category(table: DataFrame, wanted: str, subcategories: tuple[str, ...]) -> DataFrame:
    """Rows of a category, or of a subcategory where it is one; 'all' and '' keep everything."""
    if wanted in ("", "all"):
        return table
    return table.where(F.col("subcategory" if wanted in subcategories else "category") == wanted)


def page(table: DataFrame, sort_by: str, skip: int, limit: int, descending: bool = True) -> DataFrame:
    """One page, sorted by a column with null as 0, ties by sku."""
    key = F.coalesce(F.col(sort_by), F.lit(0))
    return table.orderBy(key.desc() if descending else key.asc(), "sku").offset(skip).limit(limit)


def category_list(table: DataFrame) -> DataFrame:
    """All categories and subcategories that occur, in order."""
    one = lambda c: table.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias("category"))
    return one("category").union(one("subcategory")).distinct().orderBy("category")


def freshness_labels(at: Column, as_of: datetime) -> list[Column]:
    """Age in whole days, whether stale, the day it is as of, and live, stale or unknown; without a time all is stale."""
    age = F.greatest(F.floor((F.lit(as_of).cast("long") - at.cast("timestamp").cast("long")) / 86400), F.lit(0))
    stale = F.coalesce(age >= STALE_DAYS, F.lit(True))
    status = F.when(at.isNull(), "unknown").when(stale, "stale").otherwise("live")
    return [age.alias("days_since_crawl"), stale.alias("is_stale"), F.to_date(at).alias("price_as_of"), status.alias("data_status")]


def is_oos(signal: Column, in_stock: Column, qty: Column) -> Column:
    """Out of stock by signal or flag, or where neither is known and there is no quantity."""
    unknown = in_stock.isNull() & (F.coalesce(qty, F.lit(0)) <= 0) & (signal.isNull() | (signal == "OOS"))
    return F.coalesce(signal == "OOS", F.lit(False)) | F.coalesce(~in_stock, F.lit(False)) | unknown


def sellers(hubs: DataFrame, links: DataFrame, snaps: DataFrame, names: DataFrame, as_of: datetime, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Every store's newest reading of each product of hubs (sku): by the product's own sku anywhere, by its barcode as a sku anywhere where hubs has one (barcode), or by a matched sku at that match's store only.

    Rows reached by sku or barcode pass; matched rows are checked again for the pack their names state, and rejected ones are marked, not lost.
    Of readings at one time that of the largest key counts, by its own sku before a match; of one key's, the one with the largest seq.
    """
    recent = snaps.where(F.col("crawled_at") >= F.lit(as_of) - F.expr(f"INTERVAL {lookback} DAYS"))
    direct = hubs.select("sku", F.col("sku").alias("key"), F.lit(None).cast("string").alias("at_store"))
    alias = links.join(hubs, links["my_sku"] == hubs["sku"], "left_semi").where("rival_sku <> my_sku").select(F.col("my_sku").alias("sku"), F.col("rival_sku").alias("key"), F.col("store_id").alias("at_store")).distinct()
    read = recent.withColumnRenamed("sku", "key")
    by_sku = direct.drop("at_store").join(read, "key").withColumn("match_source", F.lit("sku"))
    by_match = alias.withColumnRenamed("at_store", "store_id").join(read, ["key", "store_id"]).withColumn("match_source", F.lit("matched"))
    both = by_sku.unionByName(by_match.select(*by_sku.columns))
    if "barcode" in hubs.columns:
        coded = hubs.where(text.is_barcode(F.trim("barcode")) & (F.trim("barcode") != F.col("sku").cast("string"))).select("sku", F.trim("barcode").alias("code"))
        by_code = coded.join(read, F.col("code") == F.col("key").cast("string")).drop("code").withColumn("match_source", F.lit("barcode"))
        both = both.unionByName(by_code.select(*by_sku.columns))
    hub_name, key_name = names.select("sku", F.col("name").alias("hub_name")), names.select(F.col("sku").alias("key"), F.col("name").alias("key_name"))
    both = both.join(hub_name, "sku", "left").join(key_name, "key", "left")
    named = F.coalesce(F.col("hub_name"), F.lit("")) != ""
    fits = F.col("match_source").isin("sku", "barcode") | ~named | (F.coalesce("key_name", F.lit("")) == "") | text.packs_agree(F.col("hub_name"), F.col("key_name"))
    both = both.withColumn("excluded", ~fits)
    newest = F.row_number().over(Window.partitionBy("sku", "store_id", "excluded").orderBy(F.desc("crawled_at"), F.desc("key"), "match_source", F.desc("seq")))
    out = both.withColumn("newest", newest).where("newest = 1")
    oos = is_oos(numbers.stock_signal(F.col("in_stock"), F.col("qty")), F.col("in_stock"), F.col("qty"))
    return out.select("sku", "store_id", "key", "cents", "qty", "match_source", "excluded", *freshness_labels(F.col("crawled_at"), as_of), oos.alias("is_oos"))


def seller_list(found: DataFrame) -> DataFrame:
    """sellers() that are not excluded, with their place in a product's list: by price, those without one last, then by store."""
    order = Window.partitionBy("sku").orderBy(F.asc_nulls_last("cents"), "store_id")
    return found.where(~F.col("excluded")).withColumn("place", F.row_number().over(order))


def addresses(products: DataFrame, own: DataFrame, newest: DataFrame, stores: DataFrame, own_domain: str | None) -> DataFrame:
    """sku, url, source of products (sku, url): the own address, the catalogue's, that of the newest reading at the first store that shows one, else a search.

    own: sku, url; newest: each pair's newest reading (sku, store_id, url); stores: store_id, domain. The search is at the own shop, or without an own domain at the
    first store that has the product. Stores come in the order of their names; empty addresses count as none.
    """
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    seen = newest.join(F.broadcast(stores), "store_id", "left").groupBy("sku").agg(  # a row a store
        F.min_by(told(F.col("url")), F.when(told(F.col("url")).isNotNull(), F.col("store_id"))).alias("read"), F.min_by("domain", "store_id").alias("domain")
    )
    mine = own.groupBy("sku").agg(F.max(told(F.col("url"))).alias("mine"))
    rows = products.select("sku", told(F.col("url")).alias("listed")).join(mine, "sku", "left").join(seen, "sku", "left")
    at = F.lit(own_domain) if own_domain else told(F.col("domain"))
    search = F.concat(F.lit("https://"), at, F.lit("/search?keyword="), F.col("sku").cast("string"))
    source = F.when(F.col("mine").isNotNull(), "own").when(F.col("listed").isNotNull(), "catalogue").when(F.col("read").isNotNull(), "reading").when(search.isNotNull(), "search")
    return rows.select("sku", F.coalesce("mine", "listed", "read", search, F.lit("")).alias("url"), source.alias("source"))


def seller_summary(found: DataFrame) -> DataFrame:
    """Counts, price range and live volume of each product's sellers()."""
    kept = ~F.col("excluded")
    price = F.when(kept & (F.col("cents") > 0), F.col("cents"))
    return found.groupBy("sku").agg(
        F.count_if(kept).alias("total"), F.count_if(kept & (F.col("data_status") == "live")).alias("live"), F.count_if(kept & (F.col("data_status") != "live")).alias("stale"), F.count_if(kept & F.col("is_oos")).alias("oos"),
        F.count_if(kept & (F.col("match_source") == "sku")).alias("via_sku"), F.count_if(kept & (F.col("match_source") == "matched")).alias("via_match"), F.count_if("excluded").alias("excluded_wrong_match"),
        F.min(price).alias("low"), F.max(price).alias("high"), F.round(F.sum(price) / F.count(price), 2).alias("mean"), F.coalesce(F.sum(F.when(kept & ~F.col("is_stale"), F.col("qty"))), F.lit(0)).alias("total_volume"),
    )


def history(snaps: DataFrame, cap: int) -> DataFrame:
    """Each product's price points by store, as a map of store to points in time; the cap drops a pair's oldest readings."""
    place = F.row_number().over(Window.partitionBy("sku", "store_id").orderBy(F.desc("crawled_at"), F.desc("seq")))
    kept = snaps.withColumn("place", place).where(F.col("place") <= cap)
    points = kept.groupBy("sku", "store_id").agg(F.array_sort(F.collect_list(F.struct("crawled_at", "seq", "cents"))).alias("points"))
    listed = F.transform("points", lambda p: F.struct(p["crawled_at"].alias("at"), p["cents"].alias("cents")))
    return points.groupBy("sku").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("store_id"), listed.alias("points"))))).alias("history"))


def chart(closes: DataFrame, stores: list[str]) -> DataFrame:
    """A product's prices by day, a column a store: the grid of a price chart. closes: day closes (sku, store_id, day, cents)."""
    return closes.groupBy("sku", "day").pivot("store_id", stores).agg(F.max("cents"))


def sparkline(closes: DataFrame) -> DataFrame:
    """Per pair: first and last close, the change in percent, and where the last stands between lowest and highest, in percent."""
    ends = closes.groupBy("sku", "store_id").agg(F.min_by("cents", "day").alias("first"), F.max_by("cents", "day").alias("last"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.round((F.col("last") - F.col("low")) * 100 / (F.col("high") - F.col("low")), 1)).otherwise(50.0)
    return ends.select("sku", "store_id", F.when(F.col("first") > 0, F.round((F.col("last") - F.col("first")) * 100 / F.col("first"), 1)).alias("change_pct"), place.alias("range_pct"))


# Looking up own rows by whatever key they have in common with a shop's rows.


def barcode_keys(value: Column, canonical: bool = True) -> Column:
    """The keys of a barcode-like value: as it stands, its leading 8 to 14 digits, and those as 14 digits; without `canonical` the first two."""
    raw = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    lead = F.nullif(F.regexp_extract(raw, _LEAD, 1), F.lit(""))
    keys = [F.nullif(raw, F.lit("")), lead, *([F.lpad(lead, 14, "0")] if canonical else [])]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def barcode_key_set(barcode: Column, sku: Column) -> Column:
    """Keys to compare: a barcode may have a suffix, a sku counts only if all of it is a barcode."""
    code, own = F.lower(F.trim(F.coalesce(barcode.cast("string"), F.lit("")))), F.trim(F.coalesce(sku.cast("string"), F.lit("")))
    keys = [F.when(text.is_barcode(code), code), text.canonical_barcode(code), F.when(text.is_barcode(own), own), F.when(text.is_barcode(own), text.canonical_barcode(own))]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def url_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:products?/|p)([0-9]+)", 1), F.lit(""))


#: How an own row was found, the strongest first.
METHODS = ("sku", "barcode", "barcode_normalized", "barcode_gtin14", "barcode_as_sku", "product_url_id", "sku_as_barcode", "sku_as_barcode_gtin14", "zid_internal_id")


def resolved(own: DataFrame, shop: DataFrame) -> DataFrame:
    """For each own row (sku, barcode, url) the shop row (row_id, sku, barcode, ...) that it is, and by which of METHODS; the others are left out.

    Each way is an equi-join on one key; of all hits of an own row the strongest way wins, and of its several rows the last (the largest row_id).
    """
    key = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    rest = [c for c in shop.columns if c not in ("row_id", "sku", "barcode")]
    hits = shop.select("row_id", *(F.col(c).alias(f"shop_{c}") for c in rest), key(F.col("sku")).alias("s"), barcode_keys(F.col("barcode")).alias("b"), key(F.col("row_id")).alias("i"))
    index = lambda kind, k: hits.select("row_id", *(f"shop_{c}" for c in rest), F.lit(kind).alias("kind"), k.alias("key"))
    indexed = index("sku", F.col("s")).unionByName(index("barcode", F.explode("b"))).unionByName(index("id", F.col("i"))).where("key IS NOT NULL")
    sku, raw = key(F.col("sku")), F.lower(F.trim(F.col("barcode")))
    lead = F.nullif(F.regexp_extract(raw, _LEAD, 1), F.lit(""))
    zid = F.when(F.substring(sku, 1, 2) == "z.", F.nullif(F.substring(sku, 3, 200), F.lit("")))
    ask = lambda kind, k, method: F.struct(F.lit(kind).alias("kind"), k.alias("key"), method.alias("place"))
    named = lambda name: F.lit(METHODS.index(name))
    by_code = F.transform(barcode_keys(F.col("barcode")), lambda k: ask("barcode", k, F.when(k == raw, named("barcode")).when(k == lead, named("barcode_normalized")).otherwise(named("barcode_gtin14"))))
    as_sku = F.transform(barcode_keys(F.col("barcode"), False), lambda k: ask("sku", k, named("barcode_as_sku")))
    as_code = F.transform(barcode_keys(sku), lambda k: ask("barcode", k, F.when(k == sku, named("sku_as_barcode")).otherwise(named("sku_as_barcode_gtin14"))))
    single = F.array(ask("sku", sku, named("sku")), ask("id", url_id(F.col("url")), named("product_url_id")), ask("id", zid, named("zid_internal_id")), ask("sku", zid, named("zid_internal_id")))
    asked = own.select("sku", F.explode(F.concat(single, by_code, as_sku, as_code)).alias("a")).select("sku", "a.*").where("key IS NOT NULL").distinct()
    found = asked.join(indexed, ["kind", "key"])
    best = F.row_number().over(Window.partitionBy("sku").orderBy("place", F.desc("row_id")))
    names = F.array(*map(F.lit, METHODS))
    return found.withColumn("best", best).where("best = 1").select("sku", "row_id", *(f"shop_{c}" for c in rest), F.element_at(names, F.col("place") + 1).alias("method"))


def price_basis(own: DataFrame, shop: DataFrame) -> DataFrame:
    """sku, price, sale_price, basis, method: an own row's shelf price from the shop (shop_price, shop_effective), else the merchant's, with VAT where it is known to be due.

    own: sku, barcode, url, price, sale_price, taxable. In whole cents; unknown taxability leaves a price as it is.
    """
    rows = own.join(resolved(own, shop), "sku", "left")
    shelf = F.coalesce(F.when(F.col("shop_effective") > 0, F.col("shop_effective")), F.col("shop_price"))
    hit = F.coalesce(shelf > 0, F.lit(False))
    gross = lambda c: F.when(F.coalesce("taxable", F.lit(False)), F.round(c * 115 / 100).cast("long")).otherwise(c)
    sale = F.when(hit, F.when((F.col("shop_price") > 0) & (shelf < F.col("shop_price")), shelf)).otherwise(F.when(F.col("sale_price") > 0, gross(F.col("sale_price"))))
    basis = F.when(hit, "storefront_inc_vat").when(F.col("taxable").isNull(), "merchant_unknown_tax").when(F.col("taxable"), "merchant_computed_inc_vat").otherwise("merchant_non_taxable")
    return rows.select("sku", F.when(hit, shelf).otherwise(gross(F.col("price"))).alias("price"), sale.alias("sale_price"), basis.alias("basis"), "method")


def mirrored(own: DataFrame, arrived: DataFrame) -> DataFrame:
    """For each arrived row (n, sku, barcode) of the own shop the own sku that it updates: by barcode, then sku, then a numeric sku as barcode; null if it is new."""
    codes = own.where("barcode IS NOT NULL").groupBy("barcode").agg(F.min("sku").alias("code_hit"))
    skus = own.select(F.col("sku").cast("string").alias("asked"), F.col("sku").alias("sku_hit"))
    rows = arrived.withColumn("asked", F.col("sku").cast("string")).join(codes, "barcode", "left").join(skus, "asked", "left")
    rows = rows.join(codes.withColumnsRenamed({"barcode": "asked", "code_hit": "numeric_hit"}), "asked", "left")
    numeric = F.when(text.is_barcode(F.col("asked")), F.col("numeric_hit"))
    return rows.select("n", F.coalesce("code_hit", "sku_hit", numeric).alias("own_sku"), F.when(F.col("code_hit").isNotNull(), "barcode").when(F.col("sku_hit").isNotNull(), "sku").when(numeric.isNotNull(), "sku_as_barcode").otherwise("new").alias("method"))


def stale_breakdown(own: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """Own rows in no live source (found: sku), by source and age of their last sync."""
    age = F.floor((F.lit(as_of).cast("long") - F.col("synced_at").cast("long")) / 86400)
    bucket = F.when(F.col("synced_at").isNull(), "never_synced").when(age < 7, "<7d").when(age < 30, "7-30d").when(age < 90, "30-90d").otherwise(">90d")
    return own.join(found.select("sku"), "sku", "left_anti").groupBy(F.coalesce("source", F.lit("(none)")).alias("source"), bucket.alias("age")).agg(F.count("*").alias("rows"))
