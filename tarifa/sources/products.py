"""Raw product payloads of shops, as JSON texts, in one shape; and walks over their page lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.functions.numbers import discount_pct
from tarifa.sources.landed import enveloped

# Names under which payloads have things, and words that mean in or out of stock.
CODE_FIELDS, ROOT_CODE_FIELDS = ("barcode", "gtin", "mpn"), ("gtin", "mpn", "barcode", "ean", "upc")
SOLD_FIELDS = ("sold_quantity", "sales_count", "sold_count", "sold_products_count")
URL_FIELDS = ("url", "html_url", "permalink", "product_url", "link", "page_url", "product_page_url")
YES, NO = ("true", "yes", "available", "in_stock"), ("false", "no", "unavailable", "out_of_stock", "sold_out")
ACTIVE, INACTIVE = ("sale", "active", "available", "published", "visible"), ("draft", "hidden", "deleted", "out", "out_of_stock", "sold_out")
PLENTY = 999
_VARIANT = "struct<barcode:string,gtin:string,mpn:string,price:string,sale_price:string,regular_price:string,in_stock:string>"


def _first(*values: Column) -> Column:
    """The first value that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def amount(value: Column) -> Column:
    """A price that is a number, a text or {amount}; 0 where there is none."""
    flat = F.when(F.ltrim(value).startswith("{"), F.get_json_object(value, "$.amount")).otherwise(value)
    return F.coalesce(F.regexp_replace(flat, r"[^0-9.]", "").try_cast("double"), F.lit(0.0))


def coerce_num(value: Column, default: float = 0.0) -> Column:
    """A number out of a text with currency and separators; true and false and texts without digits give the default."""
    plain = F.when(F.lower(value).isin("true", "false"), None).otherwise(F.regexp_replace(value, r"[^0-9.\-]", ""))
    return F.coalesce(plain.try_cast("double"), F.lit(default))


def _code(value: Column) -> Column:
    plain = F.trim(value)
    return F.when(plain.rlike("^[0-9]{8,14}$"), plain)


def variant_code(variants: Column) -> Column:
    """The first variant with a valid code, and that code."""
    coded = F.transform(variants, lambda v: F.struct(F.coalesce(*(_code(v[f]) for f in CODE_FIELDS)).alias("code"), v.alias("v")))
    return F.get(F.filter(coded, lambda c: c["code"].isNotNull()), F.lit(0))


def listed_code(variants: Column, price: Column) -> Column:
    """The code of the variant that a page shows: the one at its price, else the first in stock, else the first; null without a valid one."""
    coded = F.filter(F.transform(variants, lambda v: F.struct(F.coalesce(*(_code(v[f]) for f in CODE_FIELDS)).alias("code"), amount(v["price"]).alias("price"), F.coalesce(F.lower(v["in_stock"]) == "true", F.lit(False)).alias("there"))), lambda c: c["code"].isNotNull())
    at_price, there = F.filter(coded, lambda c: F.abs(c["price"] - price) < 0.01), F.filter(coded, lambda c: c["there"])
    return F.coalesce(*(F.get(found, F.lit(0))["code"] for found in (at_price, there, coded)))


def page_code(html: Column) -> Column:
    """The code on a page: a labelled one first; one in running text only if it is the only valid one."""
    labelled = F.regexp_extract_all(html, F.lit(r"(?i)(?:barcode|gtin|ean|upc|باركود)[^0-9]{0,40}([0-9]{8,14})(?![0-9])"), F.lit(1))
    loose = F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit("(?<![0-9])([0-9]{8}|[0-9]{12,14})(?![0-9])"), F.lit(1)), text.valid_gtin))
    return F.coalesce(F.get(F.filter(labelled, text.valid_gtin), F.lit(0)), F.when(F.size(loose) == 1, F.get(loose, F.lit(0))))


def category_names(categories: Column) -> Column:
    """The names of a payload's category tags in one text: plain, {name}, or {name: {ar, en}}."""
    tags = F.from_json(categories, "array<string>")
    name = lambda t: F.when(F.ltrim(t).startswith("{"), F.get_json_object(t, "$.name")).otherwise(t)
    both = lambda n: F.when(F.ltrim(n).startswith("{"), F.concat_ws(" ", F.get_json_object(n, "$.ar"), F.get_json_object(n, "$.en"))).otherwise(n)
    return F.array_join(F.filter(F.transform(tags, lambda t: both(name(t))), lambda n: n != ""), " ")


def food_form_hybrid(parent: Column, name: Column, tags: Column) -> Column:
    """The form that the name states; the shop's tags only speak where the name doesn't and isn't a bundle's."""
    by_name = text.food_form(parent, F.coalesce(name, F.lit("")))
    bundle = text.has_any(F.lower(F.coalesce(name, F.lit(""))), text.BUNDLES)
    return F.coalesce(by_name, F.when(~bundle, text.food_form(parent, F.concat_ws(" ", name, tags))))


def weight_kg(name: Column) -> Column:
    """Kilograms in a name, else grams by a thousand, else 0."""
    of = lambda unit: F.regexp_extract(F.lower(name), rf"([0-9]+(?:\.[0-9]+)?)\s*(?:{unit})", 1).try_cast("double")
    return F.coalesce(of("kg|كجم|كغ"), of("g|gm|جم|جرام") / 1000, F.lit(0.0))


def normalised(payloads: DataFrame) -> DataFrame:
    """sku, name, barcode, price, original_price, sale_price, discount_pct, qty, sold, sold_capped, in_stock, image_url, product_url, tags of payloads (payload).

    Where the barcode is a variant's, so is the price. A sale price counts if it is below the price; the original is the largest of all. No JSON, no row.
    """
    get = lambda *names: _first(*(F.get_json_object("payload", f"$.{n}") for n in names))
    rows = payloads.where(F.ltrim("payload").startswith("{")).select("payload", variant_code(F.from_json(F.get_json_object("payload", "$.skus"), f"array<{_VARIANT}>")).alias("picked"))
    by_variant = amount(F.col("picked.v.price")) > 0
    of = lambda field: F.when(by_variant, amount(F.col(f"picked.v.{field}"))).otherwise(amount(get(field)))
    sale_root = F.coalesce(*(F.nullif(amount(get(n)), F.lit(0.0)) for n in ("sale_price", "promotion.price", "special_price")), F.lit(0.0))
    rows = rows.withColumns({"base": of("price"), "sale": F.when(by_variant, amount(F.col("picked.v.sale_price"))).otherwise(sale_root), "regular": of("regular_price")})
    price = F.when((F.col("sale") > 0) & (F.col("sale") < F.col("base")), F.col("sale")).otherwise(F.col("base"))
    rows = rows.withColumn("price", price).withColumn("original_price", F.greatest("price", "regular", "base"))
    unlimited = F.lower(F.coalesce(get("unlimited_quantity"), get("is_infinite"), F.lit("false"))) == "true"
    qty = F.when(unlimited, F.lit(PLENTY)).otherwise(F.greatest(F.coalesce(get("quantity", "stock_quantity", "qty").try_cast("double").cast("int"), F.lit(0)), F.lit(0)))
    said, status = F.lower(get("is_available", "availability")), F.lower(F.coalesce(get("status"), F.lit("")))
    in_stock = F.when(said.isin(*YES), True).when(said.isin(*NO), False).when(status.isin(*ACTIVE), True).when(status.isin(*INACTIVE), False).otherwise(F.col("qty") > 0)
    sold = text.counter(F.coalesce(get(*SOLD_FIELDS), F.lit("")))
    name = get("name", "title")
    shown = F.when(F.ltrim(name).startswith("{"), _first(F.get_json_object(name, "$.ar"), F.get_json_object(name, "$.en"))).otherwise(name)
    code = F.coalesce(F.col("picked.code"), *(_code(F.get_json_object("payload", f"$.{f}")) for f in ROOT_CODE_FIELDS), F.lit(""))
    image = get("images[0].url", "images[0].src", "images[0].image.full_size", "images[0].image.original", "image.url", "image.src")
    return rows.withColumn("qty", qty).select(
        F.coalesce(get("sku", "mpn"), F.concat(F.lit("S-"), get("id"))).alias("sku"), shown.alias("name"), code.alias("barcode"), "price", "original_price",
        F.when((F.col("sale") > 0) & (F.col("sale") < F.col("original_price")), F.col("sale")).alias("sale_price"), discount_pct(F.col("price"), F.col("original_price")).alias("discount_pct"), "qty",
        sold["value"].alias("sold"), sold["capped"].alias("sold_capped"), in_stock.alias("in_stock"), F.coalesce(image, F.lit("")).alias("image_url"), F.coalesce(get("urls.customer", "urls.store", "urls.url", *URL_FIELDS), F.lit("")).alias("product_url"),
        F.coalesce(category_names(F.get_json_object("payload", "$.categories")), F.lit("")).alias("tags"),
    )


def largest_payload(captured: DataFrame) -> DataFrame:
    """Of the responses that a page made (page_id, payload) the one with the most products; none for a page without any."""
    sized = captured.withColumn("n", F.coalesce(F.size(enveloped(F.col("payload"))), F.lit(0))).where("n > 0")
    return sized.groupBy("page_id").agg(F.max_by("payload", F.struct("n", "payload")).alias("payload"), F.max("n").alias("products"))


def walked(pages: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Items and outcome of walks over page lists: pages (walk, page, status, payload), of which page 1 is always taken.

    Items: walk, page, id, name, price, one row an id. Outcome: walk, pages, stop: the first reason that holds on the first page with any: http_<status>, page_error,
    empty_page, duplicate_page (no new id), no_next, pages_count_reached, results_total_reached, else max_pages or exhausted. A short page is no reason.
    """
    body = lambda *names: F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))
    meta = pages.where(F.col("page") <= most).select("walk", "page", "status", "payload", enveloped(F.col("payload")).alias("items"), body("pagination.pages_count", "pages_count", "last_page", "total_pages").try_cast("int").alias("of"), body("total", "pagination.total", "results").try_cast("int").alias("results"), body("pagination.next", "next").alias("next"))
    listed = meta.select("walk", "page", F.explode("items").alias("p")).select("walk", "page", "p.*").where("id IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("walk", "id").orderBy("page", "name", "price"))
    fresh = listed.withColumn("first", first).where("first = 1").drop("first")
    counts = fresh.groupBy("walk", "page").agg(F.count("*").alias("fresh"))
    so_far = Window.partitionBy("walk").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)  # a row a page
    judged = meta.join(counts, ["walk", "page"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0))).withColumn("sum", F.sum("fresh").over(so_far))
    judged = judged.withColumns({"of": F.last("of", ignorenulls=True).over(so_far), "results": F.last("results", ignorenulls=True).over(so_far)})
    ended = (F.col("page") > 1)
    reason = (
        F.when(ended & (F.col("status") != 200), F.concat(F.lit("http_"), F.col("status").cast("string"))).when(ended & F.col("items").isNull(), "page_error").when(ended & (F.size("items") == 0), "empty_page").when(ended & (F.col("fresh") == 0), "duplicate_page")
        .when(ended & F.lower("next").isin("false", "null", ""), "no_next").when(ended & (F.col("page") >= F.col("of")), "pages_count_reached").when(ended & (F.col("sum") >= F.col("results")), "results_total_reached")
    )
    judged = judged.withColumn("reason", reason)
    outcome = judged.groupBy("walk").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("page"))).alias("stop"), F.min(F.when(F.col("reason").isNotNull(), F.col("page"))).alias("at"), F.max("page").alias("last"))
    outcome = outcome.select("walk", F.coalesce("at", "last").alias("pages"), F.coalesce("stop", F.when(F.col("last") >= most, "max_pages").otherwise("exhausted")).alias("stop"))
    kept = fresh.join(outcome, "walk").where((F.col("page") < F.col("pages")) | ((F.col("page") == F.col("pages")) & ~F.col("stop").rlike("^(?:http_|page_error|empty_page)")))
    return kept.select("walk", "page", "id", "name", "price"), outcome


def imported_products(rows: DataFrame) -> DataFrame:
    """Own products of an uploaded sheet: sku, name_ar and price must be columns; rows without a sku or a positive price are left out, the last row of a sku stays."""
    lacking = {"sku", "name_ar", "price"} - set(rows.columns)
    if lacking:
        raise ValueError(f"missing columns: {', '.join(sorted(lacking))}")
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[^0-9.\-]", "").try_cast("double")
    clean = rows.withColumn("sku", F.nullif(F.trim(F.col("sku").cast("string")), F.lit(""))).withColumn("price", number("price")).withColumn("row", F.monotonically_increasing_id())
    clean = clean.where("sku IS NOT NULL AND price > 0")
    rest = [c for c in rows.columns if c != "sku"]
    return clean.groupBy("sku").agg(F.max_by(F.struct(*rest), "row").alias("r")).select("sku", *(f"r.{c}" for c in rest))


def baseline(spark: SparkSession, folder: str, sheets: dict[str, str]) -> dict[str, DataFrame]:
    """The sheets of an imported workbook, each a CSV file of the folder under a schema; rows that are empty throughout are left out."""
    read = {name: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv") for name, schema in sheets.items()}
    return {name: rows.where(reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c in rows.columns))) for name, rows in read.items()}


def demo(spark: SparkSession, products: int, stores: int, days: int, seed: int = 42) -> DataFrame:
    """Readings to try things on: each product at most stores once a day, prices on a walk around a base, the same for the same seed."""
    dice = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1000))
    grid = spark.range(products * stores * days).select(F.expr(f"id % {products}").alias("sku"), F.expr(f"concat('S', id div {products} % {stores})").alias("store_id"), F.expr(f"cast(id div {products * stores} AS int)").alias("day"))
    carried = grid.where(dice("sku", "store_id") < 700)
    cents = (1_000 + dice("sku") * 20) * (90 + dice("sku", "store_id", F.expr("day div 7")) / 50) / 100
    qty = dice("sku", "store_id", "day", F.lit("qty")) / 10
    return carried.select("sku", "store_id", F.expr("timestampadd(DAY, day, TIMESTAMP'2024-01-01')").alias("crawled_at"), F.round(cents).cast("long").alias("cents"), qty.cast("int").alias("qty"), (qty >= 5).alias("in_stock"), F.lit(95).alias("confidence"))
