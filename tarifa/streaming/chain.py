"""The whole ingest of posted product lists: validate, stores, products, readings, ledger, own catalogue, kept tables, in one commit a batch.

Posts are rows (domain, store_id, store_name, platform, received_at, place, row): a product as JSON text, with the head of the list it came in; place
tells apart the rows of one time. Whatever a batch writes becomes visible at once, by its commit, so a batch that is cut off between two
tables has changed none, and a replayed one counts once. A row that can't be read costs no other row: it goes to `rejects` with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarifa.functions import text
from tarifa.functions.numbers import discount_pct, number_in
from tarifa.streaming import kept, ledger
from tarifa.streaming.commits import Commits, State, Table, first_filled, newest

POSTS = "domain string, store_id string, store_name string, platform string, received_at timestamp, place bigint, row string"
STORES, PRODUCTS, READINGS, REJECTS, OWN = "stores", "products", "readings", "rejects", "own"
#: What posted rows are trusted.
CONFIDENCE = 99
_READING = "sku string, store_id string, crawled_at timestamp, seq bigint, cents bigint, list_cents bigint, sale_cents bigint, discount_pct int, qty int, sold bigint, in_stock boolean, confidence int, product_url string"
_OBSERVATION = "store_id string, sku string, cents bigint, observed_at timestamp, id bigint"


def tables(spark: SparkSession) -> dict[str, Table]:
    """All tables of the chain."""
    readings, observations = spark.createDataFrame([], _READING), spark.createDataFrame([], _OBSERVATION)
    own = {
        STORES: Table("domain string, store_id string, store_name string, platform string, base_url string, created_at timestamp", first_filled(["domain"])),
        PRODUCTS: Table("sku string, name_ar string, name_en string, barcode string, brand string, category string, animal string, product_url string, first_seen_at timestamp", first_filled(["sku"])),
        READINGS: Table(_READING, by=("store_id",)), REJECTS: Table(f"{POSTS}, reason string"),
        OWN: Table("my_sku string, cents bigint, sale_cents bigint, qty int, in_stock boolean, last_synced_at timestamp, place bigint", newest(["my_sku"], ["last_synced_at", "place"])),
    }
    return own | ledger.ledger_tables(observations) | kept.kept_tables(readings)


def _amount(value: Column) -> Column:
    """A number, or what is left of a text with a currency; 0 where there is none."""
    return F.coalesce(F.when(~value.isin("true", "false"), number_in(value)), F.lit(0.0))


def _cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def parsed(posts: DataFrame) -> DataFrame:
    """Posts with their fields, and the reason why a row is rejected: not an object, no sku, no price.

    The price is the sale price where that is above 0 and below the price. Stock is what is said of it; where nothing is, it follows the quantity; false, 0 and empty
    say no. An address may be whole, a path, or a product's short name. An object that doesn't close is no object.
    """
    field = lambda *names: F.trim(F.coalesce(*(F.nullif(F.get_json_object("row", f"$.{n}"), F.lit("")) for n in names), F.lit("")))
    rows = posts.withColumns({"sku": field("sku"), "_price": _amount(field("price")), "_sale": _amount(field("sale_price")), "_url": field("product_url", "url", "permalink")})
    an_object = F.coalesce(F.ltrim("row").startswith("{") & F.try_parse_json("row").isNotNull(), F.lit(False))
    reason = F.when(~an_object, "not an object").when(F.col("sku") == "", "no sku").when(F.col("_price") <= 0, "no price")
    on_sale = (F.col("_sale") > 0) & (F.col("_sale") < F.col("_price"))
    said, qty = F.get_json_object("row", "$.in_stock"), _amount(field("quantity")).cast("int")
    price = F.when(on_sale, F.col("_sale")).otherwise(F.col("_price"))
    return rows.select(
        *posts.columns, reason.alias("reason"), "sku", field("name_ar").alias("name_ar"), field("name_en").alias("name_en"), field("barcode").alias("barcode"),
        _cents(price).alias("cents"), _cents(F.col("_price")).alias("list_cents"), F.when(on_sale, _cents(F.col("_sale"))).alias("sale_cents"),
        discount_pct(price, F.col("_price")).alias("discount_pct"), qty.alias("raw_qty"), F.greatest(qty, F.lit(0)).alias("qty"), _amount(field("sold_count")).cast("long").alias("sold"),
        F.coalesce(~F.lower(said).isin("false", "0", "0.0", ""), qty > 0).alias("in_stock"),
        text.absolute_url(F.col("_url"), F.col("domain")).alias("product_url"),
    )


def mirrored(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (sku, barcode, ...) with the own product (my_sku) they are of: by barcode, else by sku, else by a sku that is a barcode; others are left out.

    own: sku, barcode. A code of several own products is that of the one with the greatest sku.
    """
    by_sku = own.where("sku <> ''").select(F.trim("sku").alias("sku"), F.col("sku").alias("_by_sku")).groupBy("sku").agg(F.max("_by_sku").alias("_by_sku"))
    codes = own.where(text.is_barcode(F.trim("barcode"))).groupBy(F.trim("barcode").alias("_code")).agg(F.max("sku").alias("_own"))
    found = rows.join(by_sku, "sku", "left")
    for name, code in (("_by_code", F.col("barcode")), ("_by_sku_code", F.col("sku"))):
        keyed = found.withColumn("_code", F.when(text.is_barcode(code), code))
        found = keyed.join(codes.withColumnRenamed("_own", name), "_code", "left").drop("_code")
    return found.withColumn("my_sku", F.coalesce("_by_code", "_by_sku", "_by_sku_code")).where("my_sku IS NOT NULL").drop("_by_code", "_by_sku", "_by_sku_code")


def batch_rows(rows: DataFrame, own: DataFrame, own_domains: list[str], commits: Commits, state: State, number: int) -> tuple[dict[str, DataFrame], dict]:
    """What a batch of parsed() posts adds to each table after the commit `state`, and its marks. own: the own catalogue (sku, barcode), mirrored from own_domains."""
    order = F.struct("received_at", "place")
    heads = rows.groupBy("domain").agg(F.min_by(F.struct("store_id", "store_name", "platform", "received_at"), order).alias("h"))
    stores = heads.select("domain", "h.store_id", "h.store_name", "h.platform", F.concat(F.lit("https://"), "domain").alias("base_url"), F.col("h.received_at").alias("created_at"))
    known = commits.read(STORES, state).select("domain", F.col("store_id").alias("known_id"))  # a row a store
    canonical = stores.select("domain", F.col("store_id").alias("new_id")).join(known, "domain", "left").select("domain", F.coalesce("known_id", "new_id").alias("canonical"))
    good = rows.where("reason IS NULL").join(F.broadcast(canonical), "domain")

    first = {c: F.min_by(c, F.when(F.col(c) != "", order)).alias(c) for c in ("name_ar", "name_en", "barcode", "product_url")}
    named = good.groupBy("sku").agg(*first.values(), F.min("received_at").alias("first_seen_at"))
    name = F.coalesce("name_ar", "name_en")
    kinds = {"brand": text.brand(name), "category": text.category(name), "animal": text.animal(name)}
    products = named.withColumns({k: F.coalesce(v, F.lit("")) for k, v in kinds.items()})

    readings = good.select("sku", F.col("canonical").alias("store_id"), F.col("received_at").alias("crawled_at"), F.col("place").alias("seq"), "cents", "list_cents", "sale_cents", "discount_pct", "qty", "sold", "in_stock", F.lit(CONFIDENCE).alias("confidence"), "product_url")
    observed = readings.select("store_id", "sku", "cents", F.col("crawled_at").alias("observed_at"), F.col("seq").alias("id"))
    days, marks = ledger.ledger_rows(observed, state)
    mirror = mirrored(good.where(F.col("domain").isin(own_domains)), own)
    mirror = mirror.groupBy("my_sku").agg(F.max_by(F.struct("list_cents", "sale_cents", "raw_qty", "in_stock", "received_at", "place"), order).alias("m"))
    out = {
        STORES: stores, PRODUCTS: products, READINGS: readings, REJECTS: rows.where("reason IS NOT NULL").select(*StructType.fromDDL(POSTS).names, "reason"),
        OWN: mirror.select("my_sku", F.col("m.list_cents").alias("cents"), "m.sale_cents", F.col("m.raw_qty").alias("qty"), "m.in_stock", F.col("m.received_at").alias("last_synced_at"), "m.place"),
    }
    return out | days | kept.kept_rows(readings, commits, state, number), {**state.marks, **marks, "kept_version": kept.VERSION}


def land(posts: DataFrame, own: DataFrame, own_domains: list[str], commits: Commits, number: int) -> None:
    """Take in one batch; one that is committed already is left out."""
    state = commits.last()
    if number <= state.number:
        return
    rows = parsed(posts.repartition("received_at", "place")).persist()  # a file of many posts may be one task's; a row is read once, not once for each table
    commits.publish(number, *batch_rows(rows, own, own_domains, commits, state, number))
    rows.unpersist()


def run(stream: DataFrame, own: DataFrame, own_domains: list[str], root: str, checkpoint: str) -> StreamingQuery:
    """Take in a stream of posts to the tables under root."""
    spark = stream.sparkSession
    commits = Commits(spark, root, tables(spark))
    return stream.writeStream.foreachBatch(lambda batch, number: land(batch, own, own_domains, commits, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(commits: Commits) -> DataFrame:
    """What the sender is told: a row for each batch and store with the rows received, inserted (new skus), updated, skipped, and the first reason of each kind."""
    state = commits.last()
    good = commits.read(READINGS, state).groupBy("born", "store_id").agg(F.count("*").alias("taken"))
    born = commits.read(PRODUCTS, state).select("sku", F.col("born").alias("first"))
    new = commits.read(READINGS, state).join(born, "sku").where("born = first").groupBy("born", "store_id").agg(F.countDistinct("sku").alias("inserted"))
    stores = commits.read(STORES, state).select("domain", F.col("store_id").alias("canonical"))
    bad = commits.read(REJECTS, state).join(F.broadcast(stores), "domain").groupBy("born", F.col("canonical").alias("store_id")).agg(F.count("*").alias("skipped"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    rows = good.join(new, ["born", "store_id"], "left").join(bad, ["born", "store_id"], "full").fillna(0, ["taken", "inserted", "skipped"])
    return rows.select(F.col("born").alias("batch"), "store_id", (F.col("taken") + F.col("skipped")).alias("received"), "inserted", (F.col("taken") - F.col("inserted")).alias("updated"), "skipped", "reasons")
