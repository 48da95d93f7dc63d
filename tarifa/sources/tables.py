"""The logical tables of the engine, read from the driver's star schema.

Prices are whole cents: sums of them are exact in any order. A snapshot's seq is the source row's key: it orders the readings of a
(sku, store) pair that are of one time, so that "latest" and "previous" have one answer. Only `sold`, a running sum, needs a
window; a plan that doesn't read it scans, filters and shuffles once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OWN_STORE = "EUROPE"
#: Suppliers up to which their stores are sent to every task; beyond, lineitem is shuffled to meet them.
BROADCAST_SUPPLIERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, store_id, crawled_at, seq, cents, list_cents, discount_pct, qty, sold, in_stock, confidence."""
    suppliers = table(spark, sf_dir, "supplier")
    places = suppliers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("store_id"))
    if suppliers.count() <= BROADCAST_SUPPLIERS:
        places = F.broadcast(places)
    lines = table(spark, sf_dir, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    pct = F.round(F.col("l_discount") * 100).cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    in_time = Window.partitionBy("l_partkey", "store_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return lines.select(
        F.col("l_partkey").alias("sku"), "store_id", F.col("l_shipdate").alias("crawled_at"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"),
        cents.alias("cents"), F.round(cents * 100 / (100 - pct)).cast("long").alias("list_cents"), pct.alias("discount_pct"),
        F.col("l_quantity").cast("int").alias("qty"), F.sum(F.col("l_quantity").cast("long")).over(in_time.rowsBetween(Window.unboundedPreceding, 0)).alias("sold"),
        (F.col("l_linestatus") == "O").alias("in_stock"), F.when(F.col("l_returnflag") == "A", 95).when(F.col("l_returnflag") == "N", 88).otherwise(75).alias("confidence"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, name, brand, category, weight."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("weight"))


def own_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, cents: every fourth product is in the own catalogue."""
    own = table(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    return own.select(F.col("p_partkey").alias("sku"), F.round(F.col("p_retailprice") * 100 * 35).cast("long").alias("cents"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, is_own, measurable: whether the store shows a counter of units sold."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("store_id"), (F.col("r_name") == OWN_STORE).alias("is_own"), (F.col("r_regionkey") % 2 == 0).alias("measurable"))


#: Names as catalogues have them; a product's is chosen by its sku.
NAMES = (
    "Royal Canin Cat Dry Food 400g", "Royal Canin Cat Dry Food 24 x 400g", "Pedigree Dog Wet Food Pouch 100 g", "Pedigree Dog Wet Food Pouch 12 Pieces", "Dog Dental Chew Sticks 5 kg", "Cat Litter Clumping 10 L",
    "Stainless Bowl for Dogs", "Kong Toy Large", "Bird Food Mix 1.5 kg", "Tetra Fish Food 100 ml", "Cat Shampoo 250 ml", "Hamster Vet Drops", "Dog Food Bundle Pack", "Whiskas Cat Food Wet and Dry 85 g", "Acana Dog Food Carton 24", "Rabbit Hay 2 lb",
)


def name_at(place: str):
    """The name at a place (an SQL expression), counted round."""
    return F.element_at(F.array(*map(F.lit, NAMES)), F.expr(f"cast(pmod({place}, {len(NAMES)}) AS int) + 1"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, name, brand, category, first_seen_at: products with names as shops write them."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("sku"), name_at("p_partkey div 4").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.expr("timestampadd(DAY, -cast(p_partkey % 400 AS int), TIMESTAMP'2001-11-04')").alias("first_seen_at"))


def own_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own catalogue in full: sku, barcode, name, cents, sale_cents, qty, in_stock, present, synced_at, url, taxable, source, code_sku.

    Every fourth product, and for every hundredth one an own product that no catalogue has. code_sku: a barcode that shops use as their sku.
    """
    part = table(spark, sf_dir, "part")
    known, unknown = part.where("p_partkey % 4 = 0"), part.where("p_partkey % 100 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000)
    code = "cast(5200000000000 + p_partkey AS string)"
    return known.unionByName(unknown).withColumn("cents", F.round(F.col("p_retailprice") * 100 * 35).cast("long")).select(
        F.col("p_partkey").alias("sku"), F.expr(f"CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 24 = 0 THEN concat({code}, 'carton') ELSE {code} END").alias("barcode"), name_at("p_partkey div 4").alias("name"), "cents",
        F.expr("CASE WHEN p_partkey % 12 = 0 THEN cents * 8 div 10 WHEN p_partkey % 20 = 4 THEN 0 END").alias("sale_cents"), F.expr("CASE WHEN p_partkey % 28 <> 0 THEN p_size END").alias("qty"),
        F.expr("CASE WHEN p_partkey % 28 <> 0 THEN p_size > 5 END").alias("in_stock"), F.expr("CASE WHEN p_partkey % 40 = 0 THEN false WHEN p_partkey % 8 = 0 THEN true END").alias("present"),
        F.expr("CASE WHEN p_partkey % 100 <> 0 THEN timestampadd(DAY, -cast(p_partkey % 120 AS int), TIMESTAMP'2001-11-04') END").alias("synced_at"),
        F.expr("CASE WHEN p_partkey % 16 = 0 THEN '' ELSE concat('https://own.example/products/', p_partkey + 7000000) END").alias("url"), F.expr("CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("taxable"),
        F.expr("CASE WHEN p_partkey % 8 = 0 THEN 'merchant' ELSE 'storefront' END").alias("source"), F.expr("CASE WHEN p_partkey % 12 = 0 THEN p_partkey + 2 END").alias("code_sku"),
    )


def store_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, number, is_own, platform, domain: a row a store."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("store_id"), F.col("r_regionkey").alias("number"), (F.col("r_name") == OWN_STORE).alias("is_own"), F.expr("CASE WHEN r_regionkey % 2 = 0 THEN 'salla' ELSE 'zid' END").alias("platform"),
        F.expr("concat(CASE WHEN r_regionkey % 2 = 0 THEN 'https://www.' ELSE '' END, replace(lower(r_name), ' ', '-'), '.example/')").alias("domain"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """my_sku, rival_sku, store_id, confidence, method, confirmed: matches of own products at competitors."""
    pairs = own_catalogue(spark, sf_dir).select("sku").crossJoin(F.broadcast(store_meta(spark, sf_dir).where("NOT is_own").select("store_id", "number")))  # a row a store
    pick = "cast((sku div 4 + number) % 6 AS int) + 1"
    return pairs.where("(sku div 4 + number) % 3 <> 0").select(
        F.col("sku").alias("my_sku"), F.expr("CASE WHEN sku % 8 = 0 THEN sku + 1 ELSE sku END").alias("rival_sku"), "store_id", F.expr(f"element_at(array(99, 95, 85, 80, 70, 60), {pick})").alias("confidence"),
        F.expr(f"element_at(array('barcode', 'sku', 'name', 'name', 'name', 'name'), {pick})").alias("method"), F.expr("sku % 52 = 0").alias("confirmed"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, created_at, excluded, items: own orders with their lines as an array."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))).alias("items")
    )
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("excluded"))
    return heads.join(items, F.col("order_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, sku, cents, observed_at, id: the stream of price readings."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("store_id"), F.get_json_object("props", "$.k").cast("int").alias("sku"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("ts").alias("observed_at"), F.col("event_id").alias("id")
    )
