"""Queries on names, codes, money texts and payloads, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifa.functions import numbers, text
from tarifa.operators import matching
from tarifa.plans.catalogue import CATALOGUE
from tarifa.plans.oracles import LATEST, MATCHED, OWN, PRODUCTS, RECENT, RIVALS, SNAPS, _catalogues, query
from tarifa.sources import landed, products, raw_orders, tables
from tarifa.streaming import ingest

CODES = "CASE sku % 6 WHEN 0 THEN cast(5200000000000 + sku * 7 AS string) WHEN 1 THEN cast(52000000 + sku AS string) WHEN 2 THEN cast(52742000000 + sku AS string) WHEN 3 THEN concat('0', 52742000000 + sku) WHEN 4 THEN concat(52000000 + sku, '-box') END"


@query("""SELECT sku, coalesce(regexp_full_match(code, '[0-9]{8,14}'), false) AS is_barcode, coalesce(regexp_full_match(code, '[0-9]{8}|[0-9]{12,14}') AND list_sum([substr(lpad(code, 14, '0'), i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END FOR i IN range(1, 15)]) % 10 = 0, false) AS valid_gtin
  FROM (SELECT p_partkey AS sku, CASE p_partkey % 6 WHEN 0 THEN (5200000000000 + p_partkey * 7)::VARCHAR WHEN 1 THEN (52000000 + p_partkey)::VARCHAR WHEN 2 THEN (52742000000 + p_partkey)::VARCHAR WHEN 3 THEN '0' || (52742000000 + p_partkey) WHEN 4 THEN NULL ELSE NULL END AS code FROM part)""")
def barcode_checks(t):
    code = F.when(F.col("sku") % 6 < 4, F.expr(CODES))
    return t.catalogue.select("sku", text.is_barcode(code).alias("is_barcode"), text.valid_gtin(code).alias("valid_gtin"))


FACTS = """facts AS (SELECT [1, 24, 1, 12, 1, 1, 1, 1, 1, 1, 1, 1, -1, 1, 24, 1] AS pack, [400, 400, 100, NULL, 5000, 10000, NULL, NULL, 1500, 100, 250, NULL, NULL, 85, NULL, 2000] AS grams,
  [NULL, 24, NULL, 12, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 24, NULL] AS stated, [0.4, 0.4, 0.1, 0, 5, 0, 0, 0, 1.5, 0, 0, 0, 0, 0.085, 0, 0] AS kg),
pairs AS (SELECT p_partkey AS sku, (p_partkey // 4) % 16 AS i, (p_partkey // 64 + p_partkey) % 16 AS j, p_retailprice * 35 AS a, p_retailprice * (1 + p_partkey % 11) * 6 AS b FROM part)"""


@query(FACTS, """SELECT sku, pack[i + 1] AS pack, stated[j + 1] AS stated, pack[i + 1] = pack[j + 1] AS packs_agree, NOT coalesce(greatest(grams[i + 1], grams[j + 1])::DOUBLE / least(grams[i + 1], grams[j + 1]) > 1.1::DOUBLE, false) AS weights_agree, kg[i + 1]::DOUBLE AS kg, greatest(a, b) / least(a, b) < 6 OR coalesce(stated[i + 1] = stated[j + 1], false) OR (i IN (0, 1) AND j IN (0, 1) AND i <> j) AS sane FROM pairs, facts""")
def name_guards(t):
    a, b = F.col("name"), F.col("other")
    rows = tables.table(t.spark, t.sf_dir, "part").select(F.col("p_partkey").alias("sku"), tables.name_at("p_partkey div 4").alias("name"), tables.name_at("p_partkey div 64 + p_partkey").alias("other"), F.expr("p_retailprice * 35").alias("a"), F.expr("p_retailprice * (1 + p_partkey % 11) * 6").alias("b"))
    return rows.select("sku", text.pack_quantity(a).alias("pack"), text.stated_pack(b).alias("stated"), text.packs_agree(a, b).alias("packs_agree"), text.weights_agree(text.weight_grams(a), text.weight_grams(b), 1.10).alias("weights_agree"), products.weight_kg(a).alias("kg"), matching.price_sane(F.col("a"), F.col("b"), a, b).alias("sane"))


MONEY = ("1,234.50 SAR", "SAR 99", "", "n/a", "1000+", "more than 500", "0", "-5.5")


@query("""money(k, number, first, counted, capped, coerced) AS (VALUES (0, 1234.5, 1234.5, 1234, false, 1234.5), (1, 99, 99, 99, false, 99), (2, NULL, NULL, 0, false, 0), (3, NULL, NULL, 0, false, 0), (4, 1000, 1000, 1000, true, 1000), (5, 500, 500, 500, true, 500), (6, 0, 0, 0, false, 0), (7, -5.5, 5.5, 5, false, -5.5))""",
       """SELECT p_partkey AS sku, number::DOUBLE AS number, "first"::DOUBLE AS "first", counted, capped, coerced::DOUBLE AS coerced FROM part JOIN money ON k = p_partkey % 8""".replace('"first"::DOUBLE', 'money."first"::DOUBLE'))
def money_texts(t):
    raw = F.element_at(F.array(*map(F.lit, MONEY)), (F.col("sku") % len(MONEY)).cast("int") + 1)
    count = text.counter(raw)
    return t.catalogue.select("sku", numbers.number_in(raw).alias("number"), text.price_in(raw).alias("first"), count["value"].alias("counted"), count["capped"].alias("capped"), products.coerce_num(raw).alias("coerced"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o > p AND p > 0 THEN round((1 - p / o) * 100)::INT ELSE 0 END AS discount_pct, CASE WHEN l_returnflag = 'A' THEN round(p * 1.15::DOUBLE, 2) ELSE p END AS shelf
  FROM (SELECT *, l_extendedprice AS o, round(l_extendedprice * (1 - l_discount)) AS p FROM lineitem)""")
def discounts_and_vat(t):
    rows = tables.table(t.spark, t.sf_dir, "lineitem").withColumn("o", F.col("l_extendedprice")).withColumn("p", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    taxable = F.expr("CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.discount_pct(F.col("p"), F.col("o")).alias("discount_pct"), numbers.with_vat(F.col("p"), taxable).alias("shelf"))


@query("""lines AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 5 <> 0) AS n_items, sum(l_quantity::INT) FILTER (l_linenumber % 5 <> 0) AS units, sum(CASE WHEN l_linenumber % 2 = 1 THEN round(l_extendedprice * 100) ELSE round(l_extendedprice * l_quantity::INT * 100) END::BIGINT) FILTER (l_linenumber % 5 <> 0) AS cents FROM lineitem GROUP BY l_orderkey)""",
       """SELECT (o_orderkey + 1)::VARCHAR AS order_id, CASE o_orderstatus WHEN 'P' THEN 'payment_failed' ELSE 'delivered' END AS status, o_orderstatus = 'P' AS excluded, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 3 HOURS ELSE o_orderdate END AS created_at, round(o_totalprice, 2) AS total, coalesce(units, 0)::BIGINT AS units, coalesce(n_items, 0) AS n_items, coalesce(cents, 0)::BIGINT AS line_cents
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey""")
def order_payloads(t):
    line = F.struct(F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").cast("int").alias("quantity"), F.struct(F.col("l_extendedprice").alias("amount")).alias("price"), F.expr("CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END").alias("total"), F.expr("CASE WHEN l_linenumber % 5 = 0 THEN l_orderkey + 1 END").alias("parent_id"))
    items = tables.table(t.spark, t.sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("products"))
    heads = tables.table(t.spark, t.sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    at = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    payload = F.to_json(F.struct((F.col("o_orderkey") + 1).alias("id"), F.struct(F.expr("CASE o_orderstatus WHEN 'P' THEN 'Payment Failed' ELSE 'delivered' END").alias("code")).alias("order_status"), F.struct(F.format_string("%.2f SAR", "o_totalprice").alias("value")).alias("order_total"), at.alias("created_at"), "products"))
    rows = raw_orders.normalised(heads.select(payload.alias("payload")))
    cents = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.round(i["line_total"] * 100).cast("long"))
    return rows.select("order_id", "status", "excluded", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.round("total", 2).alias("total"), F.col("units").cast("long").alias("units"), F.size("items").cast("long").alias("n_items"), cents.alias("line_cents"))


@query(CATALOGUE, """shaped AS (SELECT p_partkey AS sku, name, round(p_retailprice, 2) AS base, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice / 2, 2) END AS sale, p_size AS qty, p_partkey % 2 = 0 AS by_variant, (5200000000000 + p_partkey)::VARCHAR AS code FROM part JOIN catalogue ON sku = p_partkey)""",
"""SELECT sku::VARCHAR AS sku, name, code AS barcode, coalesce(sale, base) AS price, base AS original_price, sale AS sale_price, CASE WHEN sale < base THEN round((1 - sale / base) * 100)::INT ELSE 0 END AS discount_pct, CASE WHEN sku % 7 = 0 THEN 999 ELSE qty END AS qty,
  CASE sku % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE sku % 7 = 0 OR qty > 0 END AS in_stock FROM shaped""")  # fmt: skip
def product_payloads(t):
    part = tables.table(t.spark, t.sf_dir, "part").withColumn("base", F.round("p_retailprice", 2)).withColumn("sale", F.when(F.col("p_partkey") % 3 == 0, F.round(F.col("p_retailprice") / 2, 2)))
    code, by_variant = F.expr("cast(5200000000000 + p_partkey AS string)"), F.col("p_partkey") % 2 == 0
    prices = F.struct(F.col("base").alias("price"), F.col("sale").alias("sale_price"), code.alias("gtin"))
    variants = F.array(F.struct(F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("sale_price"), F.lit("12").alias("gtin")), prices)
    payload = F.to_json(F.struct(
        F.col("p_partkey").alias("sku"), F.struct(tables.name_at("p_partkey div 4").alias("ar")).alias("name"), F.when(by_variant, variants).alias("skus"), F.when(~by_variant, code).alias("ean"), F.when(~by_variant, F.struct(F.col("base").alias("amount"))).alias("price"), F.when(~by_variant, F.col("sale")).alias("special_price"),
        F.col("p_size").cast("string").alias("quantity"), (F.col("p_partkey") % 7 == 0).alias("is_infinite"), F.expr("CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'sold_out' END").alias("availability"), F.expr("CASE p_partkey % 5 WHEN 2 THEN 'active' WHEN 3 THEN 'hidden' END").alias("status"),
    ))
    found = products.normalised(part.select(payload.alias("payload")))
    return found.select("sku", "name", "barcode", "price", "original_price", "sale_price", "discount_pct", "qty", "in_stock")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, round(p_retailprice, 2) AS price FROM part")
def landed_envelopes(t):
    part = tables.table(t.spark, t.sf_dir, "part")
    item = F.to_json(F.array(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.format_string("%.2f SAR", "p_retailprice").alias("price"))))
    place = F.element_at(F.array(*map(F.lit, ("data", "products", "results", "items"))), (F.col("p_partkey") % 4).cast("int") + 1)
    payload = F.when(F.col("p_partkey") % 9 == 0, item).otherwise(F.concat(F.lit('{"'), place, F.lit('": '), item, F.lit("}")))
    return landed.catalogue(part.select(payload.alias("payload"), F.lit(1).alias("page")).unionByName(part.where("p_partkey % 6 = 0").select(F.replace(payload, F.lit(" SAR"), F.lit("9")).alias("payload"), F.lit(0).alias("page")))).select("id", "name", "price")


@query(SNAPS, RECENT, LATEST, OWN, PRODUCTS, RIVALS, MATCHED.replace("greatest(my_cents, rival_cents)::DOUBLE / least(my_cents, rival_cents) < 6.0::DOUBLE", "(rival_sku % 16 = 4 OR greatest(my_cents, rival_cents)::DOUBLE / least(my_cents, rival_cents) < 6.0::DOUBLE) AND my_sku % 20 <> 0").replace("ON my_sku = rival_sku WHERE my_sku NOT IN (SELECT my_sku FROM level1)", "ON my_sku = rival_sku WHERE my_sku NOT IN (SELECT my_sku FROM level1) AND my_sku % 20 <> 0"), "SELECT my_sku, rival_sku, store_id, CASE WHEN rival_sku % 16 = 4 THEN 100 ELSE confidence END AS confidence, method FROM matched")
def matches_with_rulings(t):
    own, rivals = _catalogues(t)
    no, yes = t.own_products.where("sku % 20 = 0"), t.own_products.where("sku % 16 = 4")
    pairs = matching.matches(own, rivals, no.select(F.col("sku").alias("my_sku"), F.col("sku").alias("rival_sku")), yes.select(F.col("sku").alias("rival_sku")))
    return pairs.select("my_sku", "rival_sku", "store_id", "confidence", "method")


@query("""SELECT p_partkey AS sku, CASE WHEN p_partkey % 3 = 0 THEN coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, 'new') ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN '' END END AS brand FROM part""".replace("WHEN p_partkey % 4 = 1 THEN ''", ""))
def dimension_filled(t):
    old = t.products.select("sku", F.when(F.col("sku") % 2 == 0, F.col("brand")).when(F.col("sku") % 4 == 1, "").alias("brand"))
    return ingest.fill_empty(old, t.products.where("sku % 3 = 0").select("sku", F.lit("new").alias("brand")), ["sku"])


@query(SNAPS, """SELECT sku, store_id, max(crawled_at) AS crawled_at, arg_max(cents, (crawled_at, late)) AS cents FROM (SELECT sku, store_id, max(crawled_at) AS crawled_at, arg_max(cents, (crawled_at, seq)) AS cents, late FROM (SELECT *, crawled_at >= TIMESTAMP '2000-01-01' AS late FROM snaps) GROUP BY sku, store_id, late) GROUP BY sku, store_id""")
def newest_upserted(t):
    from tarifa.operators import rollups

    rows = t.snapshots.drop("sold")
    newest = lambda where: rollups.latest(rows.where(where)).select("sku", "store_id", "crawled_at", "cents")
    return ingest.upsert(newest("crawled_at < '2000-01-01'"), newest("crawled_at >= '2000-01-01'"), ["sku", "store_id"], "crawled_at")


@query("""SELECT p_partkey AS sku, (p_partkey // 4) % 16 IN (1, 3, 12, 14) AS has_pack, p_partkey % 4 IN (1, 2) AS is_bundle_sku FROM part""")
def pack_indicators(t):
    sku = F.expr("CASE sku % 4 WHEN 0 THEN concat('A', sku) WHEN 1 THEN concat('A', sku, '-BOX') WHEN 2 THEN concat(sku, 'multi') END")
    return t.catalogue.select("sku", text.has_pack(F.col("name")).alias("has_pack"), text.is_bundle_sku(sku).alias("is_bundle_sku"))


CODED = """
coded_own AS (
  SELECT CASE WHEN k % 5 = 2 THEN (52742000000 + k)::VARCHAR ELSE 'P' || k END AS sku, (k // 4) % 16 AS i, round(p_retailprice * 100 * 35)::BIGINT AS cents,
    CASE WHEN k % 40 = 4 THEN '00000000' WHEN k % 5 = 0 THEN '0' || (52742000000 + k) WHEN k % 5 = 1 THEN (52742000000 + k) || 'carton' WHEN k % 5 = 3 THEN (52742000000 + k)::VARCHAR END AS code
  FROM (SELECT *, p_partkey AS k FROM part WHERE p_partkey % 4 = 0)),
coded_rivals AS (
  SELECT CASE WHEN (k + n) % 4 = 1 THEN (52742000000 + k)::VARCHAR WHEN (k + n) % 4 = 3 THEN (52742000000 + k) || '-x' ELSE 'R' || k END AS sku, store_id, (k // 4 + k // 64) % 16 AS j, cents,
    CASE WHEN (k + n) % 8 = 0 THEN '00000000' WHEN (k + n) % 4 = 0 THEN (52742000000 + k)::VARCHAR WHEN (k + n) % 4 = 2 THEN '000' || (52742000000 + k) END AS gtin
  FROM (SELECT sku AS k, store_id, cents, r_regionkey AS n FROM latest JOIN region ON r_name = store_id WHERE store_id <> 'EUROPE' AND cents > 0)),
own_keys AS (
  SELECT DISTINCT sku AS my_sku, lpad(raw, 14, '0') AS key, CASE WHEN regexp_full_match(code, '[0-9]{8,14}') OR raw = sku THEN raw END AS literal
  FROM (SELECT sku, code, unnest([regexp_extract(code, '^[0-9]{8,14}'), regexp_extract(sku, '^[0-9]{8,14}$')]) AS raw FROM coded_own) WHERE raw <> ''),
rival_keys AS (
  SELECT DISTINCT sku AS rival_sku, store_id, lpad(raw, 14, '0') AS key, raw FROM (SELECT sku, store_id, unnest([gtin, regexp_extract(sku, '^[0-9]{8,14}$')]) AS raw FROM coded_rivals) WHERE raw <> ''),
met AS (
  SELECT my_sku, rival_sku, r.store_id, bool_or(coalesce(literal = raw OR literal = r.key, false)) AS literal FROM own_keys o JOIN rival_keys r ON o.key = r.key GROUP BY ALL),
guarded AS (
  SELECT m.*, o.cents AS my_cents, r.cents AS rival_cents FROM met m JOIN coded_own o ON o.sku = my_sku JOIN coded_rivals r ON r.sku = rival_sku AND r.store_id = m.store_id, facts
  WHERE pack[i + 1] = pack[j + 1] AND NOT coalesce(greatest(grams[i + 1], grams[j + 1])::DOUBLE / least(grams[i + 1], grams[j + 1]) > 1.1::DOUBLE, false)
    AND (greatest(o.cents, r.cents)::DOUBLE / least(o.cents, r.cents) < 6 OR coalesce(stated[i + 1] = stated[j + 1], false) OR (i IN (0, 1) AND j IN (0, 1) AND i <> j)))"""


@query(SNAPS, RECENT, LATEST, FACTS, CODED, """
SELECT my_sku, rival_sku, store_id, my_cents, rival_cents, 99 AS confidence, CASE WHEN literal THEN 'literal' ELSE 'gtin14' END AS barcode_key
FROM guarded QUALIFY row_number() OVER (PARTITION BY my_sku, store_id ORDER BY rival_cents, rival_sku) = 1""")  # fmt: skip
def key_set_matches(t):
    """Matches by sets of codes: as sku, with leading zeros, with something after them, and a placeholder that many products share."""
    k, number = F.col("k"), F.lit(52742000000)
    code = (number + k).cast("string")
    own = tables.table(t.spark, t.sf_dir, "part").where("p_partkey % 4 = 0").withColumn("k", F.col("p_partkey").cast("long")).select(
        F.when(k % 5 == 2, code).otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("sku"), tables.name_at("k div 4").alias("name"), F.round(F.col("p_retailprice") * 100 * 35).cast("long").alias("cents"),
        F.when(k % 40 == 4, "00000000").when(k % 5 == 0, F.concat(F.lit("0"), code)).when(k % 5 == 1, F.concat(code, F.lit("carton"))).when(k % 5 == 3, code).alias("barcode"),
    )
    numbered = t.latest.join(F.broadcast(t.store_meta.select("store_id", "number")), "store_id").where(F.col("store_id") != tables.OWN_STORE).withColumn("k", F.col("sku").cast("long"))
    n = (k + F.col("number")) % 4
    rivals = numbered.select(
        F.when(n == 1, code).when(n == 3, F.concat(code, F.lit("-x"))).otherwise(F.concat(F.lit("R"), k.cast("string"))).alias("sku"), "store_id", tables.name_at("k div 4 + k div 64").alias("name"), "cents",
        F.when((k + F.col("number")) % 8 == 0, "00000000").when(n == 0, code).when(n == 2, F.concat(F.lit("000"), code)).alias("gtin"),
    )
    return matching.key_matches(own, rivals).where("method = 'barcode'").select("my_sku", "rival_sku", "store_id", "my_cents", "rival_cents", "confidence", "barcode_key")


@query(CATALOGUE, """
SELECT sku, lower(['royal canin', 'royal canin', 'pedigree', 'pedigree', NULL, NULL, NULL, 'kong', NULL, 'tetra', NULL, NULL, NULL, 'whiskas', 'acana', NULL][((sku // 4) % 16)::INT + 1]) AS matched FROM catalogue""")
def matched_brands(t):
    return t.catalogue.select("sku", text.matched_brand(F.col("name")).alias("matched"))
