"""Queries on the own catalogue against the market, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.operators import catalogue, estimates, matching, orders, rollups
from tarifa.plans.oracles import AS_OF, CLOSES, DAYS, ESTIMATED, LATEST, RECENT, SNAPS, query
from tarifa.sources import tables
from tarifa.sources.tables import NAMES

_NAME = "[" + ", ".join(f"'{n}'" for n in NAMES) + "][((p_partkey // 4) % 16)::INT + 1]"
CATALOGUE = f"catalogue AS (SELECT p_partkey AS sku, {_NAME} AS name, p_brand AS brand, p_type AS category, TIMESTAMP '2001-11-04' - to_days((p_partkey % 400)::INT) AS first_seen_at FROM part)"
OWN_ROWS = f"""
own_rows AS (SELECT p_partkey AS sku, CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 24 = 0 THEN (5200000000000 + p_partkey) || 'carton' ELSE (5200000000000 + p_partkey)::VARCHAR END AS barcode,
  {_NAME} AS name, cents, CASE WHEN p_partkey % 12 = 0 THEN cents * 8 // 10 WHEN p_partkey % 20 = 4 THEN 0 END AS sale_cents, CASE WHEN p_partkey % 28 <> 0 THEN p_size END AS qty, CASE WHEN p_partkey % 28 <> 0 THEN p_size > 5 END AS in_stock,
  CASE WHEN p_partkey % 40 = 0 THEN false WHEN p_partkey % 8 = 0 THEN true END AS present, CASE WHEN p_partkey % 100 <> 0 THEN TIMESTAMP '2001-11-04' - to_days((p_partkey % 120)::INT) END AS synced_at,
  CASE WHEN p_partkey % 16 = 0 THEN '' ELSE 'https://own.example/products/' || (p_partkey + 7000000) END AS url, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS taxable,
  CASE WHEN p_partkey % 8 = 0 THEN 'merchant' ELSE 'storefront' END AS source, CASE WHEN p_partkey % 12 = 0 THEN p_partkey + 2 END AS code_sku
  FROM (SELECT p_partkey, p_size, round(p_retailprice * 100 * 35)::BIGINT AS cents FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey + 10000000, p_size, round(p_retailprice * 100 * 35)::BIGINT FROM part WHERE p_partkey % 100 = 0))"""
META = """meta AS (SELECT r_name AS store_id, r_regionkey AS number, r_name = 'EUROPE' AS is_own, CASE WHEN r_regionkey % 2 = 0 THEN 'salla' ELSE 'zid' END AS platform,
  CASE WHEN r_regionkey % 2 = 0 THEN 'https://www.' ELSE '' END || replace(lower(r_name), ' ', '-') || '.example/' AS domain FROM region)"""
LINKS = """links AS (SELECT sku AS my_sku, CASE WHEN sku % 8 = 0 THEN sku + 1 ELSE sku END AS rival_sku, store_id, [99, 95, 85, 80, 70, 60][((sku // 4 + number) % 6)::INT + 1] AS confidence,
  ['barcode', 'sku', 'name', 'name', 'name', 'name'][((sku // 4 + number) % 6)::INT + 1] AS method, sku % 52 = 0 AS confirmed FROM own_rows CROSS JOIN meta WHERE NOT is_own AND (sku // 4 + number) % 3 <> 0)"""
BASE = (SNAPS, RECENT, LATEST, CATALOGUE, OWN_ROWS, META, LINKS)
MINE = "mine AS (SELECT *, coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) AS my_cents FROM own_rows WHERE coalesce(present, true))"
RIVALS_OF = """
found AS (SELECT my_sku, rival_sku, l.store_id, n.cents, l.confidence, 0 AS source FROM links l JOIN latest n ON n.sku = l.rival_sku AND n.store_id = l.store_id JOIN mine ON mine.sku = my_sku
  UNION ALL SELECT m.sku, n.sku, n.store_id, n.cents, 0, 1 FROM mine m JOIN latest n ON n.sku = m.code_sku WHERE n.store_id <> 'EUROPE'),
rivals_of AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY my_sku, store_id ORDER BY source, confidence DESC, rival_sku) = 1)"""
BOUGHT = """bought AS (SELECT l_partkey AS sku, sum(l_quantity::BIGINT)::BIGINT AS o_units, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS o_revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY l_partkey)"""
TABLE = """
market AS (SELECT sku, count(*) AS num_sellers, min(cents) AS low, max(cents) AS high, median(cents)::DOUBLE AS middle, sum(cents) / count(cents) AS mean FROM latest GROUP BY sku),
sold AS (SELECT sku, sum(units)::BIGINT AS units, sum(round(units * mean_cents)::BIGINT)::BIGINT AS revenue FROM united GROUP BY sku),
per_own AS (SELECT my_sku AS sku, count(*) AS num_competitors, count(cents) AS num_priced, min(cents) AS rival_low, max(cents) AS rival_high, max(confidence) AS confidence FROM rivals_of GROUP BY my_sku),
table_ AS (SELECT m.sku, m.name, m.barcode, coalesce(c.category, '') AS category, c.sku IS NOT NULL AS in_catalogue, my_cents,
  CASE WHEN qty IS NULL AND in_stock IS NULL THEN NULL WHEN NOT in_stock THEN 'OOS' WHEN coalesce(qty, 0) <= 0 THEN CASE WHEN in_stock THEN 'AVAIL' ELSE 'OOS' END WHEN qty < 10 THEN 'LOW' WHEN qty <= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS my_stock,
  CASE WHEN url <> '' THEN url ELSE 'https://own.example/search?keyword=' || m.sku END AS product_url, coalesce(num_sellers, 0) AS num_sellers, low, high, middle,
  CASE WHEN low > 0 THEN round((mean - low) * 100 / low, 1) END AS vs_lowest_pct, CASE WHEN middle > 0 THEN round((mean - middle) * 100 / middle, 1) END AS vs_median_pct,
  coalesce(units, 0) AS market_units, coalesce(revenue, 0) AS market_revenue, coalesce(num_competitors, 0) AS num_competitors, coalesce(num_priced, 0) AS num_priced, rival_low, rival_high,
  CASE WHEN my_cents > 0 THEN round((rival_low - my_cents) * 100 / my_cents, 1) END AS vs_my_price_pct, coalesce(confidence, 0) AS confidence, coalesce(o_units, 0) AS my_units, coalesce(o_revenue, 0) AS my_revenue,
  CASE WHEN coalesce(num_priced, 0) >= 1 AND coalesce(units, 0) > 0 THEN round(coalesce(o_units, 0) * 100 / units, 1) END AS share_pct, coalesce(num_priced, 0) >= 1 AND coalesce(units, 0) > 0 AS has_share
  FROM mine m LEFT JOIN catalogue c USING (sku) LEFT JOIN market USING (sku) LEFT JOIN sold USING (sku) LEFT JOIN per_own USING (sku) LEFT JOIN bought USING (sku))"""
FULL = (*BASE, MINE, RIVALS_OF, BOUGHT, ESTIMATED, TABLE)


@query(*BASE, MINE, RIVALS_OF, "SELECT my_sku, rival_sku, store_id, cents, confidence, source FROM rivals_of")
def competitor_union(t):
    return catalogue.competitors(catalogue.on_store(t.own_catalogue), t.links, t.latest, tables.OWN_STORE)


@query(*FULL, "SELECT * FROM table_")
def my_products_table(t):
    sales = estimates.window_sales(t.snapshots, AS_OF, DAYS)
    return catalogue.rows(t.own_catalogue, t.catalogue, t.links, t.latest, sales, orders.by_sku(t.orders), tables.OWN_STORE)


@query(*FULL, """SELECT count(*) AS total_products, coalesce(sum(market_units), 0)::BIGINT AS total_units_sold, coalesce(sum(market_revenue), 0)::BIGINT AS market_revenue,
  coalesce(round(sum(my_units) FILTER (has_share) * 100 / sum(market_units) FILTER (has_share), 1), 0) AS avg_market_share, count(*) FILTER (num_priced >= 1) AS matched_products,
  round(count(*) FILTER (num_priced >= 1) * 100 / count(*), 1) AS market_coverage_pct, count(*) FILTER (has_share) AS share_sample_size, sum(my_cents * market_units)::BIGINT AS total_revenue,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS my_orders_count, (SELECT sum(o_units)::BIGINT FROM bought) AS my_units_sold, (SELECT sum(o_revenue)::BIGINT FROM bought) AS my_revenue, 'orders' AS my_revenue_source FROM table_""")
def my_products_kpi_block(t):
    return catalogue.kpis(my_products_table(t), orders.totals(t.orders))


@query(*FULL, """SELECT sku, name, category, vs_my_price_pct FROM table_ WHERE category = 'ECONOMY' AND (lower(name) LIKE '%food 24 x%' OR lower(barcode) LIKE '%food 24 x%' OR sku::VARCHAR LIKE '%food 24 x%')
  ORDER BY coalesce(vs_my_price_pct, 0) DESC, sku LIMIT 7 OFFSET 2""")
def my_products_page(t):
    found = catalogue.of_category(my_products_table(t).withColumn("subcategory", F.lit(None).cast("string")), "ECONOMY", ("cat_food_dry",))
    found = catalogue.searched(found, "FOOD 24 x", ("name", "barcode", "sku"))
    return catalogue.page(found, "vs_my_price_pct", 2, 7).select("sku", "name", "category", "vs_my_price_pct")


@query("""SELECT DISTINCT category FROM (SELECT p_type AS category FROM part UNION ALL SELECT CASE (p_partkey // 4) % 16 WHEN 0 THEN 'cat_food_dry' WHEN 1 THEN 'cat_food_dry' WHEN 2 THEN 'dog_food_wet' WHEN 3 THEN 'dog_food_wet' WHEN 4 THEN 'dog_treats' END FROM part) WHERE coalesce(category, '') <> ''""")
def category_dropdown(t):
    rows = t.catalogue.withColumn("kind", text.category(F.col("name")))
    return catalogue.category_list(rows.withColumn("subcategory", text.food_form(F.col("kind"), F.col("name"))))


@query(OWN_ROWS, META, LINKS, "edges AS (SELECT DISTINCT my_sku AS a, 20000000 + my_sku // 16 AS b FROM links)", """SELECT DISTINCT a AS my_sku, b AS other_sku FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges UNION ALL SELECT x.a, y.a FROM edges x JOIN edges y ON x.b = y.b) WHERE a <> b""")
def seller_set_two_hop(t):
    return matching.seller_set(t.links.select("my_sku", F.expr("20000000 + my_sku div 16").alias("rival_sku")))


@query(OWN_ROWS, META, LINKS, f"""names AS (SELECT {[n.lower().replace('.', ' ') for n in NAMES]} AS n),
words AS (SELECT my_sku, store_id, list_filter(string_split(n[((my_sku // 4) % 16)::INT + 1], ' '), lambda w: length(w) > 1 AND w NOT IN ('and', 'for')) AS a, list_filter(string_split(n[((rival_sku // 4 + confidence % 7) % 16)::INT + 1], ' '), lambda w: length(w) > 1 AND w NOT IN ('and', 'for')) AS b FROM links, names)""",
"SELECT my_sku, store_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM words")
def name_similarity(t):
    a, b = (text.tokens(tables.name_at(place)) for place in ("my_sku div 4", "rival_sku div 4 + confidence % 7"))
    return t.links.select("my_sku", "store_id", text.name_similarity(a, b).alias("similarity"))


PACKS = "packs AS (SELECT *, [1, 24, 1, 12, 1, 1, 1, 1, 1, 1, 1, 1, -1, 1, 24, 1][((sku // 4) % 16)::INT + 1] AS pack FROM (SELECT sku FROM catalogue UNION SELECT sku FROM own_rows))"
SELLERS = """
near AS (SELECT * FROM snaps WHERE crawled_at >= TIMESTAMP '2001-11-04' - INTERVAL 180 DAYS),
reached AS (SELECT o.sku, n.store_id, n.sku AS key, n.crawled_at, n.seq, n.cents, n.qty, n.in_stock, 'sku' AS match_source, false AS excluded FROM own_rows o JOIN near n ON n.sku = o.sku
  UNION ALL SELECT l.my_sku, n.store_id, n.sku, n.crawled_at, n.seq, n.cents, n.qty, n.in_stock, 'matched', p.pack <> q.pack FROM links l JOIN near n ON n.sku = l.rival_sku AND n.store_id = l.store_id
    JOIN packs p ON p.sku = l.my_sku JOIN packs q ON q.sku = l.rival_sku WHERE l.rival_sku <> l.my_sku),
newest AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY sku, store_id, excluded ORDER BY crawled_at DESC, key DESC, match_source) = 1),
sellers AS (SELECT sku, store_id, key, cents, qty, match_source, excluded, floor((epoch(TIMESTAMP '2001-11-04') - epoch(crawled_at)) / 86400)::BIGINT AS days_since_crawl,
  floor((epoch(TIMESTAMP '2001-11-04') - epoch(crawled_at)) / 86400) >= 7 AS is_stale, crawled_at::DATE AS price_as_of, CASE WHEN floor((epoch(TIMESTAMP '2001-11-04') - epoch(crawled_at)) / 86400) >= 7 THEN 'stale' ELSE 'live' END AS data_status,
  NOT in_stock AS is_oos FROM newest)"""


@query(*BASE, PACKS, SELLERS, "SELECT sku, store_id, match_source, excluded, days_since_crawl, is_stale, price_as_of, data_status FROM sellers")
def product_sellers(t):
    names = t.catalogue.select("sku", "name").union(t.own_catalogue.select("sku", "name")).distinct()
    found = catalogue.sellers(t.own_catalogue.select("sku"), t.links, t.snapshots, names, AS_OF)
    return found.select("sku", "store_id", "match_source", "excluded", "days_since_crawl", "is_stale", "price_as_of", "data_status")


@query(*BASE, PACKS, SELLERS, """SELECT sku, count(*) FILTER (NOT excluded) AS total, count(*) FILTER (NOT excluded AND data_status = 'live') AS live, count(*) FILTER (NOT excluded AND data_status <> 'live') AS stale,
  count(*) FILTER (NOT excluded AND match_source = 'sku') AS via_sku, count(*) FILTER (NOT excluded AND match_source = 'matched') AS via_match, count(*) FILTER (excluded) AS excluded_wrong_match FROM sellers GROUP BY sku""")
def seller_summaries(t):
    names = t.catalogue.select("sku", "name").union(t.own_catalogue.select("sku", "name")).distinct()
    found = catalogue.seller_summary(catalogue.sellers(t.own_catalogue.select("sku"), t.links, t.snapshots, names, AS_OF))
    return found.select("sku", "total", "live", "stale", "via_sku", "via_match", "excluded_wrong_match")


@query(*BASE, PACKS, SELLERS, """SELECT sku, store_id, cents, row_number() OVER (PARTITION BY sku ORDER BY cents ASC NULLS LAST, store_id)::INT AS place
  FROM (SELECT sku, store_id, CASE WHEN cents % 9 <> 0 THEN cents END AS cents FROM sellers WHERE NOT excluded)""")
def product_seller_list(t):
    """Every product's sellers by price; a ninth of the prices is taken as not known."""
    names = t.catalogue.select("sku", "name").union(t.own_catalogue.select("sku", "name")).distinct()
    found = catalogue.sellers(t.own_catalogue.select("sku"), t.links, t.snapshots, names, AS_OF)
    return catalogue.seller_list(found.withColumn("cents", F.when(F.col("cents") % 9 != 0, F.col("cents")))).select("sku", "store_id", "cents", "place")


@query(*BASE, """listed AS (SELECT sku, CASE WHEN sku % 5 = 0 THEN 'https://list.example/' || sku WHEN sku % 5 = 1 THEN ' ' END AS url FROM catalogue),
read_ AS (SELECT sku, min(store_id) FILTER (sku % 3 <> 0 AND cents % 2 = 0) AS store_id FROM latest GROUP BY sku),
own_urls AS (SELECT sku, max(nullif(url, '')) AS url FROM own_rows WHERE sku % 8 <> 0 GROUP BY sku)""",
"""SELECT l.sku, coalesce(o.url, nullif(trim(l.url), ''), 'https://' || lower(replace(r.store_id, ' ', '-')) || '.example/p/' || l.sku, 'https://own.example/search?keyword=' || l.sku) AS url,
  CASE WHEN o.url IS NOT NULL THEN 'own' WHEN trim(l.url) <> '' THEN 'catalogue' WHEN r.store_id IS NOT NULL THEN 'reading' ELSE 'search' END AS source
  FROM listed l LEFT JOIN own_urls o ON o.sku = l.sku LEFT JOIN read_ r ON r.sku = l.sku""")  # fmt: skip
def product_addresses(t):
    """Where a product is shown: the own shop, the catalogue, the first store that shows an address, or a search."""
    listed = t.catalogue.select("sku", F.expr("CASE WHEN sku % 5 = 0 THEN concat('https://list.example/', sku) WHEN sku % 5 = 1 THEN ' ' END").alias("url"))
    shown = F.when((F.col("sku") % 3 != 0) & (F.col("cents") % 2 == 0), F.concat(F.lit("https://"), F.lower(F.replace("store_id", F.lit(" "), F.lit("-"))), F.lit(".example/p/"), F.col("sku").cast("string")))
    newest = t.latest.select("sku", "store_id", shown.alias("url"))
    return catalogue.addresses(listed, t.own_catalogue.where("sku % 8 <> 0").select("sku", "url"), newest, t.store_meta.select("store_id", "domain"), "own.example")


#: How many readings of a pair its history shows.
HISTORY_CAP = 8_000


@query(SNAPS, """kept AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) <= 8000)""",
       "SELECT sku, store_id, string_agg(strftime(crawled_at, '%Y-%m-%d') || '=' || cents, ',' ORDER BY crawled_at, seq) AS points FROM kept GROUP BY ALL")
def price_history_by_store(t):
    found = catalogue.history(t.snapshots.drop("sold"), HISTORY_CAP).select("sku", F.explode("history").alias("store_id", "points"))
    return found.select("sku", "store_id", F.array_join(F.transform("points", lambda p: F.concat(F.date_format(p["at"], "yyyy-MM-dd"), F.lit("="), p["cents"].cast("string"))), ",").alias("points"))


@query(SNAPS, CLOSES, """SELECT sku, day, max(cents) FILTER (store_id = 'AFRICA') AS AFRICA, max(cents) FILTER (store_id = 'ASIA') AS ASIA, max(cents) FILTER (store_id = 'EUROPE') AS EUROPE FROM closes WHERE store_id IN ('AFRICA', 'ASIA', 'EUROPE') GROUP BY ALL""")
def price_chart_pivot(t):
    closes = rollups.day_closes(t.snapshots.drop("sold")).where("store_id IN ('AFRICA', 'ASIA', 'EUROPE')")
    return catalogue.chart(closes.select("sku", "day", "store_id", "cents"), ["AFRICA", "ASIA", "EUROPE"])


@query(SNAPS, CLOSES, """SELECT sku, store_id, CASE WHEN first_ > 0 THEN round((last_ - first_) * 100 / first_, 1) + 0 END AS change_pct, CASE WHEN high > low THEN round((last_ - low) * 100 / (high - low), 1) ELSE 50 END AS range_pct
  FROM (SELECT sku, store_id, arg_min(cents, day) AS first_, arg_max(cents, day) AS last_, min(cents) AS low, max(cents) AS high FROM closes GROUP BY ALL)""")
def price_sparklines(t):
    return catalogue.sparkline(rollups.day_closes(t.snapshots.drop("sold")))


SHOP = """
shop AS (SELECT sku + 7000000 AS row_id, CASE WHEN sku % 16 = 4 THEN 'X-' || sku WHEN sku % 16 = 8 THEN (5200000000000 + sku)::VARCHAR ELSE sku::VARCHAR END AS sku,
  CASE WHEN sku % 32 = 4 THEN '0' || (5200000000000 + sku) WHEN sku % 48 = 24 THEN '0' || (5200000000000 + sku) WHEN sku % 16 = 12 THEN (5200000000000 + sku) || 'box' END AS barcode,
  cents - 500 AS price, CASE WHEN sku % 7 = 0 THEN cents - 900 WHEN sku % 7 = 1 THEN 0 END AS effective FROM own_rows WHERE sku % 28 <> 0),
asked AS (SELECT sku AS own_sku, CASE WHEN sku % 16 IN (4, 8) THEN 'M-' || sku WHEN sku % 48 = 12 THEN 'Z.' || (sku + 7000000) ELSE sku::VARCHAR END AS own_key, CASE WHEN sku % 48 = 12 THEN NULL ELSE barcode END AS barcode, CASE WHEN sku % 48 = 12 THEN '' ELSE url END AS url, cents, sale_cents, taxable, synced_at, source FROM own_rows)"""


def _shop(t):
    """The shop's rows under keys of its own, and the own rows under theirs."""
    own = t.own_catalogue
    shop = own.where("sku % 28 <> 0").select(
        (F.col("sku") + 7_000_000).alias("row_id"), F.expr("CASE WHEN sku % 16 = 4 THEN concat('X-', sku) WHEN sku % 16 = 8 THEN cast(5200000000000 + sku AS string) ELSE cast(sku AS string) END").alias("s"),
        F.expr("CASE WHEN sku % 32 = 4 THEN concat('0', 5200000000000 + sku) WHEN sku % 48 = 24 THEN concat('0', 5200000000000 + sku) WHEN sku % 16 = 12 THEN concat(5200000000000 + sku, 'box') END").alias("barcode"),
        (F.col("cents") - 500).alias("price"), F.expr("CASE WHEN sku % 7 = 0 THEN cents - 900 WHEN sku % 7 = 1 THEN 0 END").alias("effective"),
    ).withColumnRenamed("s", "sku")
    key = F.expr("CASE WHEN sku % 16 IN (4, 8) THEN concat('M-', sku) WHEN sku % 48 = 12 THEN concat('Z.', sku + 7000000) ELSE cast(sku AS string) END")
    own = own.select("sku", key.alias("own_key"), F.expr("CASE WHEN sku % 48 <> 12 THEN barcode END").alias("barcode"), F.expr("CASE WHEN sku % 48 = 12 THEN '' ELSE url END").alias("url"), "cents", "sale_cents", "taxable", "synced_at", "source")
    return own.withColumnRenamed("sku", "own_sku").withColumnRenamed("own_key", "sku"), shop


RESOLVED = r"""
keyed AS (SELECT own_sku, lower(own_key) AS s, lower(trim(barcode)) AS raw, nullif(regexp_extract(lower(trim(barcode)), '^([0-9]{8,14})(?:[^0-9]|$)', 1), '') AS lead, nullif(regexp_extract(url, '/(?:products?/|p)([0-9]+)', 1), '') AS url_id,
  nullif(regexp_extract(own_key, '^([0-9]{8,14})$', 1), '') AS numeric, CASE WHEN lower(own_key) LIKE 'z.%' THEN substr(lower(own_key), 3) END AS zid FROM asked),
shelf AS (SELECT *, lower(sku) AS s, lower(barcode) AS raw, nullif(regexp_extract(lower(barcode), '^([0-9]{8,14})(?:[^0-9]|$)', 1), '') AS lead FROM shop),
codes AS (SELECT DISTINCT row_id, unnest([raw, lead, lpad(lead, 14, '0')]) AS code FROM shelf),
hits AS (
  SELECT own_sku, row_id, 0 AS place FROM keyed k JOIN shelf h ON h.s = k.s
  UNION ALL SELECT own_sku, row_id, 1 FROM keyed JOIN codes ON code = raw
  UNION ALL SELECT own_sku, row_id, 2 FROM keyed JOIN codes ON code = lead AND lead <> raw
  UNION ALL SELECT own_sku, row_id, 3 FROM keyed JOIN codes ON code = lpad(lead, 14, '0') AND lpad(lead, 14, '0') NOT IN (raw, lead)
  UNION ALL SELECT own_sku, row_id, 4 FROM keyed k JOIN shelf h ON h.s IN (k.raw, k.lead)
  UNION ALL SELECT own_sku, row_id, 5 FROM keyed JOIN shelf h ON h.row_id::VARCHAR = url_id
  UNION ALL SELECT own_sku, row_id, CASE WHEN code = k.s THEN 6 ELSE 7 END FROM keyed k JOIN codes ON code IN (k.s, k.numeric, lpad(k.numeric, 14, '0'))
  UNION ALL SELECT own_sku, row_id, 8 FROM keyed k JOIN shelf h ON h.row_id::VARCHAR = zid OR h.s = zid),
resolved AS (SELECT own_sku, row_id, ['sku', 'barcode', 'barcode_normalized', 'barcode_gtin14', 'barcode_as_sku', 'product_url_id', 'sku_as_barcode', 'sku_as_barcode_gtin14', 'zid_internal_id'][place + 1] AS method
  FROM hits QUALIFY row_number() OVER (PARTITION BY own_sku ORDER BY place, row_id DESC) = 1)"""


@query(OWN_ROWS, SHOP, RESOLVED, "SELECT own_key AS sku, row_id, method FROM resolved JOIN asked USING (own_sku)")
def own_key_resolver(t):
    own, shop = _shop(t)
    return catalogue.resolved(own, shop).select("sku", "row_id", "method")


@query(OWN_ROWS, SHOP, RESOLVED, """, priced AS (SELECT a.*, method, h.price AS shop_price, CASE WHEN effective > 0 THEN effective ELSE h.price END AS shelf FROM asked a LEFT JOIN resolved r USING (own_sku) LEFT JOIN shop h ON h.row_id = r.row_id)
SELECT own_key AS sku, CASE WHEN shelf > 0 THEN shelf WHEN taxable THEN round(cents * 115 / 100)::BIGINT ELSE cents END AS price,
  CASE WHEN shelf > 0 THEN CASE WHEN shop_price > 0 AND shelf < shop_price THEN shelf END WHEN sale_cents > 0 THEN CASE WHEN taxable THEN round(sale_cents * 115 / 100)::BIGINT ELSE sale_cents END END AS sale_price,
  CASE WHEN shelf > 0 THEN 'storefront_inc_vat' WHEN taxable IS NULL THEN 'merchant_unknown_tax' WHEN taxable THEN 'merchant_computed_inc_vat' ELSE 'merchant_non_taxable' END AS basis, method FROM priced""".replace(", priced", "\n, priced"))
def own_price_basis(t):
    own, shop = _shop(t)
    return catalogue.price_basis(own.withColumnsRenamed({"cents": "price", "sale_cents": "sale_price"}), shop)


@query(OWN_ROWS, SHOP, RESOLVED, """, gone AS (SELECT *, floor((epoch(TIMESTAMP '2001-11-04') - epoch(synced_at)) / 86400) AS age FROM asked WHERE own_sku NOT IN (SELECT own_sku FROM resolved))
SELECT source, CASE WHEN synced_at IS NULL THEN 'never_synced' WHEN age < 7 THEN '<7d' WHEN age < 30 THEN '7-30d' WHEN age < 90 THEN '30-90d' ELSE '>90d' END AS age, count(*) AS rows FROM gone GROUP BY ALL""")
def stale_own_rows(t):
    own, shop = _shop(t)
    return catalogue.stale_breakdown(own, catalogue.resolved(own, shop), AS_OF)


@query(OWN_ROWS, """codes AS (SELECT barcode, min(sku) AS hit FROM own_rows WHERE barcode IS NOT NULL GROUP BY barcode),
arrived AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN (5200000000000 + p_partkey)::VARCHAR ELSE p_partkey::VARCHAR END AS sku, CASE WHEN p_partkey % 5 = 0 THEN (5200000000000 + p_partkey)::VARCHAR END AS barcode FROM part)""",
"""SELECT a.n, coalesce(c.hit, o.sku, x.hit) AS own_sku, CASE WHEN c.hit IS NOT NULL THEN 'barcode' WHEN o.sku IS NOT NULL THEN 'sku' WHEN x.hit IS NOT NULL THEN 'sku_as_barcode' ELSE 'new' END AS method
FROM arrived a LEFT JOIN codes c USING (barcode) LEFT JOIN own_rows o ON o.sku::VARCHAR = a.sku LEFT JOIN codes x ON x.barcode = a.sku AND regexp_full_match(a.sku, '[0-9]{8,14}')""")  # fmt: skip
def ingest_mirror(t):
    code = "cast(5200000000000 + sku AS string)"
    arrived = t.catalogue.select(F.col("sku").alias("n"), F.expr(f"CASE WHEN sku % 3 = 0 THEN {code} ELSE cast(sku AS string) END").alias("s"), F.expr(f"CASE WHEN sku % 5 = 0 THEN {code} END").alias("barcode"))
    return catalogue.mirrored(t.own_catalogue, arrived.withColumnRenamed("s", "sku"))


@query("""SELECT sku, list_sort(list_distinct(list_filter([raw, lead, lpad(lead, 14, '0')], lambda x: x IS NOT NULL)))::VARCHAR AS keys FROM (
  SELECT p_partkey AS sku, raw, nullif(regexp_extract(raw, '^([0-9]{8,14})(?:[^0-9]|$)', 1), '') AS lead FROM (SELECT p_partkey, nullif(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '4021' WHEN 2 THEN (52000000 + p_partkey)::VARCHAR WHEN 3 THEN (5200000000000 + p_partkey) || 'carton' ELSE ((5200000000000 + p_partkey) || '99') END, '') AS raw FROM part))""")
def barcode_key_sets(t):
    raw = F.expr("CASE sku % 5 WHEN 0 THEN '' WHEN 1 THEN '4021' WHEN 2 THEN cast(52000000 + sku AS string) WHEN 3 THEN concat(5200000000000 + sku, 'carton') ELSE concat(5200000000000 + sku, '99') END")
    keys = F.array_sort(catalogue.barcode_keys(raw))
    return t.catalogue.select("sku", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"))
