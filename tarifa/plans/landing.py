"""Queries on landed pages, cursor lists, and the streams' kept tables; streams are replayed in batches of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.plans.oracles import CLOSES, COVER, ROLLUPS, SALES, SNAPS, query
from tarifa.session import shared_folder, stored, unstored
from tarifa.sources import cursors, landed, tables
from tarifa.streaming import chain, kept, ledger
from tarifa.streaming.commits import Commits

_PLAIN = "replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&')"
ANCHORS = r"""
anchors AS (
  SELECT page_id, generate_subscripts(found, 1)::INT AS place, unnest(found) AS anchor
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS found FROM pages))"""


def _batches(frame, count: int):
    """frame (batch, ...) batch by batch."""
    for n in range(count):
        yield n, frame.where(F.col("batch") == n).drop("batch")


def _commits(t, name: str, shapes) -> Commits:
    return Commits(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}", shapes)


@query(
    ANCHORS,
    f"""
SELECT page_id, 'link' AS field, place, {_PLAIN.format("trim(regexp_extract(anchor, '>([^<]*)</a>', 1))")} AS text, {_PLAIN.format("regexp_extract(anchor, 'href=\"([^\"]*)\"', 1)")} AS value FROM anchors
UNION ALL
SELECT page_id, 'title', 1, {_PLAIN.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")}, NULL FROM pages WHERE html LIKE '%<h1>%'
UNION ALL
SELECT page_id, 'notice', 1, {_PLAIN.format("trim(regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1))")}, NULL FROM pages WHERE html LIKE '%<div class="ad">%'""",
)
def page_elements(t):
    fields = {"link": (("[data-none]", "nav li a"), "href"), "title": (("h1", "title"), None), "notice": ((".ad",), None)}
    return landed.page_elements(tables.table(t.spark, t.sf_dir, "pages"), fields).drop("number")


@query(
    ANCHORS,
    f"""
SELECT page_id, {_PLAIN.format("trim(regexp_extract(anchor, '>([^<]*)</a>', 1))")} AS name, count(*) AS times FROM anchors
WHERE page_id IN (SELECT page_id FROM anchors GROUP BY page_id HAVING count(*) >= 3) GROUP BY ALL HAVING name <> ''""",
)
def page_cards(t):
    """What pages list in their menus, as cards."""
    profile = {"menu": {"card": (".menu-item", "nav li"), "name": ("h3", "a"), "price": (".price",), "orig": ("del",), "image": ("img",)}}
    return landed.page_cards(tables.table(t.spark, t.sf_dir, "pages"), profile).groupBy("page_id", "name").agg(F.count("*").alias("times"))


@query(
    ANCHORS,
    f"""
SELECT a.page_id, place, CASE WHEN said LIKE '//%' THEN 'https:' || said WHEN said LIKE '/%' THEN 'https://' || domain || said WHEN regexp_matches(said, '^https?://') THEN said WHEN said = '' THEN '' ELSE 'https://' || domain || '/products/' || said END AS address
FROM (SELECT page_id, place, trim({_PLAIN.format("regexp_extract(anchor, 'href=\"([^\"]*)\"', 1)")}) AS said FROM anchors) a
JOIN (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z]+://)?(?:www[.])?([^/?#:]+)', 1)) AS domain FROM pages) USING (page_id)""",
)
def page_link_addresses(t):
    """Where the links of pages lead, as whole addresses."""
    pages = tables.table(t.spark, t.sf_dir, "pages")
    found = landed.page_elements(pages, {"link": (("nav li a",), "href")})
    domains = pages.select("page_id", text.domain(F.col("url")).alias("domain"))
    return found.join(domains, "page_id").select("page_id", "place", text.absolute_url(F.col("value"), F.col("domain")).alias("address"))


_URL = "'https://shop.example/en/api/' || {0} || '/' || {1}"
CHAINS = f"""
ordered AS (
  SELECT o_custkey AS walk, o_orderkey AS key, row_number() OVER customer AS n, lead(o_orderkey) OVER customer AS following, first_value(o_orderkey) OVER customer AS first
  FROM orders WINDOW customer AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
marked AS (
  SELECT *, CASE WHEN key % 31 = 0 THEN 'http_500' WHEN key % 29 = 0 THEN 'empty_page' WHEN following IS NULL THEN 'exhausted' WHEN key % 23 = 0 THEN 'missing_page' WHEN key % 19 = 0 THEN 'cycle' END AS stop FROM ordered),
ended AS (SELECT *, min(n) FILTER (stop IS NOT NULL) OVER (PARTITION BY walk) AS last FROM marked),
chains AS (
  SELECT walk, n AS rank, {_URL.format("walk", "key")} AS url, CASE WHEN n = last AND stop <> 'missing_page' THEN stop END AS stop FROM ended WHERE n <= last
  UNION ALL SELECT walk, n + 1, {_URL.format("walk", "'gone-' || key")}, stop FROM ended WHERE n = last AND stop = 'missing_page')"""


@query(CHAINS, "SELECT walk, rank, url, stop FROM chains")
def cursor_pages(t):
    """Every customer's orders as a list of pages that cursors link; some fail, are empty, are missing, or lead back."""
    address = lambda key: F.concat(F.lit("https://shop.example/en/api/"), F.col("o_custkey").cast("string"), F.lit("/"), key.cast("string"))
    key = F.col("o_orderkey")
    orders = tables.table(t.spark, t.sf_dir, "orders").select("o_custkey", "o_orderkey")
    heads = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    following = F.expr("lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    rows = orders.withColumn("following", following).join(heads, "o_custkey")
    after = F.when(F.col("following").isNull(), F.lit(None)).when(key % 23 == 0, address(F.concat(F.lit("gone-"), key))).when(key % 19 == 0, address(F.col("first"))).otherwise(address(F.col("following")))
    item = F.when(key % 29 == 0, F.lit("")).otherwise(F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('"}')))
    shown = F.coalesce(F.concat(F.lit('"'), F.replace(after, F.lit("/en/api/"), F.lit("/api/")), F.lit('"')), F.lit("null"))
    payload = F.concat(F.lit('{"data": ['), item, F.lit('], "cursor": {"next": '), shown, F.lit("}}"))
    pages = rows.select(address(key).alias("url"), F.when(key % 31 == 0, 500).otherwise(200).alias("status"), payload.alias("payload"))
    return cursors.linked(pages, heads.select(F.col("o_custkey").alias("walk"), address(F.col("first")).alias("url")))


ARRIVED = """
arrived AS (
  SELECT event_id AS id, event_type AS store_id, (props->>'$.k')::INT AS sku, round(value * 100)::BIGINT AS cents, ts, (ts + INTERVAL 3 HOURS)::DATE AS day,
    ((epoch(ts)::BIGINT + CASE WHEN event_id % 17 = 0 THEN 777600 ELSE 0 END - epoch(TIMESTAMP '2024-01-01')::BIGINT) // 777600)::BIGINT AS batch FROM events),
clocks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTES AS clock FROM arrived GROUP BY batch),
judged AS (SELECT arrived.*, coalesce((day + 1)::TIMESTAMP - INTERVAL 3 HOURS <= clock, false) AS late FROM arrived JOIN clocks USING (batch)),
passed AS (SELECT max(ts) - INTERVAL 30 MINUTES AS clock FROM arrived)"""


@query(
    ARRIVED,
    """
SELECT store_id, sku, day, arg_max(cents, (ts, id)) AS close_cents, count(*) AS observations, 0::BIGINT AS late FROM judged, passed
WHERE NOT late AND (day + 1)::TIMESTAMP - INTERVAL 3 HOURS <= passed.clock GROUP BY ALL
UNION ALL
SELECT store_id, sku, day, NULL, NULL, count(*) FROM judged WHERE late GROUP BY ALL""",
)
def ledger_stream(t):
    """The events as they arrive, every 17th nine days late: the sealed days, and how many came after the seal of theirs."""
    seen = t.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    delay = F.when(F.col("id") % 17 == 0, 777_600).otherwise(0)
    second = F.rint(F.unix_micros("observed_at") / 1e6).cast("long")  # to the nearest one, as SQL casts
    dealt = seen.withColumn("delayed", second + delay - F.unix_seconds(F.expr("TIMESTAMP'2024-01-01'"))).withColumn("batch", F.expr("delayed div 777600")).drop("delayed")
    log = _commits(t, "ledger", ledger.ledger_tables(seen))
    first, last = dealt.agg(F.coalesce(F.min("batch"), F.lit(0)), F.coalesce(F.max("batch"), F.lit(-1))).first()
    for n in range(first, last + 1):  # a batch before 2024 has a number below 0, a commit has none
        log.publish(n - first, *ledger.ledger_rows(dealt.where(F.col("batch") == n).drop("batch"), log.last()))
    late = ledger.late_observations(log).groupBy("store_id", "sku", F.to_date(F.col("observed_at") + F.expr("INTERVAL 3 HOURS")).alias("day")).agg(F.count("*").alias("late"))
    closes = ledger.kept_closes(log).withColumn("late", F.lit(0).cast("long"))
    return closes.unionByName(late.select("store_id", "sku", "day", F.lit(None).cast("long").alias("close_cents"), F.lit(None).cast("long").alias("observations"), "late"))


@query(
    SNAPS, CLOSES, COVER, ROLLUPS, SALES,
    """
SELECT 'rollup' AS kind, store_id, NULL::INT AS sku, day, drops::BIGINT AS a, conf_sum::BIGINT AS b, conf_count::BIGINT AS c FROM rollups
UNION ALL SELECT 'sale', store_id, sku, day, units_sold::BIGINT, units_qty::BIGINT, rev_sold::BIGINT FROM daily
UNION ALL SELECT 'pair', store_id, sku, last_seen_any_at::DATE, last_cents::BIGINT, last_priced_cents::BIGINT, last_qty::BIGINT FROM cover""",
)
def kept_tables(t):
    """All readings in five batches, each with some of every time: what the kept tables have then."""
    snaps = t.snapshots
    log = _commits(t, "kept", kept.kept_tables(snaps))
    dealt = stored(snaps.select(*kept.READ).withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(5))), "kept-dealt", "batch")  # a batch's rows are read several times
    for n, rows in _batches(dealt, 5):
        kept.refreshed(log, rows, n)
        unstored(dealt, f"batch={n}")
    long = lambda *names: [F.col(name).cast("long").alias(as_) for name, as_ in zip(names, "abc")]
    rollups = kept.daily_rollups(log).select(F.lit("rollup").alias("kind"), "store_id", F.lit(None).cast("int").alias("sku"), "day", *long("drops", "conf_sum", "conf_count"))
    sales = kept.sales_daily(log).select(F.lit("sale").alias("kind"), "store_id", F.col("sku").cast("int").alias("sku"), "day", *long("units_sold", "units_qty", "rev_sold"))
    pairs = kept.coverage(log).select(F.lit("pair").alias("kind"), "store_id", F.col("sku").cast("int").alias("sku"), F.to_date("last_seen_any_at").alias("day"), *long("last_cents", "last_priced_cents", "last_qty"))
    return rollups.unionByName(sales).unionByName(pairs)


POSTED = """
posts AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'own.example' ELSE 'shop' || (p_partkey % 3) || '.example' END AS domain, n FROM part, range(2) AS r(n)),
taken AS (
  SELECT k, n, CASE WHEN k % 3 = 0 THEN 'S0' ELSE 'S' || (k % 3) END AS store_id, (5000 + (k * 7 + n * 100) % 900)::BIGINT AS list_cents,
    CASE WHEN k % 4 = 0 THEN (4000 + (k + n) % 900)::BIGINT END AS sale_cents, CASE WHEN k % 5 = 0 THEN 0 ELSE k % 60 END AS qty, (k % 9 = 0) AS said
  FROM posts WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0),
mirror AS (SELECT k, arg_max(list_cents, n) AS list_cents, arg_max(sale_cents, n) AS sale_cents, arg_max(qty, n) AS qty FROM taken WHERE k % 3 = 0 AND (k % 2 = 0 OR k % 7 = 0) GROUP BY k)"""


@query(
    POSTED,
    """
SELECT 'reading' AS kind, store_id, k::VARCHAR AS sku, n AS batch, coalesce(sale_cents, list_cents) AS cents, list_cents, qty::INT AS qty, said OR qty > 0 AS in_stock FROM taken
UNION ALL SELECT 'own', NULL, 'own-' || k, NULL, list_cents, sale_cents, qty::INT, NULL FROM mirror
UNION ALL SELECT CASE WHEN k % 11 = 0 THEN 'not an object' WHEN k % 13 = 0 THEN 'no sku' ELSE 'no price' END, domain, NULL, n, NULL, NULL, NULL, NULL FROM posts WHERE k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0""",
)
def ingest_chain(t):
    """Every product posted twice by its shop: what the ingest takes in, mirrors into the own catalogue by code or by sku, and rejects."""
    k, number = F.col("k"), F.col("k").cast("string")
    part = tables.table(t.spark, t.sf_dir, "part").select(F.col("p_partkey").alias("k"))
    code = F.concat(F.lit("52"), F.lpad(number, 11, "0"))
    own = part.where("k % 2 = 0 OR k % 7 = 0").select(F.concat(F.lit("own-"), number).alias("sku"), F.when(k % 7 == 0, code).alias("barcode"))
    money = lambda cents: F.format_string("%.2f SAR", cents / 100)
    mine = k % 3 == 0
    row = F.to_json(F.struct(
        F.when(k % 13 == 0, " ").when(mine & (k % 7 != 0), F.concat(F.lit("own-"), number)).otherwise(number).alias("sku"),
        F.when(k % 17 == 0, "-").otherwise(money(5000 + (k * 7 + F.col("batch") * 100) % 900)).alias("price"),
        F.when(k % 4 == 0, money(4000 + (k + F.col("batch")) % 900)).alias("sale_price"),
        F.when(k % 5 == 0, 0).otherwise(k % 60).alias("quantity"),
        F.when(k % 9 == 0, True).alias("in_stock"),
        F.when(mine & (k % 7 == 0), code).alias("barcode"),
    ))
    domain = F.when(mine, "own.example").otherwise(F.concat(F.lit("shop"), (k % 3).cast("string"), F.lit(".example")))
    posts = part.withColumn("batch", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        domain.alias("domain"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("store_id"), domain.alias("store_name"), F.lit("salla").alias("platform"),
        F.expr("timestampadd(DAY, batch, TIMESTAMP'2024-03-01 10:00:00')").alias("received_at"), k.cast("long").alias("place"), F.when(k % 11 == 0, "[]").otherwise(row).alias("row"), "batch",
    )
    log = _commits(t, "ingest", chain.tables(t.spark))
    for n, rows in _batches(posts, 2):
        chain.land(rows, own, ["own.example"], log, n)
    readings = log.read(chain.READINGS).select(
        F.lit("reading").alias("kind"), "store_id", F.regexp_replace("sku", "^own-", "").alias("sku"), F.col("born").alias("batch"), "cents", "list_cents", "qty", "in_stock"
    )
    mirror = log.read(chain.OWN).select(F.lit("own").alias("kind"), F.col("my_sku").alias("sku"), "cents", F.col("sale_cents").alias("list_cents"), "qty")
    rejects = log.read(chain.REJECTS).select(F.col("reason").alias("kind"), F.col("domain").alias("store_id"), F.col("born").alias("batch"))
    return readings.unionByName(mirror, allowMissingColumns=True).unionByName(rejects, allowMissingColumns=True)
