"""The registered queries of the reference's operators, with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifa.functions import numbers, text
from tarifa.operators import audits, discounts, estimates, insights, matching, orders, position, rollups, scanner
from tarifa.sources import tables
from tarifa.streaming import ledger

AS_OF, DAYS = datetime(2001, 11, 4), 730
QUERIES, ORACLE = {}, {}

# Shared beginnings of the SQL, in the order in which they build on each other.
SNAPS = """
snaps AS (
  SELECT l_partkey AS sku, r_name AS store_id, l_shipdate AS crawled_at,
    row_number() OVER w AS seq, round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::INT AS discount_pct,
    l_quantity::INT AS qty, (sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS sold,
    l_linestatus = 'O' AS in_stock, CASE l_returnflag WHEN 'A' THEN 95 WHEN 'N' THEN 88 ELSE 75 END AS confidence,
    round(round(l_extendedprice * 100)::BIGINT * 100 / (100 - round(l_discount * 100)::INT))::BIGINT AS list_cents
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WINDOW w AS (PARTITION BY l_partkey, r_name ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey))"""
STORES = "stores AS (SELECT r_name AS store_id, r_name = 'EUROPE' AS is_own, r_regionkey % 2 = 0 AS measurable FROM region)"
PRODUCTS = "products AS (SELECT p_partkey AS sku, p_name AS name, p_brand AS brand, p_type AS category FROM part)"
OWN = "own AS (SELECT p_partkey AS sku, round(p_retailprice * 100 * 35)::BIGINT AS cents FROM part WHERE p_partkey % 4 = 0)"
RECENT = "recent AS (SELECT * FROM snaps WHERE crawled_at >= TIMESTAMP '2001-11-04' - INTERVAL 730 DAYS AND confidence >= 85)"
LATEST = "latest AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) = 1)"
CLOSES = "closes AS (SELECT *, crawled_at::DATE AS day FROM snaps WHERE confidence >= 85 QUALIFY row_number() OVER (PARTITION BY sku, store_id, crawled_at::DATE ORDER BY crawled_at DESC, seq DESC) = 1)"
COVER = """
cover AS (
  SELECT sku, store_id, max(crawled_at) AS last_seen_any_at,
    max(crawled_at) FILTER (confidence >= 85) AS last_seen_at, arg_max(cents, (crawled_at, seq)) FILTER (confidence >= 85) AS last_cents,
    arg_max(confidence, (crawled_at, seq)) FILTER (confidence >= 85) AS last_confidence, arg_max(in_stock, (crawled_at, seq)) FILTER (confidence >= 85) AS last_in_stock,
    arg_max(qty, (crawled_at, seq)) FILTER (confidence >= 85) AS last_qty,
    max(crawled_at) FILTER (confidence >= 85 AND cents > 0) AS last_priced_at, arg_max(cents, (crawled_at, seq)) FILTER (confidence >= 85 AND cents > 0) AS last_priced_cents,
    max(crawled_at) FILTER (confidence >= 85 AND cents > 0 AND sold > 0) AS last_sold_pos_at,
    max(crawled_at) FILTER (confidence >= 85 AND cents > 0 AND qty > 0 AND qty <= 200) AS last_usable_qty_at
  FROM snaps GROUP BY sku, store_id)"""
ROLLUPS = """
drops AS (SELECT store_id, day, count(*) FILTER (cents < before) AS drops FROM (SELECT *, lag(cents) OVER (PARTITION BY sku, store_id ORDER BY day) AS before FROM closes) GROUP BY ALL),
trust AS (SELECT store_id, crawled_at::DATE AS day, sum(confidence)::BIGINT AS conf_sum, count(*) AS conf_count FROM snaps WHERE confidence >= 85 GROUP BY ALL),
rollups AS (SELECT store_id, day, coalesce(drops, 0) AS drops, coalesce(conf_sum, 0) AS conf_sum, coalesce(conf_count, 0) AS conf_count FROM drops FULL JOIN trust USING (store_id, day))"""
SALES = """
usable AS (SELECT *, CASE WHEN qty NOT IN (99, 100, 999, 1000, 9999, 10000, 99999, 100000) AND qty <= 200 THEN qty END AS valid FROM closes WHERE cents > 0),
stepped AS (
  SELECT *, sold - lag(sold) OVER w AS step, lag(qty) OVER w - qty AS raw,
    last_value(valid IGNORE NULLS) OVER (PARTITION BY sku, store_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - valid AS fall
  FROM usable WINDOW w AS (PARTITION BY sku, store_id ORDER BY day)),
daily AS (
  SELECT store_id, sku, day, units_sold, units_sold * cents AS rev_sold, units_qty, units_qty * cents AS rev_qty, qty_drop FROM (
    SELECT *, coalesce(least(greatest(step, 0), 50), 0)::BIGINT AS units_sold, coalesce(least(greatest(fall, 0), 30), 0)::BIGINT AS units_qty, coalesce(greatest(raw, 0), 0)::BIGINT AS qty_drop FROM stepped)
  WHERE units_sold > 0 OR units_qty > 0 OR qty_drop > 0),
pairs AS (
  SELECT store_id, sku, CASE WHEN sum(units_sold) > 0 THEN sum(units_sold) ELSE sum(units_qty) END::BIGINT AS units,
    CASE WHEN sum(units_sold) > 0 THEN sum(rev_sold) ELSE sum(rev_qty) END::BIGINT AS revenue, sum(qty_drop)::BIGINT AS qty_drop
  FROM daily WHERE day >= DATE '2001-11-04' - 730 GROUP BY store_id, sku)"""
SINCE = "TIMESTAMP '2001-11-04' - INTERVAL 730 DAYS"


class Tables:
    """The logical tables of a folder, for the queries below."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("snapshots", "products", "own_products", "stores", "orders", "observations", "catalogue", "own_catalogue", "store_meta", "links"):
            return getattr(tables, name)(self.spark, self.sf_dir)
        made = {
            "recent": lambda: rollups.windowed(self.snapshots, AS_OF, DAYS), "latest": lambda: rollups.latest(self.recent.drop("sold")), "cover": lambda: rollups.coverage(self.snapshots),
            "rollups": lambda: rollups.daily_rollups(self.snapshots), "daily": lambda: rollups.sales_daily(self.snapshots), "pairs": lambda: rollups.sales_pairs(self.daily, AS_OF, DAYS),
        }
        if name not in made:
            raise AttributeError(name)
        return made[name]()


def query(*parts: str):
    """Register a query; parts: the SQL's beginnings, then its end (none: SQL can't express it)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if parts:
            *shared, end = parts
            ORACLE[f.__name__] = ("WITH " + ",\n".join(shared) + "\n" if shared else "") + end
        return f

    return register


@query(SNAPS, RECENT, LATEST, "SELECT sku, store_id, crawled_at, cents, qty, in_stock, confidence FROM latest")
def latest_price_per_pair(t):
    return t.latest.select("sku", "store_id", "crawled_at", "cents", "qty", "in_stock", "confidence")


@query(SNAPS, COVER, "SELECT * FROM cover")
def coverage(t):
    return t.cover


@query(SNAPS, CLOSES, ROLLUPS, "SELECT * FROM rollups")
def price_drop_rollups(t):
    return t.rollups


@query(SNAPS, CLOSES, SALES, "SELECT * FROM daily")
def sales_daily(t):
    return t.daily


@query(SNAPS, CLOSES, SALES, "SELECT * FROM pairs")
def sales_pairs(t):
    return t.pairs


@query(
    SNAPS, CLOSES, COVER, ROLLUPS,
    f"""priced AS (SELECT sku, count(*) AS n, max(last_cents) - min(last_cents) AS spread FROM cover WHERE last_seen_at >= {SINCE} GROUP BY sku)""",
    """SELECT (SELECT coalesce(sum(drops), 0)::BIGINT FROM rollups WHERE day >= DATE '2001-11-04' - 730) AS price_drops,
      (SELECT sum(conf_sum) / sum(conf_count) FROM rollups WHERE day >= DATE '2001-11-04' - 730) AS mean_confidence,
      (SELECT count(*) FROM priced WHERE n < 3) AS gaps, (SELECT coalesce(median(spread), 0)::DOUBLE FROM priced WHERE spread > 0) AS median_spread_cents,
      count(*) AS pairs, count(*) FILTER (age <= 86400) AS today, count(*) FILTER (age > 86400 AND age <= 7 * 86400) AS this_week,
      count(*) FILTER (age > 7 * 86400 AND age <= 30 * 86400) AS this_month, count(*) FILTER (age > 30 * 86400) AS stale
    FROM (SELECT epoch(TIMESTAMP '2001-11-04') - epoch(last_seen_any_at) AS age FROM cover)""",
)
def insights_summary(t):
    return insights.summary(t.cover, t.rollups, AS_OF, DAYS)


@query(SNAPS, COVER, PRODUCTS, f"""SELECT sku, name, category, n_stores, round((5 - n_stores) * 100 / 5)::INT AS opportunity_score FROM (
  SELECT sku, count(*) AS n_stores FROM cover WHERE last_priced_at >= {SINCE} GROUP BY sku HAVING count(*) < 5 ORDER BY n_stores, sku LIMIT 15) JOIN products USING (sku)""")
def catalog_gaps_top(t):
    return insights.gaps(t.cover, t.products, 5, AS_OF, DAYS)


@query(SNAPS, COVER, PRODUCTS, f"""SELECT sku, name, n_stores, spread, spread * 100 / low AS spread_pct, prices FROM (
  SELECT sku, count(*) AS n_stores, min(last_priced_cents) AS low, max(last_priced_cents) - min(last_priced_cents) AS spread,
    string_agg(store_id || ':' || last_priced_cents, ',' ORDER BY store_id) AS prices
  FROM cover WHERE last_priced_at >= {SINCE} GROUP BY sku HAVING n_stores >= 3 ORDER BY spread * 100 / low DESC, sku LIMIT 10) JOIN products USING (sku)""")
def price_wars_top(t):
    return insights.price_wars(t.cover, t.products, AS_OF, DAYS)


@query(SNAPS, COVER, PRODUCTS, f"""SELECT sku, name, out_of_stock, in_stock FROM (
  SELECT sku, count(*) FILTER (NOT coalesce(last_in_stock, false)) AS out_of_stock, count(*) FILTER (coalesce(last_in_stock, false)) AS in_stock
  FROM cover WHERE last_seen_at >= {SINCE} GROUP BY sku) JOIN products USING (sku) WHERE out_of_stock > 0 AND in_stock > 0 ORDER BY out_of_stock DESC, sku LIMIT 15""")
def restock_candidates(t):
    return insights.restock(t.cover, t.products, AS_OF, DAYS)


@query(SNAPS, CLOSES, COVER, SALES, STORES, f"""SELECT store_id, products, in_stock, coalesce(units, 0)::BIGINT AS units, coalesce(revenue, 0)::BIGINT AS revenue,
  CASE WHEN coalesce(units, 0) > 0 THEN 'computed' WHEN with_signal = 0 THEN 'sales_data_unavailable' ELSE 'insufficient_history' END AS status,
  row_number() OVER (ORDER BY coalesce(revenue, 0) DESC, products DESC, store_id)::INT AS rank
FROM (SELECT store_id, count(*) AS products, count(*) FILTER (coalesce(last_in_stock, false)) AS in_stock, count(*) FILTER (last_sold_pos_at IS NOT NULL OR last_usable_qty_at IS NOT NULL) AS with_signal
      FROM cover WHERE last_priced_at >= {SINCE} GROUP BY store_id)
JOIN stores USING (store_id) LEFT JOIN (SELECT store_id, sum(units)::BIGINT AS units, sum(revenue)::BIGINT AS revenue FROM pairs GROUP BY store_id) USING (store_id) WHERE NOT is_own""")
def store_leaderboard(t):
    return insights.leaderboard(t.cover, t.pairs, t.stores, AS_OF, DAYS)


@query(SNAPS, CLOSES, SALES, PRODUCTS, """SELECT sku, name, brand, units, revenue FROM (SELECT sku, sum(units)::BIGINT AS units, sum(revenue)::BIGINT AS revenue FROM pairs GROUP BY sku)
JOIN products USING (sku) WHERE units > 0 ORDER BY units DESC, revenue DESC, sku LIMIT 20""")
def top_sellers(t):
    return insights.top_sellers(t.pairs, t.products)


@query(SNAPS, CLOSES, SALES, PRODUCTS, """SELECT category, sum(qty_drop)::BIGINT AS qty_drop, string_agg(sku::VARCHAR, ',' ORDER BY place) FILTER (place <= 5) AS first_products FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY qty_drop DESC, sku) AS place FROM (SELECT sku, sum(qty_drop) AS qty_drop FROM pairs GROUP BY sku) JOIN products USING (sku)) GROUP BY category""")
def trending_categories(t):
    return insights.trending(t.pairs, t.products)


@query(SNAPS, CLOSES, SALES, PRODUCTS, """SELECT brand, units, revenue, share_pct FROM (SELECT *, revenue * 100 / sum(revenue) OVER () AS share_pct FROM (
  SELECT CASE WHEN coalesce(trim(brand), '') = '' THEN 'Unknown' ELSE trim(brand) END AS brand, sum(units)::BIGINT AS units, sum(revenue)::BIGINT AS revenue FROM pairs JOIN products USING (sku) GROUP BY ALL))
ORDER BY revenue DESC, brand LIMIT 20""")
def brand_share(t):
    return insights.brand_share(t.pairs, t.products)


@query(SNAPS, f"""steps AS (SELECT *, lag(in_stock) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) AND NOT in_stock AS out FROM snaps WHERE crawled_at >= {SINCE}),
ends AS (SELECT sku, store_id, arg_min(cents, (crawled_at, seq)) AS first_cents, arg_max(cents, (crawled_at, seq)) AS last_cents, coalesce(bool_or(out), false) AS went_out FROM steps GROUP BY ALL)""",
"""SELECT * FROM (SELECT sku, store_id, first_cents, last_cents, went_out, CASE WHEN first_cents - last_cents >= 0.05::DOUBLE * first_cents THEN first_cents - last_cents END AS drop_cents FROM ends)
WHERE drop_cents IS NOT NULL OR went_out""")  # fmt: skip
def market_digest(t):
    return insights.digest(t.snapshots, AS_OF, DAYS)


@query(SNAPS, RECENT, LATEST, """SELECT store_id, count(DISTINCT sku) AS skus, count(*) FILTER (in_stock) * 100 / count(*) AS in_stock_pct, count(*) FILTER (discount_pct > 0) * 100 / count(*) AS discounted_pct,
  avg(discount_pct) FILTER (discount_pct > 0) AS avg_discount, sum(cents) / count(cents) AS avg_cents, count(DISTINCT sku) * 100 / (SELECT count(DISTINCT sku) FROM latest) AS catalog_share_pct FROM latest GROUP BY store_id""")
def report_market_share(t):
    return insights.market_share(t.latest)


@query(SNAPS, COVER, STORES, """SELECT store_id, max(last_seen_any_at) AS newest, count(*) FILTER (age < 1) AS today, count(*) FILTER (age BETWEEN 1 AND 6) AS this_week,
  count(*) FILTER (age BETWEEN 7 AND 29) AS this_month, count(*) FILTER (age >= 30) AS stale, count(sku) AS pairs
FROM (SELECT *, floor((epoch(TIMESTAMP '2001-11-04') - epoch(last_seen_any_at)) / 86400) AS age FROM stores LEFT JOIN cover USING (store_id)) GROUP BY store_id""")
def freshness_buckets(t):
    return insights.freshness(t.cover, t.stores, AS_OF)


@query(SNAPS, STORES, "SELECT crawled_at::DATE AS day, is_own, count(*) AS readings FROM snaps JOIN stores USING (store_id) GROUP BY ALL")
def snapshot_horizon(t):
    return insights.horizon(t.snapshots, t.stores)


@query(SNAPS, """marked AS (SELECT *, lag((cents, qty, in_stock, sold)) OVER (PARTITION BY sku, store_id, crawled_at::DATE ORDER BY crawled_at, seq) AS before FROM snaps)""",
       "SELECT sku, store_id, crawled_at, seq FROM marked WHERE before IS NULL OR before IS DISTINCT FROM (cents, qty, in_stock, sold)")
def change_only_rows(t):
    in_time = Window.partitionBy("sku", "store_id").orderBy("crawled_at", "seq")
    numbered = t.snapshots.withColumn("number", F.row_number().over(in_time))
    return rollups.changes(numbered).select("sku", "store_id", "crawled_at", F.col("number").alias("seq"))


ESTIMATED = """
steps AS (SELECT *, sold - lag(sold) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) AS step,
    CASE WHEN usable THEN last_value(CASE WHEN usable THEN qty END IGNORE NULLS) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - qty END AS fall
  FROM (SELECT *, qty NOT IN (99, 100, 999, 1000, 9999, 10000, 99999, 100000) AND qty <= 200 AS usable FROM recent)),
sums AS (SELECT sku, store_id, count(*) AS n, count(*) FILTER (usable) AS n_usable, max(sold) AS most, sum(cents) / count(*) AS mean_cents,
    coalesce(sum(least(step, 50)) FILTER (step > 0), 0) AS steps, coalesce(sum(fall) FILTER (fall > 0), 0) AS drops FROM steps GROUP BY ALL),
named AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_data' WHEN most > 0 AND steps > 0 THEN 'sold_count_diff' WHEN n_usable < 2 THEN 'insufficient_signal' WHEN drops < 1 THEN 'no_depletion' ELSE 'qty_positive_delta_sum' END AS method FROM sums),
united AS (SELECT *, CASE method WHEN 'sold_count_diff' THEN least(steps, 30 * 730) WHEN 'qty_positive_delta_sum' THEN least(drops, 30 * 730) ELSE 0 END::BIGINT AS units FROM named)"""


@query(SNAPS, RECENT, ESTIMATED, "SELECT sku, store_id, units, round(units * mean_cents)::BIGINT AS revenue, method FROM united")
def sales_estimate(t):
    return estimates.window_sales(t.snapshots, AS_OF, DAYS)


@query(SNAPS, RECENT, """steps AS (SELECT crawled_at::DATE AS day, cents, coalesce(least(greatest(sold - lag(sold) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq), 0), 30), 0) AS units FROM recent),
by_day AS (SELECT day, sum(units)::BIGINT AS units, sum(units * cents)::BIGINT AS revenue FROM steps GROUP BY day)""",
"""SELECT d.day, coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue FROM (SELECT unnest(generate_series(DATE '2001-11-04' - 730, DATE '2001-11-04', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN by_day USING (day)""")  # fmt: skip
def velocity_by_day(t):
    return estimates.velocity(t.snapshots, AS_OF, DAYS)


@query(SNAPS, RECENT, """steps AS (SELECT store_id, crawled_at, cents, coalesce(least(greatest(sold - lag(sold) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq), 0), 30), 0) AS units FROM recent)""",
"SELECT store_id, strftime(crawled_at, '%Y-W%W') AS week, sum(units)::BIGINT AS units, sum(units * cents)::BIGINT AS revenue FROM steps GROUP BY ALL")
def store_profile_weekly(t):
    return estimates.weekly(t.snapshots, AS_OF, DAYS)


@query(SNAPS, """placed AS (SELECT sku, cents, qty, in_stock, row_number() OVER (PARTITION BY sku ORDER BY crawled_at DESC, store_id DESC, seq DESC) AS n FROM snaps QUALIFY n <= 2),
two AS (SELECT sku, max(cents) FILTER (n = 1) AS cents, max(cents) FILTER (n = 2) AS c, max(qty) FILTER (n = 1) AS qty, max(qty) FILTER (n = 2) AS q,
  bool_or(in_stock) FILTER (n = 1) AS in_stock, bool_or(in_stock) FILTER (n = 2) AS i FROM placed GROUP BY sku HAVING count(*) = 2)""",
"SELECT sku, cents < c AS price_drop, in_stock AND NOT i AS back_in_stock, NOT in_stock AND i AS out_of_stock, qty < 10 AND q >= 10 AS low_stock FROM two")
def last_two_alerts(t):
    return audits.last_two_alerts(t.snapshots)


@query(SNAPS, RECENT, LATEST, OWN, """both_ AS (SELECT sku, o.cents AS own_cents, s.cents AS shown_cents FROM own o FULL JOIN (SELECT * FROM latest WHERE store_id = 'EUROPE') s USING (sku)),
ratios AS (SELECT *, CASE WHEN own_cents > 0 AND shown_cents > 0 THEN shown_cents / own_cents END AS r FROM both_)""",
"""SELECT sku, CASE WHEN shown_cents IS NULL THEN 'only_in_catalogue' WHEN own_cents IS NULL THEN 'only_in_store' ELSE 'both' END AS found,
  CASE WHEN r IS NULL THEN 'unusable' WHEN abs(r - 1.15::DOUBLE) <= 0.005::DOUBLE THEN 'with_vat' WHEN abs(r - 1) <= 0.005::DOUBLE THEN 'equal' ELSE 'other' END AS ratio FROM ratios""")  # fmt: skip
def price_audit(t):
    return audits.price_audit(t.own_products, t.latest.where(F.col("store_id") == tables.OWN_STORE))


@query(SNAPS, RECENT, """steps AS (SELECT sku, store_id, cents, coalesce(least(greatest(lag(qty) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) - qty, 0), 10), 0) AS units
  FROM recent WHERE qty NOT IN (99, 100, 999, 1000, 9999, 10000, 99999, 100000) AND qty <= 200)""",
"SELECT sku, store_id, count(*) AS n, sum(units)::BIGINT AS units, sum(units * cents)::BIGINT AS revenue FROM steps GROUP BY ALL HAVING count(*) >= 3")
def stock_velocity(t):
    return estimates.honest_velocity(t.snapshots, AS_OF, DAYS)


BADGES = """
badge_steps AS (SELECT *, exact - last_value(exact IGNORE NULLS) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step
  FROM (SELECT *, CASE WHEN sold % 7 <> 0 THEN sold % 300 END AS exact FROM snaps)),
badge_sums AS (SELECT sku, store_id, count(*) AS n, count(exact) AS n_exact, sum(least(step, 5000)) FILTER (step >= 0) AS units, count(*) FILTER (step < 0) AS resets, count(*) FILTER (step > 5000) AS clamped,
  arg_max(cents, (crawled_at, seq)) FILTER (cents > 0) AS price FROM badge_steps GROUP BY ALL),
badges AS (
SELECT sku, store_id, status, units, resets, clamped, units * price AS revenue FROM (SELECT sku, store_id, resets, clamped, price,
  CASE WHEN n_exact = 0 THEN 'all_capped' WHEN n_exact = 1 THEN 'baseline_only' ELSE 'measured_approx' END AS status, CASE WHEN n_exact > 1 THEN coalesce(units, 0)::BIGINT END AS units FROM badge_sums))"""


@query(SNAPS, BADGES, "SELECT * FROM badges")
def badge_velocity(t):
    return estimates.badge_velocity(t.snapshots.withColumn("capped", F.col("sold") % 7 == 0).withColumn("sold", F.col("sold") % 300))


RIVALS = "rivals AS (SELECT * FROM latest WHERE store_id <> 'EUROPE')"
POSITIONS = """
both_ AS (SELECT sku, cents, true AS mine FROM own UNION ALL SELECT sku, cents, false FROM rivals),
ranked AS (SELECT *, rank() OVER p AS rank, round(percent_rank() OVER p * 100, 1) AS percentile, count(*) OVER a AS sellers, min(cents) OVER a AS low, max(cents) OVER a AS high, median(cents) OVER a AS middle
  FROM both_ WHERE cents > 0 WINDOW p AS (PARTITION BY sku ORDER BY cents), a AS (PARTITION BY sku)),
positions AS (SELECT sku, cents, rank::INT AS rank, percentile, sellers, low, high, middle::DOUBLE AS middle, CASE WHEN cents = low THEN 'cheapest' WHEN cents = high THEN 'most_expensive' WHEN cents > middle THEN 'above_median' WHEN cents < middle THEN 'below_median' ELSE 'at_median' END AS tag
  FROM ranked WHERE mine AND sellers >= 2)"""


@query(SNAPS, RECENT, LATEST, OWN, RIVALS, POSITIONS, "SELECT * FROM positions")
def market_position(t):
    return position.market_position(t.own_products, t.latest.where(F.col("store_id") != tables.OWN_STORE))


@query(SNAPS, RECENT, LATEST, OWN, RIVALS, POSITIONS, """SELECT count(*) AS ranked, count(*) FILTER (tag = 'cheapest') AS cheapest, count(*) FILTER (tag = 'most_expensive') AS most_expensive,
  count(*) FILTER (tag = 'above_median') AS above_median, count(*) FILTER (tag = 'below_median') AS below_median, count(*) FILTER (tag = 'at_median') AS at_median, round(avg(percentile), 3) AS avg_percentile FROM positions""")
def market_position_summary(t):
    return position.position_summary(market_position(t))


METRICS = """metrics AS (SELECT sku, count(*) AS num_sellers, min(cents) AS low, max(cents) AS high, median(cents)::DOUBLE AS middle, sum(cents) / count(cents) AS mean,
  max(qty) AS most_qty, bool_or(in_stock) AS in_stock, round(avg(confidence), 1) AS confidence FROM latest GROUP BY sku)"""


@query(SNAPS, RECENT, LATEST, METRICS, "SELECT * FROM metrics")
def product_metrics(t):
    return position.product_metrics(t.latest)


@query(SNAPS, RECENT, LATEST, CLOSES, SALES, METRICS, OWN, """SELECT count(*) AS products, count(*) FILTER (num_sellers >= 1) AS matched, round(count(*) FILTER (num_sellers >= 1) * 100 / count(*), 1) AS coverage_pct,
  count(*) FILTER (cents <= low) AS cheapest, count(*) FILTER (cents > high) AS dearest, coalesce(sum(market_units), 0)::BIGINT AS market_units, coalesce(sum(my_units), 0)::BIGINT AS my_units,
  round(avg(coalesce(my_units, 0) * 100 / market_units) FILTER (num_sellers >= 1 AND market_units > 0), 3) AS share_pct
FROM own LEFT JOIN metrics USING (sku) LEFT JOIN (SELECT sku, sum(units) AS market_units, sum(units) FILTER (store_id = 'EUROPE') AS my_units FROM pairs GROUP BY sku) USING (sku)""")
def my_products_kpis(t):
    return position.kpis(t.own_products, position.product_metrics(t.latest), t.pairs, tables.OWN_STORE)


@query(SNAPS, """placed AS (SELECT *, row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) AS f, row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) AS l FROM snaps WHERE cents > 0),
means AS (SELECT sku, store_id, sum(cents) FILTER (f <= 3) / count(*) FILTER (f <= 3) AS first_mean, sum(cents) FILTER (l <= 3) / count(*) FILTER (l <= 3) AS last_mean FROM placed GROUP BY ALL)""",
"SELECT *, CASE WHEN (last_mean - first_mean) * 100 / first_mean > 3 THEN 'up' WHEN (last_mean - first_mean) * 100 / first_mean < -3 THEN 'down' ELSE 'stable' END AS trend FROM means")
def price_trend(t):
    return position.price_trend(t.snapshots)


@query(SNAPS, CLOSES, COVER, SALES, STORES, """parts AS (SELECT store_id, count(*) AS products, coalesce(1 - avg(standing) FILTER (others > 1), 0.5) AS price, avg(coalesce(last_in_stock, false)::INT) AS stock,
  avg((epoch(TIMESTAMP '2001-11-04') - epoch(last_seen_any_at) <= 48 * 3600)::INT) AS freshness FROM (SELECT *, percent_rank() OVER (PARTITION BY sku ORDER BY last_priced_cents) AS standing, count(*) OVER (PARTITION BY sku) AS others FROM cover WHERE last_priced_cents > 0 AND last_priced_at >= TIMESTAMP '2001-11-04' - INTERVAL 30 DAYS) GROUP BY store_id),
scored AS (SELECT store_id, coalesce(products, 0) AS products, CASE WHEN NOT is_own AND sold > 0 THEN sold END AS revenue,
  round(100 * (0.25::DOUBLE * (ln(1 + coalesce(products, 0)) / ln(1 + max(products) OVER ())) + 0.35::DOUBLE * coalesce(price, 0) + 0.25::DOUBLE * coalesce(stock, 0) + 0.15::DOUBLE * coalesce(freshness, 0)), 3) AS score
  FROM stores LEFT JOIN parts USING (store_id) LEFT JOIN (SELECT store_id, sum(revenue)::BIGINT AS sold FROM pairs GROUP BY store_id) USING (store_id))""",
"SELECT *, row_number() OVER (ORDER BY revenue DESC NULLS LAST, score DESC, products DESC, store_id)::INT AS rank FROM scored")
def store_ranking(t):
    return position.store_ranking(t.cover, t.stores, t.pairs, AS_OF)


@query(SNAPS, RECENT, CLOSES, SALES, STORES, """newest AS (SELECT *, list_cents - cents AS saving FROM recent WHERE discount_pct > 0 AND list_cents > cents QUALIFY row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) = 1),
first_ AS (SELECT * FROM newest ORDER BY discount_pct DESC, saving DESC, sku, store_id LIMIT 50),
plain AS (SELECT sku, store_id, max((crawled_at, seq)) AS at FROM recent WHERE discount_pct <= 0 GROUP BY ALL),
streak AS (SELECT r.sku, r.store_id, min(crawled_at) AS started_at FROM recent r LEFT JOIN plain p ON r.sku = p.sku AND r.store_id = p.store_id WHERE p.at IS NULL OR (crawled_at, seq) > p.at GROUP BY ALL),
sold AS (SELECT d.sku, d.store_id, sum(units_sold) AS s, sum(units_qty) AS q FROM daily d JOIN streak k ON d.sku = k.sku AND d.store_id = k.store_id WHERE d.day >= k.started_at::DATE GROUP BY ALL)""",
"""SELECT f.sku, f.store_id, cents, list_cents, discount_pct, saving, started_at, coalesce(floor((epoch(TIMESTAMP '2001-11-04') - epoch(started_at)) / 86400), 0)::BIGINT AS days_on_discount,
  CASE WHEN NOT measurable OR started_at IS NULL THEN NULL ELSE coalesce(CASE WHEN s > 0 THEN s ELSE q END, 0)::BIGINT END AS units
FROM first_ f JOIN stores USING (store_id) LEFT JOIN streak k ON f.sku = k.sku AND f.store_id = k.store_id LEFT JOIN sold x ON f.sku = x.sku AND f.store_id = x.store_id""")  # fmt: skip
def discounts_top_pct(t):
    return discounts.deepest(t.snapshots, t.daily, t.stores, AS_OF, DAYS)


@query(SNAPS, RECENT, "SELECT store_id, strftime(crawled_at, '%Y-W%V') AS week, count(*) AS n, round(avg(discount_pct), 3) AS avg_discount FROM recent WHERE discount_pct > 0 GROUP BY ALL")
def discount_timeline(t):
    return discounts.timeline(t.snapshots, AS_OF, DAYS)


@query(SNAPS, RECENT, STORES, """by_sku AS (SELECT store_id, sku, avg(discount_pct) FILTER (discount_pct > 0) AS depth, max(discount_pct) AS most, count(*) FILTER (discount_pct > 0) AS hits, count(*) AS n FROM recent GROUP BY ALL),
by_store AS (SELECT store_id, avg(depth) AS depth, count(depth) AS skus, max(most) AS most, sum(hits) * 100 / sum(n) AS frequency FROM by_sku GROUP BY ALL)""",
"""SELECT store_id, round(coalesce(depth, 0), 3) AS avg_depth, coalesce(skus, 0) AS skus, coalesce(most, 0) AS max_discount, round(coalesce(frequency, 0), 3) AS frequency,
  round(least(100.0::DOUBLE, 0.4::DOUBLE * coalesce(depth, 0) + 0.35::DOUBLE * coalesce(frequency, 0) + 0.25::DOUBLE * coalesce(most, 0)), 2) AS score FROM stores LEFT JOIN by_store USING (store_id)""")  # fmt: skip
def discount_aggression(t):
    return discounts.aggression(t.snapshots, t.stores, AS_OF, DAYS)


@query(SNAPS, RECENT, OWN, """newest AS (SELECT *, max(cents) OVER (PARTITION BY sku, store_id) AS most FROM (SELECT *, max(crawled_at) OVER (PARTITION BY sku, store_id) AS newest FROM recent WHERE sku IN (SELECT sku FROM own)) WHERE crawled_at = newest AND cents > 0),
listed AS (SELECT sku, store_id, min(cents) FILTER (cents >= 0.25::DOUBLE * most) AS cents, count(*) FILTER (cents < 0.25::DOUBLE * most) AS variants, max(qty) AS qty FROM newest GROUP BY ALL),
low AS (SELECT sku, count(*) AS sellers, bool_or(store_id = 'EUROPE') AS has_own, min(cents) FILTER (store_id <> 'EUROPE') AS low, round(sum(cents) FILTER (store_id <> 'EUROPE') / count(*) FILTER (store_id <> 'EUROPE'), 3) AS mean FROM listed GROUP BY sku),
middles AS (SELECT l.sku, median(cents) AS middle FROM listed l JOIN low USING (sku) WHERE store_id <> 'EUROPE' AND cents <> low GROUP BY l.sku),
scored AS (SELECT l.*, low, mean, sellers, coalesce(low < 0.25::DOUBLE * middle, false) AS odd_low, round((cents - low) * 100 / low, 2) AS gap_pct FROM listed l JOIN low USING (sku) LEFT JOIN middles USING (sku) WHERE has_own AND sellers >= 2)""",
"""SELECT sku, store_id, cents, low, mean, sellers, variants, odd_low, gap_pct, CASE WHEN gap_pct >= 25 THEN 'overpriced_risk' WHEN cents - low >= 50000 AND qty > 0 THEN 'quick_win' ELSE 'overpriced' END AS badge FROM scored WHERE gap_pct >= 10""")  # fmt: skip
def scanner_opportunities(t):
    return scanner.opportunities(t.snapshots, t.own_products, tables.OWN_STORE, AS_OF, DAYS)


@query("""SELECT count(*) AS orders, sum(units)::BIGINT AS units, sum(revenue)::BIGINT AS revenue FROM (
  SELECT o_orderkey, coalesce(sum(l_quantity::BIGINT), 0) AS units, coalesce(sum(round(l_extendedprice * 100)::BIGINT), 0) AS revenue FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey)""")
def orders_revenue(t):
    return orders.totals(t.orders)


@query("SELECT l_partkey AS sku, sum(l_quantity::BIGINT)::BIGINT AS units, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY l_partkey")
def orders_by_sku(t):
    return orders.by_sku(t.orders)


TESTED = """tested AS (SELECT p.store_id, p.sku, category, units, revenue, l.cents FROM pairs p JOIN products USING (sku) JOIN latest l ON l.sku = p.sku AND l.store_id = p.store_id),
sums AS (SELECT category, store_id, sum(units) AS s, count(*) AS n FROM tested GROUP BY ALL), totals AS (SELECT category, sum(s) AS ts, sum(n) AS tn FROM sums GROUP BY ALL),
overall AS (SELECT store_id, sum(s) AS ss, sum(n) AS sn, (SELECT sum(ts) FROM totals) AS gs, (SELECT sum(tn) FROM totals) AS gn FROM sums GROUP BY ALL),
rates AS (SELECT t.category, o.store_id, CASE WHEN tn - coalesce(n, 0) >= 30 THEN (ts - coalesce(s, 0)) / (tn - coalesce(n, 0)) WHEN gn > sn THEN (gs - ss) / (gn - sn) END AS rate
  FROM totals t CROSS JOIN overall o LEFT JOIN sums s ON s.category = t.category AND s.store_id = o.store_id)"""


@query(SNAPS, RECENT, LATEST, CLOSES, SALES, PRODUCTS, TESTED, """SELECT store_id, actual, estimated, round((estimated - actual) * 100 / actual, 1) AS error_pct FROM (
  SELECT store_id, sum(revenue)::BIGINT AS actual, (round(sum(rate * cents) / 100) * 100)::BIGINT AS estimated FROM tested JOIN rates USING (category, store_id) GROUP BY store_id)""")
def revenue_back_test(t):
    sales = t.pairs.join(t.products, "sku").join(t.latest.select("sku", "store_id", "cents"), ["sku", "store_id"])
    return estimates.back_test(sales, 30)


CLOSE_DAYS = """closes AS (SELECT event_type AS store_id, (props->>'$.k')::INT AS sku, (ts + INTERVAL 3 HOURS)::DATE AS day, arg_max(round(value * 100)::BIGINT, (ts, event_id)) AS close_cents, count(*) AS observations FROM events GROUP BY ALL)"""


@query(CLOSE_DAYS, "SELECT * FROM closes")
def ledger_day_close(t):
    return ledger.day_closes(t.observations)


@query(CLOSE_DAYS, """known AS (SELECT store_id, sku, min(day) AS first_day FROM closes GROUP BY ALL),
grid AS (SELECT store_id, day FROM (SELECT DISTINCT store_id FROM known), (SELECT DISTINCT day FROM closes)),
seen AS (SELECT store_id, day, count(*) AS seen, count(*) FILTER (day = first_day) AS first_seen FROM closes JOIN known USING (store_id, sku) GROUP BY ALL),
counted AS (SELECT g.store_id, g.day, coalesce(seen, 0) AS seen, coalesce(first_seen, 0) AS first_seen, (SELECT count(*) FROM known k WHERE k.store_id = g.store_id AND k.first_day < g.day) AS known FROM grid g LEFT JOIN seen USING (store_id, day))""",
"SELECT store_id, day, seen, first_seen, known - (seen - first_seen) AS absent, CASE WHEN seen = 0 THEN 'no_data' WHEN seen < 0.5 * known THEN 'partial' ELSE 'ok' END AS status FROM counted")
def ledger_store_day(t):
    return ledger.store_days(ledger.day_closes(t.observations))


def _catalogues(t):
    code = F.lit(5_200_000_000_000) + F.col("sku")
    own = t.own_products.join(t.products.select("sku", "name"), "sku").withColumn("barcode", code.cast("string"))
    theirs = F.when(F.col("sku") % 3 == 0, F.concat(F.lit("0"), code.cast("string"))).when(F.col("sku") % 3 == 1, F.concat(code.cast("string"), F.lit("carton"))).otherwise("4021")
    rivals = t.latest.where(F.col("store_id") != tables.OWN_STORE).join(t.products.select("sku", "name"), "sku").withColumn("barcode", theirs)
    return own, rivals.select("sku", "store_id", "barcode", "name", "cents")


MATCHED = """mine AS (SELECT own.sku AS my_sku, own.cents AS my_cents, name AS my_name FROM own JOIN products USING (sku)),
theirs AS (SELECT sku AS rival_sku, store_id, cents AS rival_cents FROM rivals),
level1 AS (SELECT *, 99 AS confidence, 'barcode' AS method FROM mine JOIN theirs ON my_sku = rival_sku WHERE rival_sku % 3 <> 2 AND greatest(my_cents, rival_cents)::DOUBLE / least(my_cents, rival_cents) < 6.0::DOUBLE),
level2 AS (SELECT *, 95 AS confidence, 'sku' AS method FROM mine JOIN theirs ON my_sku = rival_sku WHERE my_sku NOT IN (SELECT my_sku FROM level1)),
matched AS (SELECT my_sku, rival_sku, store_id, my_cents, rival_cents, confidence, method, round((rival_cents - my_cents) * 100 / my_cents, 1) AS diff_pct,
  CASE WHEN rival_cents > my_cents THEN 'cheaper' WHEN rival_cents = my_cents THEN 'equal' ELSE 'expensive' END AS position FROM (SELECT * FROM level1 UNION ALL SELECT * FROM level2))"""


@query(SNAPS, RECENT, LATEST, OWN, PRODUCTS, RIVALS, MATCHED, "SELECT *, CASE WHEN method = 'sku' AND abs(diff_pct) > 40 THEN 'SUSPICIOUS_PRICE' ELSE '' END AS flags FROM matched")
def barcode_matches(t):
    return matching.matches(*_catalogues(t))


@query(SNAPS, RECENT, LATEST, OWN, PRODUCTS, RIVALS, MATCHED, """SELECT my_sku, store_id, rival_cents, my_cents, round((my_cents - rival_cents) * 100 / rival_cents, 1) AS gap_pct
FROM (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY my_sku ORDER BY rival_cents, store_id) = 1) WHERE round((my_cents - rival_cents) * 100 / rival_cents, 1) > 15""")
def price_alerts(t):
    return matching.price_alerts(barcode_matches(t))


# All of lineitem with its own keys. Rivals are below 0, so that they never meet a product's key.
@query("edges AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem)", """SELECT a AS my_sku, b AS other_sku, unnest(['direct', 'hub']) AS relation FROM edges UNION ALL SELECT b, a, 'reverse' FROM edges""")
def seller_set_hubs(t):
    lines = tables.table(t.spark, t.sf_dir, "lineitem")
    return matching.seller_hubs(lines.select(F.col("l_partkey").alias("my_sku"), (-1 - F.col("l_suppkey")).alias("rival_sku")))


@query("""SELECT event_id, (ts + INTERVAL 3 HOURS)::DATE AS ksa_day, strftime(ts, '%Y-W%V') AS iso_week, strftime(ts, '%Y-W%W') AS monday_week FROM events""")
def calendar_labels(t):
    rows = tables.table(t.spark, t.sf_dir, "events")
    return rows.select("event_id", numbers.ksa_day(F.col("ts")).alias("ksa_day"), numbers.year_iso_week(F.col("ts")).alias("iso_week"), numbers.monday_week(F.col("ts")).alias("monday_week"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT in_stock THEN 'OOS' WHEN qty <= 0 THEN 'AVAIL' WHEN qty < 10 THEN 'LOW' WHEN qty <= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS signal
FROM (SELECT *, l_linestatus = 'O' AS in_stock, l_quantity::INT AS qty FROM lineitem)""")
def stock_signals(t):
    rows = tables.table(t.spark, t.sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.stock_signal(F.col("l_linestatus") == "O", F.col("l_quantity").cast("int")).alias("signal"))


LABELS = """labels(place, category, form, animal, brand, pack, grams) AS (VALUES
  (0, 'cat_food', 'cat_food_dry', 'cat', 'Royal Canin', 1, 400), (1, 'cat_food', 'cat_food_dry', 'cat', 'Royal Canin', 24, 400), (2, 'dog_food', 'dog_food_wet', 'dog', 'Pedigree', 1, 100), (3, 'dog_food', 'dog_food_wet', 'dog', 'Pedigree', 12, NULL),
  (4, 'dog_food', 'dog_treats', 'dog', '', 1, 5000), (5, 'litter', NULL, 'cat', '', 1, 10000), (6, 'accessories', NULL, 'dog', '', 1, NULL), (7, 'toys', NULL, 'other', 'Kong', 1, NULL),
  (8, 'bird_food', NULL, 'bird', '', 1, 1500), (9, 'fish_food', NULL, 'fish', 'Tetra', 1, 100), (10, 'grooming', NULL, 'cat', '', 1, 250), (11, 'healthcare', NULL, 'small', '', 1, NULL),
  (12, 'dog_food', NULL, 'dog', '', -1, NULL), (13, 'cat_food', NULL, 'cat', 'Whiskas', 1, 85), (14, 'dog_food', NULL, 'dog', 'Acana', 24, NULL), (15, 'accessories', NULL, 'small', '', 1, 2000))"""


@query(LABELS, "SELECT p_partkey AS sku, category, form, animal, brand, pack, grams::DOUBLE AS grams FROM part JOIN labels ON place = (p_partkey // 4) % 16")
def product_labels(t):
    n = F.col("name")
    rows = t.catalogue.withColumn("category", text.category(n))
    return rows.select("sku", "category", text.food_form(F.col("category"), n).alias("form"), text.animal(n).alias("animal"), text.brand(n).alias("brand"), text.pack_quantity(n).alias("pack"), text.weight_grams(n).alias("grams"))


@query("SELECT page_id, lower(regexp_extract(url, '^(?:[a-z]+://)?(?:www\\.)?([^/?#:]+)', 1, 'i')) AS domain FROM pages")
def page_domains(t):
    return tables.table(t.spark, t.sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))
