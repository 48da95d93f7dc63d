"""Queries on price intelligence, revenue, profiles and audits, and their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tarifa.operators import admin, audits, catalogue, discounts, estimates, insights, intel, orders, position, revenue, rollups
from tarifa.plans.catalogue import BASE, CATALOGUE, LINKS, META, OWN_ROWS, PACKS, SELLERS
from tarifa.plans.oracles import AS_OF, BADGES, CLOSES, COVER, DAYS, ESTIMATED, LATEST, ORACLE, OWN, PRODUCTS, RECENT, RIVALS, SALES, SINCE, SNAPS, STORES, query, revenue_back_test
from tarifa.session import stored, stored_in_turn, unstored
from tarifa.sources import tables

INTEL = """
mine AS (SELECT sku AS my_sku, coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) AS my_cents, coalesce(qty, 0) AS my_qty FROM own_rows),
live AS (SELECT l.*, l.confidence >= 75 AS verified, n.cents AS rival_cents, n.in_stock FROM links l LEFT JOIN latest n ON n.sku = l.rival_sku AND n.store_id = l.store_id AND n.cents > 0),
sums AS (SELECT my_sku, verified, count(DISTINCT store_id) AS sellers, count(rival_cents) AS live, count(*) FILTER (NOT in_stock) AS out, min(rival_cents) AS low,
  CASE WHEN count(rival_cents) > 0 THEN arg_min((store_id, confidence, method), (rival_cents, store_id)) FILTER (rival_cents IS NOT NULL) ELSE arg_max((store_id, confidence, method), (confidence, store_id)) END AS pick FROM live GROUP BY ALL),
intel AS (SELECT my_sku, verified, my_cents, sellers, pick[1] AS store_id, low AS cheapest_cents, round((my_cents - low) * 100 / low, 1) AS diff_pct, CASE WHEN live > 0 THEN 'live' ELSE 'stale' END AS price_status, pick[2] AS confidence, pick[3] AS method,
  CASE WHEN round((my_cents - low) * 100 / low, 1) > 15 THEN 'red' WHEN round((my_cents - low) * 100 / low, 1) > 5 THEN 'yellow' END AS severity, CASE WHEN my_cents <= low THEN low - my_cents END AS saving_cents, live > 0 AND out = live AND my_qty > 0 AS competitor_oos
  FROM sums JOIN mine USING (my_sku))"""


@query(*BASE, INTEL, "SELECT * FROM intel")
def price_intel_table(t):
    return intel.in_order(intel.table(t.own_catalogue, t.links, t.latest))


@query(*BASE, INTEL, """SELECT count(*) FILTER (verified) AS matched_products, count(*) FILTER (NOT verified) AS unverified_products, count(*) FILTER (verified AND severity = 'red') AS overpriced_red, count(*) FILTER (verified AND severity = 'yellow') AS overpriced_yellow,
  count(*) FILTER (verified AND saving_cents IS NOT NULL) AS cheapest_count, count(*) FILTER (verified AND competitor_oos) AS oos_opportunities, count(*) FILTER (verified AND price_status = 'stale') AS rows_without_live_price FROM intel""")
def price_intel_summary(t):
    return intel.summary(intel.table(t.own_catalogue, t.links, t.latest))


@query(OWN_ROWS, META, LINKS, """SELECT label, count(*) AS matches FROM (SELECT CASE WHEN confirmed THEN 'confirmed_100' WHEN confidence = 99 AND method = 'barcode' THEN 'barcode_99' WHEN confidence = 95 AND method = 'sku' THEN 'sku_95'
  WHEN confidence = 85 THEN 'name_85' WHEN confidence = 80 THEN 'name_80' WHEN confidence = 70 THEN 'name_70' END AS label FROM links) WHERE label IS NOT NULL GROUP BY label""")
def match_confidence_distribution(t):
    return intel.confidence_distribution(t.links)


@query(*BASE, """mine AS (SELECT sku AS my_sku, coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) AS my_cents FROM own_rows),
seen AS (SELECT sku, store_id, max(crawled_at) AS last_crawled_at FROM snaps WHERE crawled_at >= TIMESTAMP '2001-11-04' - INTERVAL 730 DAYS GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) AS f, row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) AS l FROM snaps WHERE crawled_at >= TIMESTAMP '2001-11-04' - INTERVAL 730 DAYS AND cents <> 0),
means AS (SELECT sku, store_id, sum(cents) FILTER (f <= 3) / count(*) FILTER (f <= 3) AS older, sum(cents) FILTER (l <= 3) / count(*) FILTER (l <= 3) AS recent FROM placed GROUP BY ALL)""",
"""SELECT my_sku, rival_sku, k.store_id, my_cents, n.cents AS rival_cents, CASE WHEN n.cents IS NOT NULL THEN coalesce(n.in_stock, false) END AS rival_in_stock, CASE WHEN n.cents IS NULL THEN 'stale' ELSE 'live' END AS price_status, n.cents - my_cents AS diff_cents,
  CASE WHEN my_cents > 0 THEN round((n.cents - my_cents) * 100 / my_cents, 1) END AS diff_pct, CASE WHEN n.cents > my_cents THEN 'cheaper' WHEN n.cents = my_cents THEN 'equal' WHEN n.cents < my_cents THEN 'expensive' END AS position,
  CASE WHEN recent > older * 1.03::DOUBLE THEN 'rising' WHEN recent < older * 0.97::DOUBLE THEN 'falling' ELSE 'stable' END AS price_trend, last_crawled_at
FROM links k JOIN mine USING (my_sku) LEFT JOIN latest n ON n.sku = k.rival_sku AND n.store_id = k.store_id AND n.cents > 0 LEFT JOIN seen s ON s.sku = k.rival_sku AND s.store_id = k.store_id LEFT JOIN means m ON m.sku = k.rival_sku AND m.store_id = k.store_id""")  # fmt: skip
def price_intel_cards(t):
    return intel.cards(t.own_catalogue, t.links, t.latest, t.snapshots.drop("sold"), AS_OF, DAYS)


DECIDED = """decided AS (SELECT my_sku, rival_sku, store_id, CASE WHEN confirmed OR (my_sku % 44 = 0 AND store_id = 'ASIA') THEN 100 ELSE confidence END AS confidence, method, confirmed OR (my_sku % 44 = 0 AND store_id = 'ASIA') AS confirmed FROM links WHERE my_sku % 36 <> 0)"""


def _decided(t):
    return intel.decided(t.links, t.links.where("my_sku % 44 = 0 AND store_id = 'ASIA'"), t.links.where("my_sku % 36 = 0"))


@query(OWN_ROWS, META, LINKS, DECIDED, "SELECT * FROM decided")
def match_decisions(t):
    return _decided(t)


@query(OWN_ROWS, META, LINKS, DECIDED, """SELECT * FROM decided WHERE confirmed UNION ALL SELECT my_sku, rival_sku, store_id, confidence, 'rerun', false FROM links l WHERE my_sku % 3 = 0 AND NOT EXISTS (SELECT 1 FROM decided d WHERE d.confirmed AND d.my_sku = l.my_sku AND d.rival_sku = l.rival_sku AND d.store_id = l.store_id)""")
def matches_after_rerun(t):
    fresh = t.links.where("my_sku % 3 = 0").withColumn("method", F.lit("rerun")).withColumn("confirmed", F.lit(False))
    return intel.rematched(_decided(t), fresh)


@query(*BASE, INTEL, """SELECT count(*) FILTER (diff_pct < 0) AS cheaper, count(*) FILTER (diff_pct = 0) AS equal, count(*) FILTER (diff_pct > 0) AS expensive, count(DISTINCT my_sku) AS matched_skus, (SELECT count(*) FROM (SELECT DISTINCT rival_sku, store_id FROM links)) AS rival_rows
  FROM intel WHERE verified AND price_status = 'live'""")
def report_position_summary(t):
    return intel.report_summary(intel.table(t.own_catalogue, t.links, t.latest), t.links)


# Revenue. The window is the two years that the other queries have.
SEEN = f"""
shown AS (SELECT store_id, c.sku, last_priced_cents AS cents, category FROM cover c JOIN products p USING (sku) WHERE last_priced_at >= {SINCE} AND last_priced_cents > 0),
seen AS (SELECT s.*, coalesce(units, 0) AS units FROM shown s JOIN stores t USING (store_id) LEFT JOIN pairs p ON p.store_id = s.store_id AND p.sku = s.sku WHERE measurable AND NOT is_own),
of_sku AS (SELECT sku, sum(units) / count(*) AS v FROM seen GROUP BY sku), of_category AS (SELECT category, sum(units) / count(*) AS v FROM seen GROUP BY category HAVING count(*) >= 30),
rated AS (SELECT s.*, k.v AS a, c.v AS b, (SELECT sum(units) / count(*) FROM seen) AS g FROM shown s LEFT JOIN of_sku k ON k.sku = s.sku LEFT JOIN of_category c ON c.category = s.category),
estimated AS (SELECT store_id, (round(sum(coalesce(a, b, g) * cents) / 100) * 100)::BIGINT AS revenue_est, count(a) AS per_sku, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS per_category, count(*) FILTER (a IS NULL AND b IS NULL AND g IS NOT NULL) AS per_global FROM rated GROUP BY store_id)"""
MONEY = (SNAPS, CLOSES, COVER, SALES, STORES, PRODUCTS, SEEN)


def _estimates(t, cover=None, pairs=None):
    cover, pairs = t.cover if cover is None else cover, t.pairs if pairs is None else pairs
    return revenue.estimates(revenue.priced(cover, t.products, AS_OF, DAYS), revenue.observed(cover, pairs, t.products, t.stores, AS_OF, DAYS))


@query(*MONEY, """SELECT *, per_sku + per_category + per_global AS priced_products, CASE WHEN (per_sku + per_category) / (per_sku + per_category + per_global) >= 0.8 THEN 'high' WHEN (per_sku + per_category) / (per_sku + per_category + per_global) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  round(revenue_est * 50 / 100)::BIGINT AS range_low, round(revenue_est * 150 / 100)::BIGINT AS range_high, round(per_sku / (per_sku + per_category + per_global), 4) AS coverage FROM estimated""")
def store_revenue_estimates(t):
    return _estimates(t)


BADGE_MONEY = """badge_money AS (SELECT store_id, coalesce(sum(revenue) FILTER (status = 'measured_approx'), 0)::BIGINT AS revenue, count(*) FILTER (status = 'measured_approx' AND revenue IS NOT NULL) AS products_measured, count(*) FILTER (status = 'baseline_only') AS products_baseline_only,
  count(*) FILTER (status = 'all_capped') AS products_capped, count(*) AS products_total, round(count(*) FILTER (status = 'measured_approx' AND revenue IS NOT NULL) * 100 / count(*), 1) AS coverage_pct, count(*) FILTER (status = 'measured_approx' AND revenue IS NOT NULL) > 0 AS usable FROM badges GROUP BY store_id)"""


#: Parts of the pairs that store_revenue_axis takes in turn.
AXIS_PARTS = 4


def _badge_readings(t):
    return _with_badges(t.snapshots)


def _with_badges(snaps):
    return snaps.withColumn("capped", F.col("sold") % 7 == 0).withColumn("sold", F.col("sold") % 300)


@query(SNAPS, BADGES, BADGE_MONEY, "SELECT * FROM badge_money")
def badge_revenue_by_store(t):
    return revenue.badge_revenue(estimates.badge_velocity(_badge_readings(t)))


@query(SNAPS, BADGES, META, """shown AS (SELECT store_id, sku, bool_or(sold % 300 > 0) AS has_badge, bool_or(sold % 7 = 0) AS capped FROM snaps GROUP BY ALL),
per AS (SELECT store_id, count(*) AS products_seen, count(*) FILTER (has_badge) AS products_with_badge, count(*) FILTER (capped) AS products_with_capped_reading FROM shown GROUP BY ALL),
done AS (SELECT store_id, count(*) FILTER (status = 'measured_approx') AS products_diffable, count(*) FILTER (status = 'baseline_only') AS products_baseline_only, coalesce(sum(units) FILTER (status = 'measured_approx'), 0)::BIGINT AS units_in_window FROM badges GROUP BY ALL)""",
"""SELECT store_id, platform, coalesce(products_seen, 0) AS products_seen, coalesce(products_with_badge, 0) AS products_with_badge, coalesce(products_with_capped_reading, 0) AS products_with_capped_reading, coalesce(products_diffable, 0) AS products_diffable,
  coalesce(products_baseline_only, 0) AS products_baseline_only, coalesce(units_in_window, 0) AS units_in_window, CASE WHEN products_diffable > 0 THEN 'measured_approx' WHEN products_with_badge > 0 THEN 'awaiting_second_crawl' ELSE 'no_badge_stays_estimated' END AS verdict
FROM meta LEFT JOIN per USING (store_id) LEFT JOIN done USING (store_id)""")  # fmt: skip
def badge_coverage(t):
    readings = _badge_readings(t)
    return revenue.badge_coverage(readings, estimates.badge_velocity(readings), t.store_meta)


@query(*MONEY, BADGES, BADGE_MONEY, f"""signals AS (SELECT store_id, count(*) AS products, bool_or(last_sold_pos_at IS NOT NULL) AS sold_sig, bool_or(last_usable_qty_at IS NOT NULL) AS qty_sig FROM cover WHERE last_priced_at >= {SINCE} AND last_priced_cents > 0 GROUP BY store_id),
ledger AS (SELECT sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
joined AS (SELECT t.store_id, products, is_own, measurable, sold_sig, qty_sig, CASE WHEN is_own THEN (SELECT revenue FROM ledger) WHEN measurable AND sold > 0 THEN sold END AS exact, CASE WHEN NOT is_own AND usable AND m.revenue > 0 THEN m.revenue END AS approx, revenue_est
  FROM stores t JOIN signals USING (store_id) LEFT JOIN (SELECT store_id, sum(revenue)::BIGINT AS sold FROM pairs GROUP BY store_id) USING (store_id) LEFT JOIN badge_money m USING (store_id) LEFT JOIN estimated USING (store_id)),
based AS (SELECT *, CASE WHEN NOT is_own AND NOT measurable AND approx IS NULL AND revenue_est > 0 THEN revenue_est END AS guess FROM joined)""",
"""SELECT store_id, products, CASE WHEN is_own THEN CASE WHEN exact IS NOT NULL THEN 'ledger' ELSE 'accumulating' END WHEN exact IS NOT NULL THEN 'computed' WHEN NOT sold_sig AND NOT qty_sig THEN 'not_measurable' ELSE 'accumulating' END AS revenue_status,
  coalesce(exact, approx, guess)::BIGINT AS revenue, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN approx IS NOT NULL THEN 'measured_approx' WHEN guess IS NOT NULL THEN 'estimated' ELSE 'none' END AS basis,
  row_number() OVER (ORDER BY coalesce(exact, approx, guess) DESC NULLS LAST, products DESC, store_id)::INT AS rank FROM based""")  # fmt: skip
def store_revenue_axis(t):
    """Readings are written once, in parts by pair, and what is made of them in turn: the shuffle of one part is on disk at a time, not that of all."""
    part = F.pmod(F.xxhash64("sku", "store_id"), F.lit(AXIS_PARTS)).cast("int")
    snaps = stored(t.snapshots.select("sku", "store_id", "crawled_at", "seq", "cents", "qty", "sold", "in_stock", "confidence").withColumn("part", part), "axis-readings", "part")
    in_turn = lambda make, name: stored_in_turn((make(snaps.where(F.col("part") == n).drop("part")) for n in range(AXIS_PARTS)), name)
    cover = in_turn(rollups.coverage, "axis-cover")
    pairs = in_turn(lambda rows: rollups.sales_pairs(rollups.sales_daily(rows), AS_OF, DAYS), "axis-pairs")
    badges = in_turn(lambda rows: estimates.badge_velocity(_with_badges(rows)), "axis-badges")
    unstored(snaps)
    totals, guessed = stored(orders.totals(t.orders), "axis-orders"), stored(_estimates(t, cover, pairs), "axis-estimates")
    return revenue.axis(cover, t.stores, pairs, totals, revenue.badge_revenue(badges), guessed, AS_OF, DAYS)


@query(ORACLE["revenue_back_test"].removeprefix("WITH ").rpartition("\nSELECT store_id, actual")[0], f"tested_stores AS (SELECT store_id, actual{ORACLE['revenue_back_test'].rpartition(chr(10) + 'SELECT store_id, actual')[2]})", """SELECT *, CASE WHEN stores_tested < 3 THEN 'inconclusive' WHEN median_abs_error_pct <= 30 THEN 'trustworthy' WHEN median_abs_error_pct <= 100 THEN 'weak' ELSE 'too_weak' END AS verdict FROM (
  SELECT count(*) AS stores_tested, round(avg(abs(error_pct)), 1) AS mean_abs_error_pct, round(median(abs(error_pct)), 1) AS median_abs_error_pct, max(abs(error_pct)) AS worst_abs_error_pct, count(*) FILTER (abs(error_pct) <= 30) AS within_30pct FROM tested_stores WHERE actual > 0)""")
def back_test_summary(t):
    return revenue.back_test_summary(revenue_back_test(t))


@query(OWN_ROWS, META, LINKS, "SELECT store_id, count(DISTINCT my_sku) AS overlap FROM links GROUP BY store_id")
def catalogue_overlap(t):
    return revenue.overlap(t.links)


@query(OWN_ROWS, """SELECT count(*) FILTER (coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) > 0) AS priced, count(*) FILTER (coalesce(in_stock, false) OR coalesce(qty, 0) > 0) AS in_stock, count(*) FILTER (synced_at >= TIMESTAMP '2001-11-04' - INTERVAL 48 HOURS) AS fresh FROM own_rows""")
def own_catalogue_counts(t):
    return revenue.own_counts(t.own_catalogue, AS_OF)


@query(SNAPS, COVER, f"""rows_ AS (SELECT sku, store_id, last_priced_cents AS cents, percent_rank() OVER (PARTITION BY sku ORDER BY last_priced_cents) AS standing, count(*) OVER (PARTITION BY sku) AS sellers, median(last_priced_cents) OVER (PARTITION BY sku) AS middle FROM cover WHERE last_priced_at >= {SINCE} AND last_priced_cents > 0)""",
"""SELECT store_id, count(*) FILTER (b = 0) AS from_0, count(*) FILTER (b = 1) AS from_25, count(*) FILTER (b = 2) AS from_50, count(*) FILTER (b = 3) AS from_75, count(*) AS shared, round(median(ratio) / 1000000, 3) AS median_price_ratio
FROM (SELECT *, least(3, floor(standing * 4)) AS b, round(cents * 1000000 / middle)::BIGINT AS ratio FROM rows_ WHERE sellers >= 2) GROUP BY store_id""")  # fmt: skip
def percentile_histograms(t):
    return insights.percentile_histogram(t.cover, AS_OF, DAYS)


# Profiles and digest. Nothing is left out for its confidence here.
ALL_SALES = ESTIMATED.replace("FROM recent)", f"FROM snaps WHERE crawled_at >= {SINCE})")
PROFILE = f"""
unfloored AS (SELECT sku, store_id, units, round(units * mean_cents)::BIGINT AS revenue FROM united),
sold AS (SELECT store_id, sum(units)::BIGINT AS units, sum(revenue)::BIGINT AS revenue FROM unfloored WHERE units > 0 GROUP BY store_id),
span AS (SELECT store_id, greatest(floor((epoch(max(crawled_at)) - epoch(min(crawled_at))) / 86400), 1)::BIGINT AS d FROM snaps WHERE crawled_at >= {SINCE} GROUP BY store_id),
cut AS (SELECT store_id, round(avg(discount_pct) FILTER (discount_pct > 0), 1) AS rate FROM (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY sku, store_id ORDER BY crawled_at DESC, seq DESC) = 1) GROUP BY store_id),
size AS (SELECT store_id, count(DISTINCT sku) AS catalog_size, count(DISTINCT sku) FILTER (in_stock AND crawled_at >= TIMESTAMP '2001-11-04' - INTERVAL 7 DAYS) AS active_skus FROM snaps GROUP BY store_id)"""


@query(SNAPS, ALL_SALES, PROFILE, """SELECT store_id, catalog_size, active_skus, coalesce(rate, 0) AS avg_discount_rate, coalesce(d, 1) AS data_span_days, round(coalesce(revenue, 0) * 30 / coalesce(d, 1))::BIGINT AS est_monthly_revenue, round(coalesce(revenue, 0) / coalesce(d, 1))::BIGINT AS est_daily_revenue,
  round(coalesce(units, 0) / coalesce(d, 1), 1) AS est_daily_units FROM size LEFT JOIN cut USING (store_id) LEFT JOIN span USING (store_id) LEFT JOIN sold USING (store_id)""")
def store_profiles(t):
    return insights.store_profiles(t.snapshots, estimates.window_sales(t.snapshots, AS_OF, DAYS, 0), AS_OF, DAYS)


@query(SNAPS, ALL_SALES, PROFILE, f"""day_steps AS (SELECT sku, store_id, crawled_at, cents, coalesce(least(greatest(sold - lag(sold) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq), 0), 30), 0) AS units FROM snaps WHERE crawled_at >= {SINCE})""",
"SELECT s.store_id, crawled_at::DATE AS day, sum(s.units * cents)::BIGINT AS revenue FROM day_steps s JOIN unfloored u ON u.sku = s.sku AND u.store_id = s.store_id AND u.units > 0 GROUP BY ALL HAVING sum(s.units * cents) > 0")
def store_profile_daily(t):
    return insights.profile_days(estimates.steps(t.snapshots, AS_OF, DAYS, 0), estimates.window_sales(t.snapshots, AS_OF, DAYS, 0))


@query(SNAPS, RECENT, LATEST, PRODUCTS, "SELECT store_id, category, count(*) AS products FROM latest JOIN products USING (sku) GROUP BY ALL")
def store_profile_categories(t):
    return insights.profile_categories(t.latest, t.products)


@query(SNAPS, CATALOGUE, f"""steps AS (SELECT *, lag(in_stock) OVER (PARTITION BY sku, store_id ORDER BY crawled_at, seq) AND NOT in_stock AS out FROM snaps WHERE crawled_at >= {SINCE}),
ends AS (SELECT sku, store_id, count(*) AS n, arg_min(cents, (crawled_at, seq)) AS a, arg_max(cents, (crawled_at, seq)) AS b, coalesce(bool_or(out), false) AS went_out FROM steps GROUP BY ALL)""",
f"""SELECT count(*) FILTER (a - b >= 0.05::DOUBLE * a) AS total_price_drops, count(*) FILTER (went_out) AS total_oos_events, (SELECT arg_max(store_id, (pairs, store_id)) FROM (SELECT store_id, count(*) AS pairs FROM ends WHERE n >= 2 GROUP BY store_id)) AS most_active_store,
  (SELECT count(*) FROM catalogue) AS total_skus, (SELECT count(*) FROM catalogue WHERE first_seen_at >= {SINCE}) AS total_new_products, (SELECT count(*) FROM steps) AS snapshots FROM ends""")  # fmt: skip
def digest_summary(t):
    return insights.digest_summary(t.snapshots.drop("sold"), t.catalogue, AS_OF, DAYS)


@query(CATALOGUE, "SELECT sku, name, first_seen_at FROM catalogue WHERE first_seen_at >= TIMESTAMP '2001-11-04' - INTERVAL 7 DAYS ORDER BY first_seen_at DESC, sku LIMIT 3")
def digest_new_products(t):
    return insights.new_products(t.catalogue, AS_OF, 7).select("sku", "name", "first_seen_at")


# Audits.
FOODS = "[CASE (sku // 4) % 16 WHEN 0 THEN 'cat_food_dry' WHEN 1 THEN 'cat_food_dry' WHEN 2 THEN 'dog_food_wet' WHEN 3 THEN 'dog_food_wet' WHEN 4 THEN 'dog_treats' WHEN 12 THEN 'dog_food' WHEN 13 THEN 'cat_food' WHEN 14 THEN 'dog_food' END][1]"


@query(CATALOGUE, f"foods AS (SELECT sku, {FOODS} AS bucket FROM catalogue)", """SELECT bucket, count(*) AS products, round(count(*) * 100 / (SELECT count(*) FROM foods WHERE bucket IS NOT NULL), 1) AS pct, string_agg(sku::VARCHAR, ',' ORDER BY sku) FILTER (place <= 3) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sku) AS place FROM foods WHERE bucket IS NOT NULL) GROUP BY bucket""")
def subcategory_distribution(t):
    return admin.subcategories(t.catalogue, 3)


KIND = "['cat_food', 'cat_food', 'dog_food', 'dog_food', 'dog_food', 'litter', 'accessories', 'toys', 'bird_food', 'fish_food', 'grooming', 'healthcare', 'dog_food', 'cat_food', 'dog_food', 'accessories'][((sku // 4) % 16)::INT + 1]"


@query(SNAPS, CLOSES, SALES, CATALOGUE, f"""went AS (SELECT c.sku, coalesce({FOODS.replace("(sku", "(c.sku")}, {KIND.replace("(sku", "(c.sku")}) AS category, coalesce(q, 0)::BIGINT AS qty_drop FROM catalogue c LEFT JOIN (SELECT sku, sum(qty_drop) AS q FROM pairs GROUP BY sku) p ON p.sku = c.sku)""",
"""SELECT category, sum(qty_drop)::BIGINT AS qty_drop, string_agg(sku::VARCHAR, ',' ORDER BY place) FILTER (place <= 5 AND qty_drop > 0) AS first_products
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY qty_drop DESC, sku) AS place FROM went) GROUP BY category""")  # fmt: skip
def trending_kinds(t):
    return insights.trending_kinds(t.pairs, t.catalogue)


@query(SNAPS, RECENT, LATEST, OWN, RIVALS, """sold_by AS (SELECT sku, cents, 'EUROPE' AS store_id, true AS mine, 0 AS old FROM own UNION ALL SELECT sku, cents, store_id, false, (crawled_at < TIMESTAMP '2001-11-04' - INTERVAL 7 DAYS)::INT FROM rivals),
placed AS (SELECT *, rank() OVER (PARTITION BY sku ORDER BY cents) AS rank FROM sold_by WHERE cents > 0)""",
"""SELECT sku, string_agg(rank || ':' || cents || ':' || mine || ':' || store_id, ',' ORDER BY rank, NOT mine, store_id) AS sellers, sum(old)::BIGINT AS stale_sellers, 0::BIGINT AS low_confidence_sellers
  FROM placed GROUP BY sku HAVING bool_or(mine) AND count(*) >= 2""")  # fmt: skip
def market_position_sellers(t):
    rows = position.seller_ranks(t.own_products, t.latest.where(F.col("store_id") != tables.OWN_STORE), tables.OWN_STORE, AS_OF)
    shown = F.transform("sellers", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["cents"].cast("string"), s["is_mine"].cast("string"), s["store_id"]))
    return rows.select("sku", F.array_join(shown, ",").alias("sellers"), "stale_sellers", "low_confidence_sellers")


@query(CATALOGUE, f"""before AS (SELECT sku, name, CASE sku % 4 WHEN 0 THEN NULL WHEN 1 THEN 'pet_food' WHEN 2 THEN 'toys' ELSE {KIND} END AS old, {KIND} AS fresh FROM catalogue),
after AS (SELECT sku, (sku // 4) % 16 AS place, old, CASE WHEN old IS NULL OR (old LIKE '%food') = (fresh LIKE '%food') THEN fresh ELSE old END AS category FROM before)""",
"""SELECT sku, old, category, CASE WHEN category NOT IN ('cat_food', 'dog_food') THEN NULL WHEN place IN (0, 1) THEN 'cat_food_dry' WHEN place IN (2, 3) THEN 'dog_food_wet' WHEN place = 4 THEN 'dog_treats' END AS subcategory FROM after""")  # fmt: skip
def reclassified_products(t):
    from tarifa.functions import text

    old = F.expr("CASE sku % 4 WHEN 1 THEN 'pet_food' WHEN 2 THEN 'toys' END")
    return admin.reclassified(t.catalogue.withColumn("category", F.when(F.col("sku") % 4 == 3, text.category(F.col("name"))).otherwise(old)))


MISSING = """
theirs AS (SELECT l.sku AS rival_sku, l.store_id, l.cents AS rival_cents, CASE WHEN l.sku % 3 = 0 THEN '0' || (5200000000000 + l.sku - l.sku % 8) ELSE (5200000000000 + l.sku - l.sku % 8)::VARCHAR END AS rival_barcode, (l.sku // 4) % 16 AS q FROM latest l WHERE store_id <> 'EUROPE'),
ours AS (SELECT sku AS my_sku, barcode, coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) AS my_cents, (sku // 4) % 16 AS p, lpad(regexp_extract(barcode, '^([0-9]{8,14})', 1), 14, '0') AS gtin, regexp_extract(sku::VARCHAR, '^([0-9]{8,14})$', 1) AS code FROM own_rows),
meet AS (SELECT o.*, t.* FROM ours o JOIN theirs t ON lpad(t.rival_barcode, 14, '0') IN (o.gtin, lpad(nullif(o.code, ''), 14, '0')) WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.my_sku = o.my_sku AND k.rival_sku = t.rival_sku AND k.store_id = t.store_id)),
facts AS (SELECT [1, 24, 1, 12, 1, 1, 1, 1, 1, 1, 1, 1, -1, 1, 24, 1] AS pack, [400, 400, 100, NULL, 5000, 10000, NULL, NULL, 1500, 100, 250, NULL, NULL, 85, NULL, 2000] AS grams, [NULL, 24, NULL, 12, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 24, NULL] AS stated),
judged AS (SELECT meet.*, pack[p + 1] = pack[q + 1] AND NOT coalesce(greatest(grams[p + 1], grams[q + 1])::DOUBLE / least(grams[p + 1], grams[q + 1]) > 1.1::DOUBLE, false)
  AND (greatest(my_cents, rival_cents)::DOUBLE / least(my_cents, rival_cents) < 6 OR coalesce(stated[p + 1] = stated[q + 1], false)) AS fits FROM meet, facts)"""


@query(*BASE, MISSING, """SELECT my_sku, rival_sku, store_id, CASE WHEN NOT fits THEN 'blocked_by_guard' WHEN rival_barcode IN (coalesce(barcode, '-'), my_sku::VARCHAR) OR my_sku = rival_sku THEN 'other' WHEN lpad(rival_barcode, 14, '0') = gtin THEN 'competitor_barcode' ELSE 'gtin14_normalization' END AS cause FROM judged""")
def missing_sellers(t):
    code = "5200000000000 + sku - sku % 8"
    rivals = t.latest.where(F.col("store_id") != tables.OWN_STORE).withColumn("barcode", F.expr(f"CASE WHEN sku % 3 = 0 THEN concat('0', {code}) ELSE cast({code} AS string) END")).join(t.catalogue.select("sku", "name"), "sku")
    return admin.missing_sellers(t.own_catalogue, rivals, t.links)


@query(SNAPS, CATALOGUE, "SELECT sku FROM catalogue WHERE sku NOT IN (SELECT sku FROM snaps)")
def orphan_products(t):
    return admin.orphans(t.catalogue, t.snapshots)


KEEP = [("Asia", "asia.example"), ("america", "nowhere.example"), ("Else", "HTTPS://www.africa.example/path"), ("None", "none.example")]
KEPT = """kept AS (SELECT store_id, store_id AS name, store_id IN ('ASIA', 'AMERICA', 'AFRICA') AS kept FROM meta)"""


def _kept(t):
    wanted = t.spark.createDataFrame(KEEP, "keep_name string, keep_domain string")
    return admin.keep_list(t.store_meta.withColumn("name", F.col("store_id")), wanted)


@query(META, KEPT, "SELECT * FROM kept")
def store_keep_list(t):
    return _kept(t)


@query(SNAPS, OWN_ROWS, META, LINKS, KEPT, """SELECT store_id, 'snapshots' AS "table", count(*) AS rows FROM snaps JOIN kept USING (store_id) WHERE NOT kept GROUP BY ALL UNION ALL SELECT store_id, 'links', count(*) FROM links JOIN kept USING (store_id) WHERE NOT kept GROUP BY ALL""")
def cleanup_counts(t):
    return admin.cascade_counts(_kept(t).where("NOT kept"), {"snapshots": t.snapshots.drop("sold"), "links": t.links})


@query(SNAPS, META, """SELECT sku, store_id, crawled_at, cents, platform, is_own FROM (SELECT * FROM (SELECT s.*, l_orderkey, l_linenumber, l_suppkey FROM (SELECT l_partkey AS sku, r_name AS store_id, l_shipdate AS crawled_at, round(l_extendedprice * 100)::BIGINT AS cents, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) s) ORDER BY crawled_at DESC, sku, store_id, l_orderkey, l_linenumber, l_suppkey LIMIT 200) JOIN meta USING (store_id)""")
def recent_snapshots(t):
    return admin.newest_with_platform(t.snapshots.drop("sold"), t.store_meta, 200).select("sku", "store_id", "crawled_at", "cents", "platform", "is_own")


@query("""SELECT coalesce(sum(b) FILTER (ts >= TIMESTAMP '2024-01-20'), 0)::BIGINT AS bytes_today, coalesce(sum(b) FILTER (ts >= TIMESTAMP '2024-01-01'), 0)::BIGINT AS bytes_month, round(coalesce(sum(b) FILTER (ts >= TIMESTAMP '2024-01-01'), 0) * 100 / 53687091200, 4) AS pct_used FROM (SELECT ts, round(value * 1000)::BIGINT AS b FROM events)""")
def transfer_usage(t):
    log = tables.table(t.spark, t.sf_dir, "events").select(F.col("ts").alias("at"), F.round(F.col("value") * 1000).cast("long").alias("bytes"))
    return admin.transfer_usage(log, datetime(2024, 1, 20, 15, 30), 50 * 1024**3)


@query("""SELECT count(*) AS rows, min(ts) AS "first", max(ts) AS "last" FROM events""")
def import_status(t):
    return admin.import_status(tables.table(t.spark, t.sf_dir, "events"), "ts")


@query(*BASE, PACKS, SELLERS, """SELECT count(*) AS products, sum(before)::BIGINT AS sellers_before, sum(after)::BIGINT AS sellers_after, count(*) FILTER (after > before) AS products_gaining FROM (
  SELECT sku, count(*) FILTER (match_source = 'sku') AS before, count(DISTINCT store_id) AS after FROM sellers WHERE NOT excluded GROUP BY sku)""")
def seller_coverage(t):
    names = t.catalogue.select("sku", "name").union(t.own_catalogue.select("sku", "name")).distinct()
    return admin.seller_coverage(catalogue.sellers(t.own_catalogue.select("sku"), t.links, t.snapshots.drop("sold"), names, AS_OF))


@query(SNAPS, """SELECT 'day' AS "window", count(*) AS readings, 1 AS days FROM snaps WHERE crawled_at >= TIMESTAMP '2000-06-15' AND crawled_at < TIMESTAMP '2000-06-16'
UNION ALL SELECT 'range', count(*), 30 FROM snaps WHERE crawled_at >= TIMESTAMP '2000-06-01' AND crawled_at < TIMESTAMP '2000-07-01'
UNION ALL SELECT 'shop days', count(*), 30 FROM snaps WHERE crawled_at >= TIMESTAMP '2000-05-31 21:00' AND crawled_at < TIMESTAMP '2000-06-30 21:00'""")
def date_windows(t):
    snaps = t.snapshots.drop("sold")
    ranged, days = admin.between(snaps, date(2000, 6, 1), date(2000, 6, 30))
    count = lambda rows, name, n: rows.agg(F.lit(name).alias("window"), F.count("*").alias("readings"), F.lit(n).alias("days"))
    shop = admin.on_shop_days(snaps, date(2000, 6, 1), date(2000, 6, 30), "crawled_at")
    return count(admin.on_day(snaps, date(2000, 6, 15)), "day", 1).union(count(ranged, "range", days)).union(count(shop, "shop days", days))


@query(CATALOGUE, "SELECT sku FROM catalogue WHERE regexp_matches(name, '^(Royal|Kong) ')")
def names_by_pattern(t):
    return t.catalogue.where(F.col("name").rlike("^(Royal|Kong) ")).select("sku")


@query("SELECT event_id AS id, ts AS at, ts > TIMESTAMP '2024-01-30 12:00' - INTERVAL 24 HOURS AS unread FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10".replace(" AS at", ' AS "at"'))
def alert_notifications(t):
    events = tables.table(t.spark, t.sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return admin.notifications(events, datetime(2024, 1, 30, 12))


@query("""SELECT ts, event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50""".replace("event_id DESC", "event_id"))
def crawl_log_feed(t):
    return admin.feed(tables.table(t.spark, t.sf_dir, "events").where("event_type = 'click'").select("ts", "event_id"), "ts", 50)


SEASONS = [("founding day", date(2000, 2, 22), date(2000, 2, 22)), ("ramadan", date(2000, 11, 27), date(2000, 12, 26)), ("summer", date(2000, 7, 1), date(2000, 8, 15)), ("late", date(2001, 3, 1), date(2001, 3, 2))]
SEASON_SQL = "seasons(name, start, stop) AS (VALUES ('founding day', DATE '2000-02-22', DATE '2000-02-22'), ('ramadan', DATE '2000-11-27', DATE '2000-12-26'), ('summer', DATE '2000-07-01', DATE '2000-08-15'), ('late', DATE '2001-03-01', DATE '2001-03-02'))"


@query(SNAPS, SEASON_SQL, """SELECT name, CASE WHEN start = stop THEN 'line' ELSE 'area' END AS kind, count(*) AS readings FROM snaps JOIN seasons ON crawled_at::DATE BETWEEN start AND stop WHERE start BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY ALL""")
def seasonal_readings(t):
    shown = admin.seasons_in(t.spark.createDataFrame(SEASONS, "name string, start date, stop date"), date(2000, 1, 1), date(2000, 12, 31))
    return admin.days_in_season(t.snapshots.drop("sold").select(F.to_date("crawled_at").alias("day")), shown).groupBy("name", "kind").agg(F.count("*").alias("readings"))


@query(SNAPS, "SELECT count(*) FILTER (store_id = 'EUROPE') AS would_delete, count(*) AS rows FROM snaps")
def own_snapshot_purge(t):
    return admin.own_purge(t.snapshots.drop("sold"), tables.OWN_STORE)


@query(OWN_ROWS, """SELECT sku, CASE WHEN sku % 3 = 0 THEN true ELSE false END AS present FROM own_rows UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0""")
def own_sync_presence(t):
    seen = t.own_catalogue.where("sku % 3 = 0").select("sku").union(t.catalogue.where("sku % 3 = 0").select("sku"))
    return admin.discovered(admin.absent_flagged(t.own_catalogue, seen).select("sku", "present"), seen, "sync").select("sku", "present")


ALERTS = """alerts AS (SELECT p_partkey AS id, p_partkey AS sku, ['price_drop', 'price_increase', 'out_of_stock', 'back_in_stock', 'low_stock'][(p_partkey % 5)::INT + 1] AS alert_type, CASE WHEN p_partkey % 3 = 0 THEN p_size % 20 END AS threshold, p_partkey % 7 <> 0 AS is_active FROM part),
placed AS (SELECT sku, cents, qty, in_stock, row_number() OVER (PARTITION BY sku ORDER BY crawled_at DESC, store_id DESC, seq DESC) AS n FROM snaps QUALIFY n <= 2),
two AS (SELECT sku, max(cents) FILTER (n = 1) AS a, max(cents) FILTER (n = 2) AS b, max(qty) FILTER (n = 1) AS qa, max(qty) FILTER (n = 2) AS qb, bool_or(in_stock) FILTER (n = 1) AS ia, bool_or(in_stock) FILTER (n = 2) AS ib FROM placed GROUP BY sku HAVING count(*) = 2),
judged AS (SELECT *, round((a - b) * 100 / b, 1) AS pct, coalesce(threshold, 0) AS t, CASE WHEN threshold > 0 THEN threshold ELSE 10 END AS mark FROM alerts JOIN two USING (sku) WHERE is_active)"""


@query(SNAPS, ALERTS, """SELECT id, sku, alert_type, CASE WHEN alert_type LIKE 'price%' THEN pct END AS change_pct FROM judged WHERE (alert_type = 'price_drop' AND a < b AND -pct >= t) OR (alert_type = 'price_increase' AND a > b AND pct >= t) OR (alert_type = 'out_of_stock' AND NOT ia AND ib)
  OR (alert_type = 'back_in_stock' AND ia AND NOT ib) OR (alert_type = 'low_stock' AND qa <= mark AND qb > mark)""")
def alerts_fired(t):
    kinds = F.array(*map(F.lit, ("price_drop", "price_increase", "out_of_stock", "back_in_stock", "low_stock")))
    part = tables.table(t.spark, t.sf_dir, "part")
    alerts = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("sku"), F.element_at(kinds, (F.col("p_partkey") % 5).cast("int") + 1).alias("alert_type"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_size % 20 END").alias("threshold"), (F.col("p_partkey") % 7 != 0).alias("is_active"))
    return audits.fired(alerts, t.snapshots.drop("sold"))


@query(*BASE, """mine AS (SELECT sku, coalesce(CASE WHEN sale_cents <> 0 THEN sale_cents END, cents) AS my_cents, coalesce(qty, 0) AS qty FROM own_rows),
near AS (SELECT m.sku, k.store_id, my_cents, m.qty, n.cents AS rival_cents, n.in_stock FROM links k JOIN mine m ON m.sku = k.my_sku JOIN latest n ON n.sku = k.rival_sku AND n.store_id = k.store_id WHERE k.confidence >= 75)""",
"""SELECT sku, store_id, 'price_drop' AS alert_type, '' AS category, 5 AS threshold FROM (SELECT * FROM near WHERE my_cents > 0 AND rival_cents > 0 QUALIFY row_number() OVER (PARTITION BY sku ORDER BY rival_cents, store_id) = 1) WHERE round((my_cents - rival_cents) * 100 / rival_cents, 1) > 15
UNION ALL SELECT sku, min(store_id), 'out_of_stock', '', 0 FROM near WHERE qty > 0 AND in_stock GROUP BY sku UNION ALL SELECT p_partkey, '', 'back_in_stock', 'catalog_gap', 0 FROM part WHERE round(p_retailprice * 1000)::BIGINT >= 1000000""")  # fmt: skip
def alerts_generated(t):
    gaps = tables.table(t.spark, t.sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("revenue"))
    return audits.generated(t.own_catalogue, t.links, t.latest, gaps)


@query(CATALOGUE, "SELECT sku, name FROM catalogue WHERE sku IN (3, 17, 199, -1)")
def point_lookups(t):
    asked = t.spark.createDataFrame([(3,), (17,), (199,), (-1,)], "sku long")
    return t.catalogue.join(F.broadcast(asked), "sku").select("sku", "name")  # four rows


@query(ORACLE["discounts_top_pct"].removeprefix("WITH ").replace("ORDER BY discount_pct DESC, saving DESC", "ORDER BY saving DESC").rpartition(chr(10) + "SELECT f.sku")[0], "found AS (SELECT f.sku" + ORACLE["discounts_top_pct"].replace("ORDER BY discount_pct DESC, saving DESC", "ORDER BY saving DESC").rpartition(chr(10) + "SELECT f.sku")[2] + ")", "SELECT * FROM found")
def discounts_top_amount(t):
    return discounts.deepest(t.snapshots, t.daily, t.stores, AS_OF, DAYS, by="saving")


@query(SNAPS, RECENT, """plain AS (SELECT sku, store_id, max((crawled_at, seq)) AS at_ FROM recent WHERE discount_pct <= 0 GROUP BY ALL)""",
       """SELECT r.sku, r.store_id, min(crawled_at) AS started_at, count(*) AS readings, p.at_ IS NULL AS is_lower_bound, greatest(floor((epoch(TIMESTAMP '2001-11-04') - epoch(min(crawled_at))) / 86400), 0)::BIGINT AS days_on_discount
FROM recent r LEFT JOIN plain p ON r.sku = p.sku AND r.store_id = p.store_id WHERE p.at_ IS NULL OR (crawled_at, seq) > p.at_ GROUP BY r.sku, r.store_id, p.at_""")
def discount_streaks(t):
    return discounts.streaks(t.recent.drop("sold"), AS_OF)


@query(SNAPS, CLOSES, SALES, PRODUCTS, """SELECT sku, name, brand, units, revenue FROM pairs JOIN products USING (sku) WHERE store_id = 'ASIA' AND units > 0 ORDER BY units DESC, revenue DESC, sku LIMIT 20""")
def top_sellers_of_store(t):
    return insights.top_sellers(t.pairs.where("store_id = 'ASIA'"), t.products)


@query(SNAPS, COVER, STORES, """newest AS (SELECT store_id, max(last_seen_any_at) AS newest FROM cover JOIN stores USING (store_id) WHERE NOT is_own GROUP BY store_id)""", "SELECT min(newest) AS as_fresh_as, arg_min(store_id, (newest, store_id)) AS bottleneck FROM newest")
def freshness_bottleneck(t):
    return insights.freshness_bottleneck(t.cover, t.stores)


@query(SNAPS, COVER, """SELECT round(count(*) FILTER (age <= 86400) * 100 / greatest(count(*), 1), 1) AS today_pct, round(count(*) FILTER (age > 86400 AND age <= 604800) * 100 / greatest(count(*), 1), 1) AS this_week_pct,
  round(count(*) FILTER (age > 604800 AND age <= 2592000) * 100 / greatest(count(*), 1), 1) AS this_month_pct, round(count(*) FILTER (age > 2592000) * 100 / greatest(count(*), 1), 1) AS stale_pct FROM (SELECT epoch(TIMESTAMP '2001-11-04') - epoch(last_seen_any_at) AS age FROM cover)""")
def freshness_shares(t):
    return insights.age_shares(t.cover, AS_OF)
