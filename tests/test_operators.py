"""Hand-computed fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.functions import numbers, text
from tarifa.operators import discounts, estimates, insights, matching, position, rollups
from tarifa.sources import landed
from tarifa.streaming import ingest, ledger

NOW = datetime(2024, 6, 30)
SNAP = "sku string, store_id string, crawled_at timestamp_ntz, seq int, cents long, list_cents long, discount_pct int, qty int, sold long, in_stock boolean, confidence int"


def snaps(spark, rows):
    """Rows (store, sku, days ago, price, confidence, in stock, qty, sold)."""
    made, seq = [], {}
    for store, sku, ago, price, conf, stock, qty, sold in sorted(rows, key=lambda r: -r[2]):
        seq[store, sku] = seq.get((store, sku), 0) + 1
        made.append((sku, store, NOW - timedelta(days=ago), seq[store, sku], price * 100, price * 100, 0, qty, sold, stock, conf))
    return spark.createDataFrame(made, SNAP)


@pytest.fixture(scope="module")
def market(spark):
    d = lambda s, k, a, p, conf=99, stock=True, qty=5, sold=0: (s, k, a, p, conf, stock, qty, sold)
    return snaps(spark, [
        d("S1", "A", 3, 20), d("S1", "A", 2, 10), d("S1", "A", 1, 15), d("S1", "B", 3, 50, qty=10), d("S1", "B", 2, 40, qty=6),
        d("S2", "A", 3, 30), d("S2", "A", 2, 25, stock=False, qty=0), d("S1", "F", 3, 30, qty=50, sold=10), d("S1", "F", 2, 30, qty=48, sold=14), d("S1", "F", 1, 30, qty=48, sold=14),
        d("S2", "C", 2, 5, conf=85), d("S3", "A", 1, 22), d("S1", "E", 2, 0), d("S1", "D", 3, 100, conf=84), d("S1", "D", 2, 50, conf=84),
    ]).cache()


def test_kept_tables(market):
    cover = {(r.sku, r.store_id): r for r in rollups.coverage(market).collect()}
    assert len(cover) == 8
    assert cover["D", "S1"].last_seen_at is None and cover["E", "S1"].last_priced_at is None
    assert rollups.daily_rollups(market).agg(F.sum("drops")).first()[0] == 3
    sales = {(r.store_id, r.sku): (r.units, r.revenue, r.qty_drop) for r in rollups.sales_pairs(rollups.sales_daily(market), NOW, 30).collect()}
    assert sales == {("S1", "B"): (4, 16000, 4), ("S2", "A"): (5, 12500, 5), ("S1", "F"): (4, 12000, 2)}


def test_insights_on_the_kept_tables(spark, market):
    cover = rollups.coverage(market)
    names = spark.createDataFrame([(k, k, "b", "c", 1) for k in "ABCDEF"], "sku string, name string, brand string, category string, weight int")
    row = insights.summary(cover, rollups.daily_rollups(market), NOW, 30).first()
    assert (row.price_drops, row.median_spread_cents, row.pairs, row.gaps) == (3, 1000.0, 8, 4)
    gaps = {r.sku: r.n_stores for r in insights.gaps(cover, names, 3, NOW, 30).collect()}
    assert gaps == {"B": 1, "C": 1, "F": 1}
    assert [r.sku for r in insights.restock(cover, names, NOW, 30).collect()] == ["A"]
    assert [(r.sku, r.spread) for r in insights.price_wars(cover, names, NOW, 30).collect()] == [("A", 1000)]


@pytest.mark.parametrize(("sold", "qty", "days", "units", "method"), [
    ([10, 12, 15, 20], [5] * 4, 30, 10, "sold_count_diff"), ([5, 10, 3, 8], [5] * 4, 30, 10, "sold_count_diff"), ([10, 5000, 5005], [5] * 3, 2, 55, "sold_count_diff"),
    ([0, 0, 0], [20, 15, 10], 30, 10, "qty_positive_delta_sum"), ([7], [5], 30, 0, "insufficient_data"), ([0, 0], [999, 500], 30, 0, "insufficient_signal"), ([0, 0], [3, 4], 30, 0, "no_depletion"),
    ([40 * i for i in range(1, 11)], [5] * 10, 10, 300, "sold_count_diff"),
])
def test_window_sales(spark, sold, qty, days, units, method):
    rows = snaps(spark, [("S", "K", (len(sold) - i) * min(1, days / len(sold) / 2), 10, 99, True, q, s) for i, (s, q) in enumerate(zip(sold, qty))])
    got = estimates.window_sales(rows, NOW, days).first()
    assert (got.units, got.method) == (units, method)


@pytest.mark.parametrize(("readings", "units", "status"), [
    ([(100, False), (137, False)], 37, "measured_approx"), ([(100, False)], None, "baseline_only"), ([(500, False), (540, False), (12, False), (30, False)], 58, "measured_approx"),
    ([(1000, True)] * 3, None, "all_capped"), ([(900, False), (1000, True), (990, False)], 90, "measured_approx"), ([(10, False), (999999, False)], 5000, "measured_approx"),
])
def test_badge_velocity(spark, readings, units, status):
    rows = spark.createDataFrame([("K", "S", NOW + timedelta(days=i), i, v, c, 100) for i, (v, c) in enumerate(readings)], "sku string, store_id string, crawled_at timestamp, seq int, sold long, capped boolean, cents long")
    got = estimates.badge_velocity(rows).first()
    assert (got.units, got.status) == (units, status)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "pack"), [
    *((n, 24) for n in ("24 Pieces*400g", "24 Pcs", "24 x 400g", "24*70g", "24×400g", "24-pack", "24 قطعة", "عبوة 24", "Carton 24", "400g x 24")),
    *((n, 1) for n in ("400g", "One Piece Cat Toy", "40 x 60 cm Pet Bed", "متعدد الألوان", "Backpack Carrier")), ("Some Pack Thing", -1),
])
def test_pack_quantity(spark, name, pack):
    assert one(spark, name, text.pack_quantity) == pack


def test_barcodes(spark):
    for code, want in (("052742059518", "00052742059518"), ("52742059518", "00052742059518"), ("9003579308936carton", "09003579308936"), ("4021", None), ("1234567", None), (None, None)):
        assert one(spark, code, text.canonical_barcode) == want
    for code, want in (("12345678", False), ("52742059518", False), ("4006381333931", True), (None, False)):
        assert one(spark, code, text.valid_gtin) is want


def test_labels(spark):
    for name, want in (("صحن طعام", "accessories"), ("dog food dry", "dog_food"), ("cat snack", "cat_food"), ("cat litter", "litter"), ("plastic box", "accessories")):
        assert one(spark, name, text.category) == want
    form = lambda name, parent: spark.createDataFrame([(parent, name)], "p string, n string").select(text.food_form(F.col("p"), F.col("n"))).first()[0]
    assert form("chicken stick in gravy", "dog_food") == "dog_treats"
    assert form("wet and dry mix", "cat_food") is None
    assert form("هوليستيك جاف", "dog_food") == "dog_food_dry"
    assert form("skin treatment wet", "cat_food") == "cat_food_wet"
    assert form("wet bundle", "cat_food") is None


def test_counters_and_numbers(spark):
    for value, want in (("1000+", (1000, True)), ("more than 500", (500, True)), ("1,250", (1250, False)), ("1000", (1000, False)), ("n/a", (0, False))):
        assert tuple(one(spark, value, text.counter)) == want
    assert one(spark, "1.5 kg bag", text.weight_grams) == 1500.0
    week = spark.createDataFrame([(datetime(2024, 12, 30),)], "v timestamp").select(numbers.year_iso_week(F.col("v"))).first()[0]
    assert week == "2024-W01"
    rows = spark.createDataFrame([(147.83, True), (40.0, False), (30.0, None)], "p double, t boolean").select(numbers.with_vat(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [170.0, 40.0, 30.0]


def test_matching_guards(spark):
    own = spark.createDataFrame([("m1", "52742059518", "Tin 400g", 20800), ("m2", None, "Toy", 1000)], "sku string, barcode string, name string, cents long")
    rivals = spark.createDataFrame([("r1", "S1", "052742059518", "Tin 400g", 810), ("r2", "S2", "052742059518", "Tin 400g", 10400), ("m2", "S1", "x", "Toy", 900), ("m2", "S2", "x", "Toy 5kg", 2000)], "sku string, store_id string, barcode string, name string, cents long")
    got = {(r.my_sku, r.store_id): (r.method, r.flags) for r in matching.matches(own, rivals).collect()}
    assert got == {("m1", "S2"): ("barcode", ""), ("m2", "S1"): ("sku", ""), ("m2", "S2"): ("sku", "SUSPICIOUS_PRICE")}
    sure = spark.createDataFrame([("r1",)], "rival_sku string")
    no = spark.createDataFrame([("m2", "m2")], "my_sku string, rival_sku string")
    got = {(r.my_sku, r.store_id): r.confidence for r in matching.matches(own, rivals, no, sure).collect()}
    assert got == {("m1", "S1"): 100, ("m1", "S2"): 99}


def test_streak_of_discounts(spark):
    rows = [("K", "S", NOW - timedelta(days=a), 11 - a, 100, 100, 0 if a >= 7 else 25, 5, 0, True, 99) for a in range(10, -1, -1)]
    got = discounts.streaks(spark.createDataFrame(rows, SNAP), NOW).first()
    assert (got.started_at, got.days_on_discount) == (NOW - timedelta(days=6), 6)
    ended = [*rows, ("K", "S", NOW + timedelta(hours=1), 12, 100, 100, 0, 5, 0, True, 99)]
    assert discounts.streaks(spark.createDataFrame(ended, SNAP), NOW).count() == 0


def test_market_position_ties_share_the_lower_rank(spark):
    own = spark.createDataFrame([("A", 200), ("B", 5)], "sku string, cents long")
    rivals = spark.createDataFrame([("A", "x", 100), ("A", "y", 200), ("A", "z", 300)], "sku string, store_id string, cents long")
    (got,) = position.market_position(own, rivals).collect()
    assert (got.rank, got.sellers, got.tag) == (2, 4, "at_median")


def test_ledger_day_is_at_utc_plus_three(spark):
    at = lambda s: datetime.fromisoformat(s)
    rows = spark.createDataFrame([("S", 1, 100, at("2024-01-01 20:59:00"), 1), ("S", 1, 95, at("2024-01-01 21:30:00"), 2), ("S", 1, 90, at("2024-01-02 09:00:00"), 3)], "store_id string, sku int, cents long, observed_at timestamp, id long")
    got = {str(r.day): (r.close_cents, r.observations) for r in ledger.day_closes(rows).collect()}
    assert got == {"2024-01-01": (100, 1), "2024-01-02": (90, 2)}


def test_streamed_ledger_is_the_batch_one_for_sealed_days(spark, tmp_path):
    from tarifa.sources import tables
    from tests.conftest import SMALL

    rows = tables.observations(spark, SMALL).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ledger.sealed_closes(stream).writeStream.format("memory").queryName("sealed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("sealed").select("store_id", "sku", "day", "close_cents", "observations").collect()}
    last = max(r[2] for r in got)
    want = {tuple(r) for r in ledger.day_closes(rows).where(F.col("day") <= F.lit(last)).select("store_id", "sku", "day", "close_cents", "observations").collect()}
    assert got and got == want


def test_ingest_keeps_changes_and_the_newest(spark, tmp_path):
    def land(name, rows):
        spark.createDataFrame([(k, "S", datetime(2024, 1, 1, h), c, 1, True) for k, h, c in rows], "sku string, store_id string, crawled_at timestamp, cents long, qty int, in_stock boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sku string, store_id string, crawled_at timestamp, cents long, qty int, in_stock boolean").parquet(str(tmp_path / "in"))
        ingest.run(stream, str(tmp_path / "facts"), str(tmp_path / "newest"), str(tmp_path / "c")).awaitTermination(120)

    land("a", [("A", 1, 10), ("B", 1, 20)])
    land("b", [("A", 2, 10), ("B", 2, 25)])
    facts = {(r.sku, r.cents) for r in spark.read.parquet(str(tmp_path / "facts")).collect()}
    assert facts == {("A", 10), ("B", 20), ("B", 25)}
    newest = {r.sku: r.cents for r in spark.read.parquet(str(tmp_path / "newest/batch=1")).collect()}
    assert newest == {"A": 10, "B": 25}


def test_landed_payloads(spark):
    payloads = ['{"products": [{"id": "1", "name": "x", "price": "10 SAR"}]}', '{"data": [{"id": "1", "name": "x", "price": "10"}, {"id": "2", "name": "y"}]}', '[{"id": "3", "price": "1,2"}]', "nonsense", None]
    got = {r.id: r.price for r in landed.catalogue(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()}
    assert got == {"1": 10.0, "2": 0.0, "3": 12.0}


def test_page_cards(spark):
    card = lambda n, p: f'<div class="product-card"><img src="x"><h3 class="product-card__title">{n}</h3><span class="price">{p} SAR</span></div>'
    pages = [(1, "<html>" + "".join(card(f"n{i}", f"1,{i}00.5") for i in range(3)) + "</html>"), (2, '<script type="application/ld+json">{"@type": "Product", "name": "ld", "offers": {"price": "7"}}</script>'), (3, None)]
    got = {(r.page_id, r.name): r.price for r in landed.page_cards(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {(1, "n0"): 1000.5, (1, "n1"): 1100.5, (1, "n2"): 1200.5, (2, "ld"): 7.0}


def brute_seller_set(edges):
    """Every pair within two hops, by a loop over the hubs."""
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    hubs = {}
    for a, b in edges:
        hubs.setdefault(b, set()).add(a)
    found = edges | {(b, a) for a, b in edges} | {(x, y) for members in hubs.values() for x in members for y in members}
    return {(x, y) for x, y in found if x != y}


def test_seller_hubs_expand_to_the_seller_set(spark):
    edges = [(1, 10), (1, 10), (2, 10), (3, 10), (3, 11), (4, 11), (5, 12), (6, 6), (7, 6), (8, 1), (None, 10), (9, None)]
    pairs = spark.createDataFrame(edges, "my_sku long, rival_sku long")
    hubs = matching.seller_hubs(pairs)
    want = brute_seller_set(edges)
    every = spark.range(20).withColumnRenamed("id", "my_sku")
    assert sorted(map(tuple, matching.partners(hubs, every).collect())) == sorted(want) == sorted(map(tuple, matching.seller_set(pairs).collect()))
    assert {tuple(r) for r in matching.partners(hubs, every.where("my_sku = 3")).collect()} == {p for p in want if p[0] == 3}
    hot = spark.range(300).selectExpr("id AS my_sku", "-1L AS rival_sku")
    assert matching.seller_hubs(hot).count() == 900


def test_seller_set_hubs_reads_all_of_lineitem_with_its_own_keys(spark):
    from tarifa.plans import oracles
    from tests.conftest import SMALL

    hubs = oracles.QUERIES["seller_set_hubs"](spark, SMALL)
    edges = {(r.l_partkey, -1 - r.l_suppkey) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    assert {(r.my_sku, r.other_sku) for r in hubs.where("relation = 'hub'").collect()} == edges
    got = matching.partners(hubs, hubs.select("my_sku").distinct()).collect()
    assert sorted(map(tuple, got)) == sorted(brute_seller_set(edges))


def test_the_revenue_axis_takes_readings_in_turn(spark, monkeypatch):
    from tarifa.plans import market
    from tests.conftest import SMALL

    taken, made = [], market.stored_in_turn
    monkeypatch.setattr(market, "stored_in_turn", lambda parts, name: (table := made(parts, name), taken.append((name, table.inputFiles())))[0])
    rows = market.store_revenue_axis(market.query.__globals__["Tables"](spark, SMALL))
    assert [name for name, _ in taken] == ["axis-cover", "axis-pairs", "axis-badges"]
    assert all(f"/turn={n}/" in str(files) for _, files in taken for n in range(market.AXIS_PARTS))
    assert not any("lineitem" in f for f in rows.inputFiles()) and rows.count() == 5  # what the result is made of is written, readings are read no more
