import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.operators import rollups
from tarifa.sources import landed, products, sinks
from tarifa.streaming import ingest

READING = "sku string, store_id string, crawled_at timestamp, cents long, qty int, in_stock boolean"


def normal(spark, *raw):
    rows = products.normalised(spark.createDataFrame([(json.dumps(r),) for r in raw], "payload string")).collect()
    return rows


def test_prices_come_from_the_variant_that_has_the_barcode(spark):
    sale = {"id": 1, "name": {"ar": "", "en": "x"}, "price": {"amount": 279}, "sale_price": {"amount": 0}, "skus": [{"barcode": "12", "price": 5}, {"gtin": "5200000000001", "price": 237.02, "regular_price": 279}]}
    zid = {"sku": "z", "title": "y", "price": 100, "sale_price": "80 SAR", "barcode": "5200000000002", "quantity": "7", "status": "draft"}
    promo = {"mpn": "52742059", "price": 50, "promotion": {"price": 40}, "is_infinite": True, "is_available": "no", "categories": [{"name": {"ar": "قطط", "en": "cats"}}, {"name": "food"}, "wet"], "sold_quantity": "1000+"}
    got = normal(spark, sale, zid, promo, {"id": 4, "price": None, "quantity": 3, "urls": {"customer": "c"}, "images": [{"src": "i"}]})
    assert [(r.sku, r.name, r.barcode, r.price, r.original_price, r.sale_price, r.discount_pct) for r in got] == [
        ("S-1", "x", "5200000000001", 237.02, 279.0, None, 15), ("z", "y", "5200000000002", 80.0, 100.0, 80.0, 20), ("52742059", None, "52742059", 40.0, 50.0, 40.0, 20), ("S-4", None, "", 0.0, 0.0, None, 0),
    ]
    assert [(r.qty, r.in_stock, r.sold, r.sold_capped) for r in got] == [(0, False, 0, False), (7, False, 0, False), (999, False, 1000, True), (3, True, 0, False)]
    assert got[2].tags == "قطط cats food wet" and (got[3].product_url, got[3].image_url) == ("c", "i")


def test_codes_on_pages_and_of_listed_variants(spark):
    pages = ["<b>EAN</b>: 052742059518 4006381333931", "text 4006381333931 only", "4006381333931 and 052742059518", "52742059518", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "html string").select(products.page_code(F.col("html"))).collect()]
    assert got == ["052742059518", "4006381333931", None, None, None]
    variants = [{"barcode": "x"}, {"barcode": "11111111", "price": 5, "in_stock": "false"}, {"gtin": "22222222", "price": 6, "in_stock": "true"}]
    frame = spark.createDataFrame([(json.dumps(variants), p) for p in (5.0, 9.0)] + [(json.dumps(variants[:2]), 9.0), ("[]", 1.0)], "v string, price double").withColumn("v", F.from_json("v", f"array<{products._VARIANT}>"))
    assert [r[0] for r in frame.select(products.listed_code(F.col("v"), F.col("price"))).collect()] == ["11111111", "22222222", "11111111", None]


def test_tags_speak_where_the_name_does_not(spark):
    rows = [("cat_food", "Cat Food", "wet food"), ("cat_food", "Cat Dry Food", "wet"), ("cat_food", "Cat Food Bundle", "wet"), ("cat_food", None, "treats"), ("toys", "x", "wet")]
    frame = spark.createDataFrame(rows, "parent string, name string, tags string")
    got = [r[0] for r in frame.select(products.food_form_hybrid(F.col("parent"), F.col("name"), F.col("tags"))).collect()]
    assert got == ["cat_food_wet", "cat_food_dry", None, "cat_treats", None]


def test_walks_stop_for_the_first_reason(spark):
    page = lambda *ids, **more: json.dumps({"products": [{"id": str(i), "name": f"n{i}", "price": 1} for i in ids]} | more)
    walks = {
        "status": [(1, 200, page(1)), (2, 500, page(2)), (3, 200, page(3))], "error": [(1, 200, page(1)), (2, 200, "<html>")], "empty": [(1, 200, page(1)), (2, 200, page())], "again": [(1, 200, page(1, 2)), (2, 200, page(2, 1)), (3, 200, page(3))],
        "next": [(1, 200, page(1)), (2, 200, page(2, pagination={"next": False})), (3, 200, page(3))], "count": [(1, 200, page(1, last_page=2)), (2, 200, page(2)), (3, 200, page(3))], "total": [(1, 200, page(1)), (2, 200, page(2, 3, total=3)), (3, 200, page(4))],
        "most": [(i, 200, page(i)) for i in range(1, 9)], "short": [(1, 200, page(1, 2, 3)), (2, 200, page(4))],
    }
    frame = spark.createDataFrame([(w, *p) for w, own in walks.items() for p in own], "walk string, page int, status int, payload string")
    items, outcome = products.walked(frame, 5)
    stops = {r.walk: (r.pages, r.stop) for r in outcome.collect()}
    assert stops == {"status": (2, "http_500"), "error": (2, "page_error"), "empty": (2, "empty_page"), "again": (2, "duplicate_page"), "next": (2, "no_next"), "count": (2, "pages_count_reached"), "total": (2, "results_total_reached"), "most": (5, "max_pages"), "short": (2, "exhausted")}
    got = {}
    for r in items.collect():
        got.setdefault(r.walk, []).append(int(r.id))
    assert {w: sorted(ids) for w, ids in got.items()} == {"status": [1], "error": [1], "empty": [1], "again": [1, 2], "next": [1, 2], "count": [1, 2], "total": [1, 2, 3], "most": [1, 2, 3, 4, 5], "short": [1, 2, 3, 4]}


def test_the_largest_response_is_taken(spark):
    rows = [(1, '{"data": [{"id": "1"}]}'), (1, '{"items": [{"id": "1"}, {"id": "2"}]}'), (1, "{}"), (2, "no"), (2, None)]
    got = products.largest_payload(spark.createDataFrame(rows, "page_id long, payload string")).collect()
    assert [(r.page_id, r.products) for r in got] == [(1, 2)]


def test_imports_need_their_columns(spark, tmp_path):
    frame = spark.createDataFrame([("a", "x", "1,000 SAR", "q"), ("a", "y", "2", "r"), (" ", "z", "3", ""), ("b", "z", "0", ""), ("c", None, None, "")], "sku string, name_ar string, price string, extra string").coalesce(1)
    assert [tuple(r) for r in products.imported_products(frame).select("sku", "name_ar", "price", "extra").collect()] == [("a", "y", 2.0, "r")]
    with pytest.raises(ValueError, match="name_ar"):
        products.imported_products(frame.drop("name_ar"))
    (tmp_path / "leaders.csv").write_text("rank,name\n1,x\n,\n2,y\n")
    sheets = products.baseline(spark, str(tmp_path), {"leaders": "rank int, name string"})
    assert sorted(map(tuple, sheets["leaders"].collect())) == [(1, "x"), (2, "y")]


def test_the_demo_is_the_same_for_a_seed(spark):
    one, two, other = products.demo(spark, 5, 3, 4), products.demo(spark, 5, 3, 4), products.demo(spark, 5, 3, 4, 7)
    assert sorted(one.collect()) == sorted(two.repartition(3).collect()) != sorted(other.collect())
    assert 0 < one.count() <= 60 and one.where("cents <= 0 OR qty < 0").count() == 0


def test_cards_of_each_kind_of_shop(spark):
    zid = "".join(f'<div class="zid-product"><div class="item-image"><img src="i{i}"></div><h3>n{i}</h3><del>2{i}</del><b class="price-current">1{i}.5 SAR</b></div>' for i in range(5))
    data = "".join(f'<li data-product="{i}"><h2>d{i}</h2><span data-price>3{i}</span>' for i in range(3)) + '<script type="application/ld+json">{"itemListElement": [{"item": {"@type": "Product", "name": "l", "offers": {"price": 9}}}]}</script>'
    got = landed.page_cards(spark.createDataFrame([(1, zid), (2, data), (3, "<p>nothing")], "page_id long, html string")).collect()
    assert [(r.name, r.price, r.original, r.image) for r in got if r.page_id == 1] == [(f"n{i}", 10.5 + i, 20.0 + i, f"i{i}") for i in range(5)]
    assert ("l", 9.0) in {(r.name, r.price) for r in got if r.page_id == 2} and {r.page_id for r in got} == {1, 2}


def test_cards_of_a_signed_in_customer(spark):
    html = '<div class="product"><h4>a</h4><i class="member-price">1,080.5 SAR</i><i class="price">1200</i><i class="countdown"></i><i class="sale-price">999</i><i class="availability">only 7 left</i></div><div class="product"><h4>b</h4><i class="price">5</i><i class="sold-out"></i></div><div class="product"></div>'
    got = landed.page_signed_in_cards(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "a", 1200.0, 1080.5, True, 999.0, 7, True), (1, "b", 5.0, None, False, None, None, False)]


def test_a_streamed_backlog_is_the_batch_change_log(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = [(f"k{r.randint(1, 6)}", r.choice("ST"), datetime(2024, 1, 1) + timedelta(minutes=240 * i + r.randint(0, 200)), r.choice((10, 10, 20)), r.choice((1, 1, 2)), r.random() < 0.8) for i in range(120)]
    for n in range(0, 120, 40):
        spark.createDataFrame(rows[n : n + 40], READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(READING).parquet(str(tmp_path / "in"))
        ingest.run(stream, str(tmp_path / "facts"), str(tmp_path / "newest"), str(tmp_path / "c")).awaitTermination(120)
    every = spark.createDataFrame(rows, READING).withColumn("seq", F.lit(0)).withColumn("sold", F.lit(None).cast("int"))
    want = sorted(tuple(x)[:6] for x in rollups.changes(every).select(*READING.replace(",", "").split()[::2]).collect())
    assert sorted(map(tuple, spark.read.schema(READING).parquet(str(tmp_path / "facts")).select(*READING.replace(",", "").split()[::2]).collect())) == want
    newest = ingest.newest_rows(spark, str(tmp_path / "newest"), every.select(*READING.replace(",", "").split()[::2]).schema, 3)
    assert {(x.sku, x.store_id): x.crawled_at for x in newest.collect()} == {p: max(t for *q, t, _, _, _ in rows if tuple(q) == p) for p in {(x[0], x[1]) for x in rows}}
    late = [("k1", "S", datetime(2023, 12, 31), 99, 1, True)]
    spark.createDataFrame(late, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run(spark.readStream.schema(READING).parquet(str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "newest"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "facts-late")).count() == 1 and spark.read.schema(READING).parquet(str(tmp_path / "facts")).count() == len(want)


def test_only_touched_buckets_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 4)
    for n in range(2):
        rows = [(f"k{i}", "S", datetime(2024, 1, 1 + n), 5, 1, True) for i in (range(20) if not n else range(1))]
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.run(spark.readStream.schema(READING).parquet(str(tmp_path / "in")), str(tmp_path / "f"), str(tmp_path / "n"), str(tmp_path / "c")).awaitTermination(120)
    assert len(list((tmp_path / "n/batch=0").glob("bucket=*"))) == 4 and len(list((tmp_path / "n/batch=1").glob("bucket=*"))) == 1


def test_orders_are_pulled_again_for_two_weeks(spark):
    now = datetime(2024, 2, 1)
    frame = lambda *rows: spark.createDataFrame([(i, now - timedelta(days=d), s) for i, d, s in rows], "order_id string, created_at timestamp, status string")
    got = ingest.repulled(frame(("a", 3, "new"), ("b", 20, "new"), ("c", 5, "new")), frame(("a", 3, "done"), ("b", 20, "done"), ("d", 1, "new")), now)
    assert {r.order_id: r.status for r in got.collect()} == {"a": "done", "b": "new", "c": "new", "d": "new"}
    pages = spark.createDataFrame([(1, now), (1, now - timedelta(days=20)), (2, now - timedelta(days=15)), (3, now)], "page int, created_at timestamp")
    assert {r.page for r in ingest.pages_to_read(pages, now).collect()} == {1}
    assert ingest.pages_to_read(pages.where("page <> 2"), now).count() == 3


def test_stores_are_replaced_one_by_one(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "store_id string, n long")
    path = str(tmp_path / "t")
    for rows in ([("a", 1), ("b", 2)], [("b", 3), ("b", 4)], [("b", 3), ("b", 4)]):
        sinks.replace_stores(frame(*rows), path)
    assert sorted((r.store_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("b", 4)]
    assert sinks.needs_backfill(spark, path, 34)
    count = lambda rows: rows.groupBy("store_id").agg(F.count("*").alias("n"))
    sinks.refresh_rollups(frame(("a", 1), ("a", 1), ("b", 1)), count, frame(("a", 0)).select("store_id"), path, 34)
    assert sorted((r.store_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 3), ("b", 4)]
    assert not sinks.needs_backfill(spark, path, 34) and sinks.needs_backfill(spark, path, 35)


def test_exports_caches_and_backups(spark, tmp_path):
    row = spark.range(2).select(*(F.lit("é").alias(c) for c in sinks.EXPORT))
    sinks.export_csv(row, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_bytes().startswith("﻿SKU,Name (AR)".encode()) or file.read_bytes().startswith('"﻿SKU"'.encode())
    both = sinks.union_of_columns([spark.range(1).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2))])
    assert both.columns == ["id", "a", "b"] and both.count() == 2
    at, path, live = datetime(2024, 1, 1, 12), str(tmp_path / "cache"), lambda: spark.range(3).withColumn("x", F.lit(1.5))
    assert sinks.cached(spark, path, "k", at, live).count() == 3
    sinks.write_cache(live().limit(1), path, "k", at)
    sinks.write_cache(live().limit(2), path, "j", at)
    assert sinks.cached(spark, path, "k", at + timedelta(hours=24), live).count() == 1 and sinks.cached(spark, path, "j", at, live).collect()[1].x == 1.5
    assert sinks.cached(spark, path, "k", at + timedelta(hours=25), live).count() == 3 and sinks.cached(spark, path, "z", at, live).count() == 3
    assert sinks.due(None, at) and not sinks.due(at, at + timedelta(seconds=599)) and sinks.due(at, at + timedelta(seconds=600))
    assert sinks.backed_up(live(), str(tmp_path / "copy")) == 3


def test_clean_up_is_guarded(spark):
    from tarifa.operators import admin

    rows, doomed = spark.createDataFrame([("a", 1), ("b", 2)], "store_id string, n long"), spark.createDataFrame([("a",)], "store_id string")
    assert [r.store_id for r in admin.without_stores(rows, doomed, 1, 5).collect()] == ["b"]
    for confirmed, most in ((2, 5), (1, 0)):
        with pytest.raises(ValueError):
            admin.without_stores(rows, doomed, confirmed, most)
    own = spark.createDataFrame([(1, True)], "sku long, present boolean")
    assert admin.absent_flagged(own, own.limit(0)).first().present and not admin.absent_flagged(own, own.selectExpr("sku + 1 AS sku")).first().present
    assert admin.own_purge(rows, "a", False).count() == 1


def test_sealed_closes_leave_out_what_comes_after_the_seal(spark, tmp_path):
    from tarifa.streaming import ledger

    schema = "store_id string, sku int, cents long, observed_at timestamp, id long"
    day = datetime(2024, 1, 1)
    after = day + timedelta(days=3)
    batches = [[("S", 1, 10, day, 1)], [("S", 1, 11, after, 2)], [("S", 1, 13, after, 4)], [("S", 1, 12, day + timedelta(hours=1), 3), ("S", 1, 14, after, 5)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = ledger.sealed_closes(stream).writeStream.format("memory").queryName("late_ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.close_cents, r.observations) for r in spark.table("late_ledger").collect()] == [(10, 1)]
