"""The commit log and what stands on it: the ledger, the kept tables and the whole ingest chain, cut off, replayed and merged."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifa.operators import rollups
from tarifa.sources import tables
from tarifa.streaming import chain, commits, kept, ledger
from tests.conftest import SMALL

DAY = datetime(2024, 1, 1)
OBSERVED = "store_id string, sku int, cents long, observed_at timestamp, id long"


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def landed(spark, batches, schema, path):
    """A stream of batches, a file each."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def finished(query):
    assert query.awaitTermination(600)
    return query


# commits


def test_folders_stay_few_and_merge_in_order(spark, tmp_path):
    shapes = {"log": commits.Table("k int, v string"), "last": commits.Table("k int, v string", commits.newest(["k"], [])), "first": commits.Table("k int, v string", commits.first_filled(["k"]))}
    log = commits.Commits(spark, f"file://{tmp_path}/t", shapes)
    assert log.last().number == -1 and log.read("log").count() == 0
    for n in range(19):
        rows = spark.createDataFrame([(n % 3, f"v{n}"), (9, None if n % 2 else "")], "k int, v string")
        log.publish(n, {"log": rows, "last": rows, "first": rows} if n % 5 else {"log": rows, "last": rows}, {"n": n})
        log.publish(n, {"log": rows}, {"n": -1})  # committed already: nothing
    state = log.last()
    assert state.number == 18 and state.marks == {"n": 18}
    assert [level for _, level in state.tables["log"]] == [2, 0, 0, 0]
    assert log.read("log").count() == 38
    assert {r.k: r.v for r in log.read("last").collect()} == {0: "v18", 1: "v16", 2: "v17", 9: ""}
    assert {r.k: r.v for r in log.read("first").collect()} == {0: "v3", 1: "v1", 2: "v2", 9: None}
    kept_folders = [p.name for p in (tmp_path / "t/log").iterdir()]
    assert len(kept_folders) <= 4 + commits.FAN and len(list((tmp_path / "t/_commits").glob("*.json"))) <= 3


# ledger


def brute_ledger(batches):
    """Closes and late rows, batch by batch."""
    clock, days, late = None, {}, []
    for rows in batches:
        for r in rows:
            day = (r[3] + timedelta(hours=3)).date()
            end = datetime.combine(day, datetime.min.time()) + timedelta(days=1) - timedelta(hours=3)
            if clock and end <= clock:
                late.append(r)
            else:
                days.setdefault((r[0], r[1], day), []).append((r[3], r[4], r[2]))
        clock = max([clock or datetime.min, *(r[3] - timedelta(minutes=30) for r in rows)])
    sealed = {k: (max(v)[2], len(v)) for k, v in days.items() if datetime.combine(k[2], datetime.min.time()) + timedelta(hours=21) <= clock}
    return sealed, late, len(days) - len(sealed)


def test_every_late_observation_is_kept_and_counted_after_a_restart_too(spark, tmp_path):
    h = lambda n: DAY + timedelta(hours=n)
    five = [("S", 1, 20 + i, h(1), 30 + i) for i in range(5)]
    batches = [
        [("S", 1, 10, h(0), 1), ("S", 1, 11, h(2), 2), ("T", 1, 5, h(20), 3)], [("S", 1, 12, h(21.4), 4)], [("T", 2, 7, h(20.9), 5), ("S", 2, 9, h(21.6), 6)],
        [*five, ("S", 1, 99, h(22), 40)], [("T", 1, 6, h(50), 41)], [*five, ("T", 1, 8, h(44.9), 42), ("T", 1, 9, h(50), 43)],
    ]
    sealed, late, still_open = brute_ledger(batches)
    assert len(late) == 11
    root, check = f"file://{tmp_path}/ledger", f"file://{tmp_path}/check"
    landed(spark, batches[:4], OBSERVED, tmp_path / "in")
    stream = lambda: spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    finished(ledger.run(stream(), root, check))
    for n, rows in enumerate(batches[4:], 4):
        spark.createDataFrame(rows, OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    finished(ledger.run(stream(), root, check))  # goes on after the restart
    log = commits.Commits(spark, root, ledger.ledger_tables(spark.createDataFrame([], OBSERVED)))
    assert sorted(tuple(r) for r in ledger.late_observations(log).collect()) == sorted(late)
    assert {(r.store_id, r.sku, r.day): (r.close_cents, r.observations) for r in ledger.kept_closes(log).collect()} == sealed
    assert ledger.kept_closes(log, sealed=False).count() == still_open


# kept tables


def test_kept_tables_are_the_batch_form_after_twenty_batches(spark, tmp_path):
    """Readings come in any order: each batch has some of every time."""
    snaps = tables.snapshots(spark, SMALL).where("sku % 5 = 0").cache()
    dealt = snaps.withColumn("batch", F.pmod(F.xxhash64("seq"), F.lit(20))).cache()
    log = commits.Commits(spark, f"file://{tmp_path}/kept", kept.kept_tables(snaps))
    for n in range(20):
        kept.refreshed(log, dealt.where(F.col("batch") == n).drop("batch"), n)
        if n == 7:
            same(kept.sales_daily(log), rollups.sales_daily(dealt.where("batch <= 7").drop("batch")))
    same(kept.coverage(log), rollups.coverage(snaps))
    same(kept.sales_daily(log), rollups.sales_daily(snaps))
    same(kept.daily_rollups(log), rollups.daily_rollups(snaps))
    assert all(len(folders) <= 8 for folders in log.last().tables.values())
    assert not kept.backfilled(log, snaps, 20)
    half = snaps.where("sku % 2 = 0")
    log.publish(20, {}, {"kept_version": kept.VERSION - 1})
    assert kept.backfilled(log, half, 21)  # an older version: made anew
    same(kept.daily_rollups(log), rollups.daily_rollups(half))


# the chain


def post(place, at, row, domain="a.example", store="A"):
    return (domain, store, f"name of {store}", "salla", DAY + timedelta(hours=at), place, row if isinstance(row, str) or row is None else json.dumps(row))


def posts():
    """Batches of posts with all that can be wrong with them."""
    first = [
        post(1, 0, {"sku": "1", "name_ar": "Royal Canin Cat Dry Food", "price": "100 SAR", "sale_price": 80, "quantity": "7", "url": "/p/1"}), post(2, 0, {"sku": " 2 ", "name_en": "Dog Toy", "price": 50.5, "quantity": -3, "product_url": "short"}),
        post(3, 0, {"sku": "", "price": 5}), post(4, 0, {"sku": "3", "price": 0}), post(5, 0, "[1, 2]"), post(6, 0, None), post(7, 0, '{"sku": "9", "price": 4'), post(8, 0, {"sku": "3", "price": True}),
        post(9, 1, {"sku": "1", "price": 90, "in_stock": False, "quantity": 4, "barcode": "5200000000001", "url": "https://x.example/1"}),
    ]
    other = [post(10, 2, {"sku": "5200000000002", "price": 10, "quantity": 1, "in_stock": True}, "own.example", "OWN"), post(11, 2, {"sku": "x", "barcode": "5200000000001", "price": 20, "sale_price": 15}, "own.example", "OWN"), post(12, 3, {"sku": "own-3", "price": 30}, "own.example", "OWN")]
    renamed = [post(13, 30, {"sku": "1", "name_ar": "Another", "name_en": "Cat Food", "price": 70}, "a.example", "A-again"), post(14, 31, {"sku": "x", "price": 25, "quantity": 2}, "own.example", "OWN")]
    late = [post(15, 5, {"sku": "2", "price": 1}), post(16, 55, {"sku": "2", "price": 45})]
    return [first, other, renamed, late]


@pytest.fixture(scope="module")
def own(spark):
    return spark.createDataFrame([("own-1", "5200000000001"), ("own-2", "5200000000002"), ("own-3", None), ("own-4", "12")], "sku string, barcode string")


def everything(log):
    return {name: sorted((str(tuple(r)) for r in log.read(name).collect())) for name in log.tables}


def test_the_chain_takes_in_what_is_right_and_says_what_is_not(spark, tmp_path, own):
    stream = landed(spark, posts(), chain.POSTS, tmp_path / "in")
    finished(chain.run(stream, own, ["own.example"], f"file://{tmp_path}/out", f"file://{tmp_path}/check"))
    log = commits.Commits(spark, f"file://{tmp_path}/out", chain.tables(spark))
    assert sorted((r.place, r.reason) for r in log.read("rejects").collect()) == [(3, "no sku"), (4, "no price"), (5, "not an object"), (6, "not an object"), (7, "not an object"), (8, "no price")]
    assert {r.domain: r.store_id for r in log.read("stores").collect()} == {"a.example": "A", "own.example": "OWN"}
    goods = {r.sku: r for r in log.read("products").collect()}
    assert set(goods) == {"1", "2", "5200000000002", "x", "own-3"}
    one = goods["1"]
    assert (one.name_ar, one.name_en, one.barcode, one.product_url, one.brand, one.category, one.first_seen_at) == ("Royal Canin Cat Dry Food", "Cat Food", "5200000000001", "https://a.example/p/1", "Royal Canin", "cat_food", DAY)
    readings = {r.seq: r for r in log.read("readings").collect()}
    assert set(readings) == {1, 2, 9, 10, 11, 12, 13, 14, 15, 16} and {r.store_id for r in readings.values()} == {"A", "OWN"}
    assert (readings[1].cents, readings[1].list_cents, readings[1].sale_cents, readings[1].discount_pct, readings[1].qty, readings[1].in_stock) == (8000, 10000, 8000, 20, 7, True)
    assert (readings[2].sku, readings[2].cents, readings[2].sale_cents, readings[2].qty, readings[2].in_stock, readings[2].product_url) == ("2", 5050, None, 0, False, "https://a.example/products/short")
    assert not readings[9].in_stock and readings[10].in_stock
    mirror = {r.my_sku: (r.cents, r.sale_cents, r.qty, r.in_stock) for r in log.read("own").collect()}
    assert mirror == {"own-1": (2000, 1500, 0, False), "own-2": (1000, None, 1, True), "own-3": (3000, None, 0, False)}
    assert [r.id for r in ledger.late_observations(log).collect()] == [15]
    closes = {(r.store_id, r.sku, str(r.day)): (r.close_cents, r.observations) for r in ledger.kept_closes(log).collect()}
    assert closes[("A", "1", "2024-01-01")] == (9000, 2) and ("A", "2", "2024-01-03") not in closes
    snaps = log.read("readings").drop("born")
    same(kept.coverage(log), rollups.coverage(snaps))
    same(kept.daily_rollups(log), rollups.daily_rollups(snaps))
    said = {(r.batch, r.store_id): (r.received, r.inserted, r.updated, r.skipped, r.reasons) for r in chain.answers(log).collect()}
    assert said[0, "A"] == (9, 2, 1, 6, ["no price", "no sku", "not an object"]) and said[2, "A"] == (1, 0, 1, 0, None) and said[1, "OWN"] == (3, 3, 0, 0, None)


def test_a_batch_that_is_cut_off_anywhere_changes_nothing(spark, tmp_path, own, monkeypatch):
    """The writes of the second batch fail one after another, and at last the commit; each time it is replayed by the next try."""
    dealt = [spark.createDataFrame(rows, chain.POSTS).cache() for rows in posts()]
    whole = commits.Commits(spark, f"file://{tmp_path}/whole", chain.tables(spark))
    for n, rows in enumerate(dealt):
        chain.land(rows, own, ["own.example"], whole, n)
    log = commits.Commits(spark, f"file://{tmp_path}/cut", chain.tables(spark))
    chain.land(dealt[0], own, ["own.example"], log, 0)
    before, names = everything(log), ("_write", "_commit")
    plain = {n: getattr(commits.Commits, n) for n in names}
    for survived in (0, 3, 8, 11):
        left = [survived]

        def failing(self, *args, name, left=left):
            left[0] -= 1
            if left[0] < 0:
                raise OSError("cut off")
            return plain[name](self, *args)

        for n in names:
            monkeypatch.setattr(commits.Commits, n, lambda self, *args, n=n: failing(self, *args, name=n))
        with pytest.raises(OSError, match="cut off"):
            chain.land(dealt[1], own, ["own.example"], log, 1)
        for n in names:
            monkeypatch.setattr(commits.Commits, n, plain[n])
        assert everything(log) == before and log.last().number == 0
    for n, rows in enumerate(dealt):  # those before are left out
        chain.land(rows, own, ["own.example"], log, n)
    assert everything(log) == everything(whole)


def test_events_at_the_border_of_a_batch_are_dealt_as_the_sql_deals_them(spark, tmp_path):
    import duckdb

    from tarifa.plans import registry

    con = duckdb.connect()
    at = "TIMESTAMP '2024-01-01' + to_days((9 * (i % 4) - 9 * (i % 7 // 6))::INT) + to_microseconds((hash(i) % 4000000)::BIGINT - 2000000)"
    con.execute(f"""COPY (SELECT i AS event_id, {at} AS ts, 1 AS user_id, 'view' AS event_type, i / 7 AS value, '{{"k": ' || i % 5 || '}}' AS props FROM range(500) r(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    names = ["store_id", "sku", "day", "close_cents", "observations", "late"]
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE['ledger_stream']})").fetchall()
    ours = [tuple(r) for r in registry.QUERIES["ledger_stream"](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(ours, key=str) == sorted(theirs, key=str) and any(r[-1] for r in ours)


def test_a_batch_of_posts_is_parsed_once_by_all_cores(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(chain, "batch_rows", lambda rows, *rest, made=chain.batch_rows: (seen.append((rows.storageLevel.useMemory, "reason" in rows.columns, rows.groupBy(F.spark_partition_id()).count().count())), made(rows, *rest))[1])
    posts = spark.range(20_000).coalesce(1).selectExpr("'a.example' AS domain", "'A' AS store_id", "'Shop' AS store_name", "'salla' AS platform", f"TIMESTAMP'{DAY}' AS received_at", "id AS place", "concat('{\"sku\": \"', id, '\", \"price\": 5}') AS row")
    log = commits.Commits(spark, f"file://{tmp_path}/log", chain.tables(spark))
    chain.land(posts, spark.createDataFrame([], "sku string, barcode string"), [], log, 0)
    assert seen == [(True, True, 4)] and log.read(chain.READINGS).count() == 20_000


def test_what_moved_is_found_with_one_exchange_by_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "FEW_PAIRS", -1)
    snaps = tables.snapshots(spark, SMALL).select(*kept.READ)
    snaps.write.parquet(f"file://{tmp_path}/batch")
    log = commits.Commits(spark, f"file://{tmp_path}/kept", kept.kept_tables(snaps))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = kept.kept_rows(spark.read.parquet(f"file://{tmp_path}/batch"), log, log.last(), 0)[kept.MOVES]
        plan = moves._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the closes by cell, then all by pair
