"""Alerts on a stream against a loop over the batches and against the batch form."""

import random
from datetime import datetime, timedelta

from tarifa.operators import audits
from tarifa.streaming import alerts, commits

READING = "sku int, store_id string, crawled_at timestamp, seq long, cents long, qty int, in_stock boolean"
ALERT = "id int, sku int, alert_type string, threshold int, is_active boolean"
KINDS = ("price_drop", "price_increase", "out_of_stock", "back_in_stock", "low_stock")


def fires(kind, threshold, now, before):
    t, mark = threshold or 0, threshold or 10
    pct = round((now[4] - before[4]) * 100 / before[4], 1) if before[4] > 0 else 0.0
    return {
        "price_drop": now[4] < before[4] and -pct >= t, "price_increase": now[4] > before[4] and pct >= t, "out_of_stock": not now[6] and before[6],
        "back_in_stock": now[6] and not before[6], "low_stock": now[5] <= mark < before[5],
    }[kind]


def test_a_streamed_backlog_fires_what_a_loop_fires(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randint(1, 12), r.choice("AB"), datetime(2024, 1, 1) + timedelta(hours=i // 2 - (40 if r.random() < 0.2 else 0)), i, r.choice((0, 90, 100, 120)), r.choice((3, 10, 30)), r.random() < 0.5) for i in range(160)]
    asked = [(i, i % 14, KINDS[i % 5], r.choice((None, 0, 15)), i % 6 != 0) for i in range(70)]
    watched = spark.createDataFrame(asked, ALERT).cache()
    batches = [rows[n : n + 32] for n in range(0, 160, 32)]
    for n, own in enumerate(batches):
        spark.createDataFrame(own, READING).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert alerts.run(stream, watched, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(300)
    log = commits.Commits(spark, f"file://{tmp_path}/out", alerts.tables(spark.createDataFrame([], READING)))

    seen, expected = {}, []
    for n, own in enumerate(batches):
        before = {s: max(x, key=lambda q: (q[2], q[1], q[3])) for s, x in seen.items()}
        for row in own:
            seen.setdefault(row[0], []).append(row)
        for alert_id, sku, kind, threshold, active in asked:
            two = sorted(seen.get(sku, []), key=lambda q: (q[2], q[1], q[3]))[-2:]
            if active and len(two) == 2 and two[1] != before.get(sku) and fires(kind, threshold, two[1], two[0]):
                expected.append((n, alert_id, sku, kind))
    assert sorted((e.batch, e.id, e.sku, e.alert_type) for e in alerts.events(log).collect()) == sorted(expected)
    whole = audits.fired(watched, spark.createDataFrame(rows, READING))
    standing = alerts.standing(log, watched)
    assert standing.exceptAll(whole).count() == 0 and whole.exceptAll(standing).count() == 0 and whole.count() > 0
    assert alerts.standing(log, watched, datetime(2024, 6, 1), 30).count() == 0
