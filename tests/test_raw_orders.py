import json
from datetime import datetime

from pyspark.sql import functions as F

from tarifa.sources import raw_orders


def test_raw_orders(spark):
    raw = [
        {"id": 1, "order_status": {"code": "delivered"}, "order_total": "1,100.50 SAR", "created_at": "2024-01-01 02:00:00", "products": [{"sku": " a ", "quantity": 1, "price": 5, "is_bundle": True}, {"sku": "b", "quantity": 5, "parent_id": 9}]},
        {"order_id": "2", "status": "Payment Failed", "total": {"value": "999"}, "products": [{"sku": "c", "qty": "2", "total": {"amount": 7.5}}]},
        {"code": "3", "order_status": "new", "grand_total": 50, "created_at": "2024-01-01T02:00:00Z", "items": [{"sku": "d", "quantity": "x"}]},
        {"order_total": 5},
    ]
    got = {r.order_id: r for r in raw_orders.normalised(spark.createDataFrame([(json.dumps(r),) for r in raw] + [(None,), ("junk",)], "payload string")).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].total, got["1"].units, got["1"].created_at, got["1"].excluded) == (1100.5, 1, datetime(2023, 12, 31, 23), False)
    assert [(i.sku, i.qty, i.line_total, i.is_bundle) for i in got["1"].items] == [("a", 1, 5.0, True)]
    assert (got["2"].excluded, got["2"].status, got["2"].total, got["2"].units) == (True, "payment_failed", 999.0, 2)
    assert (got["3"].total, got["3"].units, got["3"].created_at) == (50.0, 0, datetime(2024, 1, 1, 2))
    kept = raw_orders.normalised(spark.createDataFrame([(json.dumps(r),) for r in raw], "payload string")).where("NOT excluded")
    assert kept.agg(F.sum("total"), F.count("*")).first()[:] == (1150.5, 2)
