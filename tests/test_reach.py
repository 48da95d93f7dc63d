"""Readings reached by barcode, and lists within lists."""

from datetime import datetime

from pyspark.sql import functions as F

from tarifa.operators import catalogue
from tarifa.sources import landed


def test_readings_are_reached_by_sku_by_barcode_and_by_match(spark):
    at = datetime(2024, 1, 10)
    snaps = spark.createDataFrame([("p1", "S", at, 1, 10, 5, True), ("5200000000001", "T", at, 2, 11, 5, True), ("r1", "U", at, 3, 12, 5, True), ("r1", "V", at, 4, 13, 5, True), ("520", "T", at, 5, 14, 5, True)], "sku string, store_id string, crawled_at timestamp, seq long, cents long, qty int, in_stock boolean")
    hubs = spark.createDataFrame([("p1", "5200000000001"), ("p2", "520"), ("p3", None)], "sku string, barcode string")
    links = spark.createDataFrame([("p1", "r1", "U", 90)], "my_sku string, rival_sku string, store_id string, confidence int")
    names = spark.createDataFrame([("p1", "Cat Food")], "sku string, name string")
    found = lambda hubs: {(r.sku, r.store_id, r.key, r.match_source, r.excluded) for r in catalogue.sellers(hubs, links, snaps, names, datetime(2024, 1, 11)).collect()}
    assert found(hubs) == {("p1", "S", "p1", "sku", False), ("p1", "T", "5200000000001", "barcode", False), ("p1", "U", "r1", "matched", False)}
    assert found(hubs.drop("barcode")) == {("p1", "S", "p1", "sku", False), ("p1", "U", "r1", "matched", False)}


def test_of_readings_at_one_time_the_largest_key_counts_then_the_largest_seq(spark):
    at = datetime(2024, 1, 10)
    snaps = spark.createDataFrame([("p1", "S", at, 9, 10, 5, True), ("r1", "S", at, 1, 11, 5, True), ("r1", "S", at, 2, 12, 5, True), ("p1", "T", at, 3, 13, 5, True), ("p1", "T", at, 4, 14, 5, True)], "sku string, store_id string, crawled_at timestamp, seq long, cents long, qty int, in_stock boolean")
    links = spark.createDataFrame([("p1", "r1", "S", 90)], "my_sku string, rival_sku string, store_id string, confidence int")
    names = spark.createDataFrame([("p1", "Cat Food")], "sku string, name string")
    found = catalogue.sellers(spark.createDataFrame([("p1",)], "sku string"), links, snaps, names, datetime(2024, 1, 11))
    assert {(r.store_id, r.key, r.cents) for r in found.collect()} == {("S", "r1", 12), ("T", "p1", 14)}


def test_lists_within_envelopes(spark):
    payloads = ['{"data": {"products": {"data": [{"id": 1}], "current_page": 1}}}', '{"data": {"data": [{"id": 2}]}}', '{"products": [{"id": 3}]}', '{"data": {"other": 1}}', '{"id": 4}', '[{"id": 5}]', '{"data": []}', None]
    got = [r.ids for r in spark.createDataFrame([(n, p) for n, p in enumerate(payloads)], "n int, p string").select("n", F.transform(landed.enveloped(F.col("p")), lambda x: x["id"]).alias("ids")).orderBy("n").collect()]
    assert got == [["1"], ["2"], ["3"], None, None, ["5"], [], None]
