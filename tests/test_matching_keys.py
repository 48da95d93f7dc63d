"""Matching by sets of codes against a loop over all pairs; placeholder codes on many rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarifa.operators import matching

OWN = "sku string, name string, cents long, barcode string, gtin string, mpn string"
RIVALS = "sku string, store_id string, name string, cents long, barcode string, gtin string, seen_barcode string"
VALID = re.compile(r"[0-9]{8,14}")


def keys(codes, sku):
    """The codes as they are written, and the keys they come to."""
    literal, known = set(), set()
    for value in codes:
        value = (value or "").strip().lower()
        lead = re.match(r"([0-9]{8,14})(?=[^0-9]|$)", value)
        if VALID.fullmatch(value):
            literal.add(value)
        if lead:
            known.add(lead[1].zfill(14))
    if VALID.fullmatch(sku.strip()):
        literal.add(sku.strip())
        known.add(sku.strip().zfill(14))
    return literal, known


def rows(seed, n):
    r = random.Random(seed)
    code = lambda: r.choice([None, "", "00000000", "00000000", f"{52742059500 + r.randint(0, 9)}", f"0{52742059500 + r.randint(0, 9)}", f"{52742059500 + r.randint(0, 9)}carton", f" 00{52742059500 + r.randint(0, 9)} ", "1234", "12345678-BLK", "123456789012345"])
    sku = lambda i: r.choice([f"S{i}", f"{52742059500 + i % 12}", f"{12345670 + i % 9}-BLK", str(i)])
    own = {(s := sku(i)): (s, r.choice(["Cat Food 1kg", "Cat Food 1.05 kg", "Dog Toy"]), r.randint(100, 300), code(), code(), code()) for i in range(n)}
    rivals = {(s := sku(i), t := r.choice("AB")): (s, t, r.choice(["Cat Food 1 kg", "Cat Food 2kg", "Dog Toy Pack of 6", "Toy"]), r.randint(100, 300), code(), code(), code()) for i in range(n)}
    return list(own.values()), list(rivals.values())


@pytest.mark.parametrize("most", [1_000, 2])
def test_pairs_with_a_key_in_common_meet_once(spark, most, monkeypatch):
    monkeypatch.setattr(matching, "KEY_ROWS", most)
    own, rivals = rows(1, 60)
    expected = {(o[0], r[0], r[1]) for o in own for r in rivals if keys(o[3:], o[0])[1] & keys(r[4:], r[0])[1]}
    mine = matching.with_keys(spark.createDataFrame(own, OWN)).select(F.col("sku").alias("my_sku"), F.col("keys").alias("my_keys"))
    theirs = matching.with_keys(spark.createDataFrame(rivals, RIVALS)).select(F.col("sku").alias("rival_sku"), "store_id", F.col("keys").alias("their_keys"))
    got = [(r.my_sku, r.rival_sku, r.store_id) for r in matching.joined_on_keys(mine, theirs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_codes_meet_as_they_are_written_or_in_fourteen_digits(spark):
    name = "Hills Biome Cat 1.5kg"
    own = [("A", name, 100, "052742059518", None, None), ("9003579308936", name, 100, None, None, None), ("C", name, 100, "9003579308943carton", None, None), ("12345678-BLK", name, 100, None, None, None), ("15", name, 100, None, None, None)]
    rivals = [("52742059518", "S", name, 90, None, None, None), ("SL-1", "S", name, 90, None, None, "9003579308936"), ("SL-2", "S", name, 90, None, "09003579308943", None), ("12345678", "S", name, 90, None, None, None), ("15", "S", name, 90, None, None, None)]
    got = {(r.my_sku, r.rival_sku, r.method, r.barcode_key) for r in matching.key_matches(spark.createDataFrame(own, OWN), spark.createDataFrame(rivals, RIVALS)).collect()}
    assert got == {("A", "52742059518", "barcode", "gtin14"), ("9003579308936", "SL-1", "barcode", "literal"), ("C", "SL-2", "barcode", "gtin14"), ("15", "15", "sku", None)}


def test_a_placeholder_on_a_third_of_all_rows_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "KEY_ROWS", 50)
    side = lambda name: spark.range(900).select(F.col("id").alias(name), F.when(F.col("id") % 3 == 0, F.array(F.lit("0" * 14))).otherwise(F.array(F.col("id").cast("string"))).alias("k"))
    mine, theirs = side("a").withColumnRenamed("k", "my_keys"), side("b").withColumnRenamed("k", "their_keys")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "36")
    try:
        pairs = matching.joined_on_keys(mine, theirs)
        by_task = [r.n for r in pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(by_task) == 300 * 300 + 600 and max(by_task) < 300 * 300 / 4


@pytest.mark.parametrize("seed", [2])
def test_crowded_keys_give_the_matches_that_all_pairs_give(spark, seed, monkeypatch):
    r = random.Random(seed)
    own, rivals = rows(seed, 150)
    names = ["Cat Food Dry Adult 1kg", "Cat Food Dry Adult Tuna 1 kg", "Adult Cat Food Dry Tuna 1.05kg", "Dog Toy", "Dog Toy Pack of 6", "Toy 6 pcs", "Toy 1 pcs", "Dog Toy Pack", None, ""]
    own = [(o[0], r.choice(names), r.choice([None, -5, 1, 6, 60, 599, 600, 601, 3600, r.randint(1, 5000)]), *o[3:]) for o in own]
    rivals = [(x[0], x[1], r.choice(names), r.choice([0, 1, 10, 36, 100, 101, 600, 3600, 3601, r.randint(1, 5000)]), *x[4:]) for x in rivals]
    no = spark.createDataFrame([(o[0], x[0]) for o in own for x in rivals if r.random() < 0.2], "my_sku string, rival_sku string")
    yes = spark.createDataFrame([(x[0],) for x in rivals if r.random() < 0.1], "rival_sku string")
    mine, theirs = spark.createDataFrame(own, OWN), spark.createDataFrame(rivals, RIVALS)
    for rulings in ((None, None), (no, yes)):
        got = []
        for most in (1_000, 2):
            monkeypatch.setattr(matching, "KEY_ROWS", most)
            got.append(sorted(map(str, matching.key_matches(mine, theirs, *rulings).collect())))
        assert got[0] == got[1] and len(got[0]) > 50


def test_pairs_of_a_placeholder_are_not_all_made(spark):
    side = lambda n, *more: spark.range(n).select(F.col("id").cast("string").alias("sku"), F.when(F.col("id") % 2 == 0, "Toy 1kg").otherwise("Toy 3kg").alias("name"), (F.col("id") % 997 + 100).alias("cents"), F.lit("00000000").alias("barcode"), *more)
    mine = matching.with_keys(side(4_000)).select(F.col("sku").alias("my_sku"), F.col("keys").alias("my_keys"), F.col("literals").alias("my_literals"), F.col("name").alias("my_name"), F.col("cents").alias("my_cents"))
    theirs = matching.with_keys(side(6_000, F.lit("S").alias("store_id"))).select(F.col("sku").alias("rival_sku"), "store_id", F.col("keys").alias("their_keys"), F.col("literals").alias("their_literals"), F.col("name").alias("rival_name"), F.col("cents").alias("rival_cents"), F.lit(False).alias("sure"))
    named = lambda rows, of, name: rows.join(matching.said(rows.select(F.col(name).alias("name"))).select(F.col("name").alias(name), *(F.col(c).alias(f"{of}_{c}") for c in ("pack", "stated", "grams", "words"))), name)
    mine, theirs = named(mine, "my", "my_name"), named(theirs, "their", "rival_name")
    crowded = matching.crowded_keys(mine, theirs)
    assert matching.joined_on_keys(mine, theirs, crowded).count() == 0
    found = matching.best_of_crowd(mine, theirs, crowded, None).select("my_sku", "my_cents", "rival_cents", "rival_sku").collect()
    assert len(found) == 4_000
    first = {kind: sorted((i % 997 + 100, str(i)) for i in range(6_000) if i % 2 == kind) for kind in (0, 1)}
    for r in found:
        assert (r.rival_cents, r.rival_sku) == next((c, s) for c, s in first[int(r.my_sku) % 2] if c * 6 > r.my_cents)
