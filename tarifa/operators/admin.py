"""Windows, audits, clean-ups and feeds around the tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.model import WEIGHT_RATIO
from tarifa.operators.catalogue import barcode_key_set, truthy
from tarifa.operators.matching import price_sane


def on_day(rows: DataFrame, day: date, at: str = "crawled_at") -> DataFrame:
    """Rows of one UTC day."""
    return rows.where((F.col(at) >= F.lit(datetime(day.year, day.month, day.day))) & (F.col(at) < F.lit(datetime(day.year, day.month, day.day) + timedelta(days=1))))


def between(rows: DataFrame, first: date, last: date, at: str = "crawled_at") -> tuple[DataFrame, int]:
    """Rows of all days from first to last, and how many days that is for rates."""
    start, stop = datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day) + timedelta(days=1)
    return rows.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(stop))), max(1, (stop - start).days)


def on_shop_days(rows: DataFrame, first: date, last: date, at: str = "created_at") -> DataFrame:
    """Rows of the shop's days from first to last, at UTC+3."""
    start, stop = datetime(first.year, first.month, first.day) - timedelta(hours=3), datetime(last.year, last.month, last.day) + timedelta(hours=21)
    return rows.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(stop)))


def subcategories(products: DataFrame, samples: int) -> DataFrame:
    """Food products by subcategory, or by category where the name doesn't say: count, share in percent, and the first names by sku."""
    kind = text.category(F.col("name"))
    rows = products.select("sku", "name", kind.alias("parent")).where(F.col("parent").isin("cat_food", "dog_food"))
    rows = rows.withColumn("bucket", F.coalesce(text.food_form(F.col("parent"), F.col("name")), "parent"))
    part = F.pmod(F.xxhash64("sku"), F.lit(64))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket", part).orderBy("sku"))).where(F.col("place") <= samples)  # of each part of a bucket
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("sku"))).where(F.col("place") <= samples)
    shown = few.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sku", "name"))), lambda x: x["sku"].cast("string")), ",").alias("samples"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("products"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_")))).withColumn("pct", F.round(F.col("products") * 100 / F.col("all_"), 1)).drop("all_").join(shown, "bucket")  # one row


def reclassified(products: DataFrame) -> DataFrame:
    """sku, old, category, subcategory: products by their names; one that has a category of food keeps to food, and one that hasn't doesn't become food."""
    foods = ("cat_food", "dog_food", "bird_food", "fish_food", "pet_food")
    fresh = text.category(F.col("name"))
    crosses = F.col("category").isin(*foods) != fresh.isin(*foods)
    kept = F.when(F.col("category").isNull() | ~crosses, fresh).otherwise(F.col("category"))
    rows = products.select("sku", "name", F.col("category").alias("old"), kept.alias("category"))
    return rows.withColumn("subcategory", text.food_form(F.col("category"), F.col("name"))).drop("name")


def missing_sellers(own: DataFrame, rivals: DataFrame, links: DataFrame) -> DataFrame:
    """my_sku, rival_sku, store_id, cause of rival rows that share a barcode key with an own product and have no match.

    cause: blocked_by_guard (pack, weight or price), other (the codes agree as they stand), competitor_barcode, gtin14_normalization.
    """
    mine = own.select(F.col("sku").alias("my_sku"), F.col("barcode").alias("my_barcode"), F.col("name").alias("my_name"), F.coalesce(truthy(F.col("sale_cents")), F.col("cents")).alias("my_cents"))
    mine = mine.withColumn("keys", barcode_key_set(F.col("my_barcode"), F.col("my_sku")))
    theirs = rivals.select(F.col("sku").alias("rival_sku"), "store_id", F.col("barcode").alias("rival_barcode"), F.col("name").alias("rival_name"), F.col("cents").alias("rival_cents"))
    theirs = theirs.withColumn("k", F.explode(barcode_key_set(F.col("rival_barcode"), F.col("rival_sku"))))
    pairs = mine.withColumn("k", F.explode("keys")).join(theirs, "k").drop("k").dropDuplicates(["my_sku", "rival_sku", "store_id"])
    pairs = pairs.join(links.select("my_sku", "rival_sku", "store_id"), ["my_sku", "rival_sku", "store_id"], "left_anti")
    fits = text.packs_agree(F.col("my_name"), F.col("rival_name")) & text.weights_agree(text.weight_grams(F.col("my_name")), text.weight_grams(F.col("rival_name")), WEIGHT_RATIO)
    sane = price_sane(F.col("my_cents"), F.col("rival_cents"), F.col("my_name"), F.col("rival_name"))
    low = lambda *names: F.array_compact(F.array(*(F.lower(F.col(n).cast("string")) for n in names)))
    cause = (
        F.when(~(fits & sane), "blocked_by_guard").when(F.arrays_overlap(low("my_barcode", "my_sku"), low("rival_barcode", "rival_sku")), "other")
        .when(F.coalesce(F.array_contains("keys", text.canonical_barcode(F.col("rival_barcode"))), F.lit(False)), "competitor_barcode").otherwise("gtin14_normalization")
    )
    return pairs.select("my_sku", "rival_sku", "store_id", cause.alias("cause"))


def orphans(products: DataFrame, snaps: DataFrame) -> DataFrame:
    """Products without any reading."""
    return products.join(snaps.select("sku"), "sku", "left_anti").select("sku")


def bare_domain(value: Column) -> Column:
    """A domain without scheme, www. and path, in lower case."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "^https?://", ""), r"^www\.", "")
    return F.trim(F.substring_index(d, "/", 1))


def keep_list(stores: DataFrame, wanted: DataFrame) -> DataFrame:
    """store_id, name, domain, kept: which stores a list (keep_name, keep_domain) keeps, by domain, and by name only where no store has the domain."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    rows = stores.select("store_id", "name", bare_domain(F.col("domain")).alias("d"), plain(F.col("name")).alias("n"))
    asked = wanted.select(bare_domain(F.col("keep_domain")).alias("d"), plain(F.col("keep_name")).alias("n"))
    by_domain = asked.join(rows.select("d", "store_id"), "d").select("store_id")
    by_name = asked.join(rows.select("d"), "d", "left_anti").join(rows.select("n", "store_id"), "n").select("store_id")
    kept = by_domain.union(by_name).distinct().withColumn("kept", F.lit(True))
    return rows.join(kept, "store_id", "left").select("store_id", "name", F.coalesce("kept", F.lit(False)).alias("kept"))


def cascade_counts(doomed: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """store_id, table, rows: what deleting stores would take from each table with a store_id."""
    out = None
    for name, rows in tables.items():
        counts = rows.join(F.broadcast(doomed.select("store_id")), "store_id", "left_semi").groupBy("store_id").agg(F.count("*").alias("rows")).withColumn("table", F.lit(name))  # a row a store
        out = counts if out is None else out.unionByName(counts)
    return out


def without_stores(rows: DataFrame, doomed: DataFrame, confirmed: int, most: int) -> DataFrame:
    """rows of other stores. Refuses unless `confirmed` is the number of stores to go and that is at most `most`."""
    n = doomed.select("store_id").distinct().count()
    if n != confirmed or n > most:
        raise ValueError(f"{n} stores would go; confirmed are {confirmed}, at most {most}")
    return rows.join(F.broadcast(doomed.select("store_id")), "store_id", "left_anti")  # `most` rows at most


def newest_with_platform(snaps: DataFrame, meta: DataFrame, limit: int) -> DataFrame:
    """The latest readings with their store's platform; an unknown store has an empty one."""
    first = snaps.orderBy(F.desc("crawled_at"), "sku", "store_id", "seq").limit(limit)
    return first.join(F.broadcast(meta.select("store_id", "platform", "is_own")), "store_id", "left").withColumns({"platform": F.coalesce("platform", F.lit("")), "is_own": F.coalesce("is_own", F.lit(False))})  # a row a store


def transfer_usage(log: DataFrame, as_of: datetime, limit_bytes: int) -> DataFrame:
    """Bytes of a log (at, bytes) today and this month, and the share of the month's limit in percent; one row."""
    day, month = as_of.replace(hour=0, minute=0, second=0, microsecond=0), as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    total = lambda start: F.coalesce(F.sum(F.when(F.col("at") >= F.lit(start), F.col("bytes"))), F.lit(0))
    return log.agg(total(day).alias("bytes_today"), total(month).alias("bytes_month"), F.round(total(month) * 100 / limit_bytes, 4).alias("pct_used"))


def import_status(rows: DataFrame, at: str) -> DataFrame:
    """How many rows a table has, and from when to when; one row."""
    return rows.agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))


def seller_coverage(found: DataFrame) -> DataFrame:
    """Products by sellers() before matches were followed and after, over products with any; one row."""
    kept = found.where("NOT excluded").groupBy("sku").agg(F.count_if(F.col("match_source") == "sku").alias("before"), F.countDistinct("store_id").alias("after"))
    return kept.agg(F.count("*").alias("products"), F.sum("before").alias("sellers_before"), F.sum("after").alias("sellers_after"), F.count_if(F.col("after") > F.col("before")).alias("products_gaining"))


def notifications(events: DataFrame, as_of: datetime, top: int = 10) -> DataFrame:
    """The newest alert events (id, at) with whether each is unread: from the last 24 hours."""
    return events.orderBy(F.desc("at"), "id").limit(top).withColumn("unread", F.col("at") > F.lit(as_of - timedelta(hours=24)))


def feed(rows: DataFrame, sort_by: str, top: int, where: Column | None = None) -> DataFrame:
    """The newest rows of a log, a digest list or saved filters."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(sort_by), *[c for c in rows.columns if c != sort_by]).limit(top)


def seasons_in(events: DataFrame, first: date, last: date) -> DataFrame:
    """Seasonal events (name, start, stop) that begin in a range, as lines (one day) or areas."""
    shown = events.where(F.col("start").between(F.lit(first), F.lit(last)))
    return shown.withColumn("kind", F.when(F.col("start") == F.col("stop"), "line").otherwise("area"))


def days_in_season(days: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (day, ...) with the seasonal events that hold their day; events are a small table of a few dozen rows, sent to every task."""
    return days.join(F.broadcast(events), F.col("day").between(F.col("start"), F.col("stop")))


def own_purge(snaps: DataFrame, own_store: str, dry_run: bool = True) -> DataFrame:
    """The readings without the own store's, or, on a dry run, how many those are; one row."""
    if dry_run:
        return snaps.agg(F.count_if(F.col("store_id") == own_store).alias("would_delete"), F.count("*").alias("rows"))
    return snaps.where(F.col("store_id") != own_store)


def absent_flagged(own: DataFrame, seen: DataFrame) -> DataFrame:
    """Own rows after a sync: those that it didn't see are no longer present. A sync that saw nothing changes nothing."""
    if not seen.limit(1).count():
        return own
    there = seen.select("sku").distinct().withColumn("there", F.lit(True))
    return own.join(there, "sku", "left").withColumn("present", F.coalesce("there", F.lit(False))).drop("there").select(*own.columns)


def discovered(own: DataFrame, seen: DataFrame, method: str) -> DataFrame:
    """Own rows, and those of a sync whose sku is new, marked with how they were found; known rows stay as they are."""
    new = seen.dropDuplicates(["sku"]).join(own.select("sku"), "sku", "left_anti").withColumn("discovered_via", F.lit(method))
    return own.unionByName(new, allowMissingColumns=True)
