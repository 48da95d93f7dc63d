"""Writing tables: replacing stores, exports, caches and backups."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the product export, as its readers expect them.
EXPORT = ("SKU", "Name (AR)", "Name (EN)", "Category", "Price (SAR)", "Min Price", "Max Price", "Est. Sales", "Est. Revenue", "Sellers", "Stock", "Confidence")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_stores(rows: DataFrame, path: str) -> None:
    """Write rows in place of what the table has of their stores; other stores' rows stay. Doing it again changes nothing."""
    rows.repartition("store_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_id").parquet(path)


def refresh_rollups(snaps: DataFrame, rollups, touched: DataFrame | None, path: str, version: int) -> None:
    """Recompute a rollup (a function of readings) for the touched stores (store_id), or for all, and note the version it was made by.

    One job does all stores; a store whose readings are gone keeps its rows until it is touched again.
    """
    if touched is not None:
        snaps = snaps.join(F.broadcast(touched.select("store_id").distinct()), "store_id", "left_semi")  # a row a store
    replace_stores(rollups(snaps), path)
    snaps.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}-version")


def needs_backfill(spark: SparkSession, path: str, version: int) -> bool:
    """Whether the rollup at path was never made, or by an older version."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}-version").first().version < version
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return True
        raise


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows of EXPORT's columns as CSV with a byte-order mark before the header, for spreadsheets."""
    first, *rest = EXPORT
    named = rows.select(F.col(f"`{first}`").alias("﻿" + first), *(F.col(f"`{c}`") for c in rest))
    named.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def union_of_columns(tables: list[DataFrame]) -> DataFrame:
    """All rows under all columns that any of the tables has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_cache(rows: DataFrame, path: str, key: str, computed_at: datetime) -> None:
    """Rows as JSON texts under a key, with the time they were computed."""
    payload = rows.select(F.to_json(F.struct(*rows.columns)).alias("payload"), F.lit(computed_at).alias("computed_at"), F.lit(key).alias("key"))
    payload.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(path)


def cached(spark: SparkSession, path: str, key: str, as_of: datetime, live, most: timedelta = timedelta(hours=24)) -> DataFrame:
    """What is cached under the key, if it isn't older than `most`, else live(): a function that gives the rows."""
    fresh = live()
    try:
        rows = spark.read.parquet(path).where(F.col("key") == key)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return fresh
        raise
    newest = rows.agg(F.max("computed_at").alias("at")).first().at
    if newest is None or as_of - newest > most:
        return fresh
    return rows.select(F.from_json("payload", fresh.schema).alias("r")).select("r.*")


def due(last: datetime | None, now: datetime, pause: timedelta = timedelta(seconds=600)) -> bool:
    """Whether a cache may be computed again: not within `pause` of the last time."""
    return last is None or now - last >= pause


def backed_up(rows: DataFrame, path: str) -> int:
    """Copy rows to a new table and count both; raises where the copy has fewer or more."""
    rows.write.parquet(path)
    have, want = rows.sparkSession.read.parquet(path).count(), rows.count()
    if have != want:
        raise ValueError(f"the copy at {path} has {have} rows of {want}")
    return have
