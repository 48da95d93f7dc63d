"""The log of readings stored by pair: in buckets of (sku, store_id), each one file sorted by pair and time.

What groups or windows by pair reads such a table without a shuffle, and what orders a pair's readings by time without a sort. The table is
written once a load and belongs to the warehouse that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.operators.rollups import PAIR

#: A bucket's size to aim at: a bucket is one task's work.
ROWS_A_BUCKET, LEAST, MOST = 2_000_000, 8, 65_536
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def buckets_for(rows: int) -> int:
    """A power of two, so that tables of several sizes still meet bucket by bucket."""
    n = LEAST
    while n < MOST and n * ROWS_A_BUCKET < rows:
        n *= 2
    return n


def write(snaps: DataFrame, name: str, buckets: int | None = None) -> None:
    """Write readings as the table `name`. A pair is one bucket's, so one with very many readings makes a large bucket: long_pairs() names them."""
    n = buckets or buckets_for(snaps.count())
    ordered = [*PAIR, "crawled_at", "seq"]
    snaps.repartition(n, *PAIR).sortWithinPartitions(*ordered).write.mode("overwrite").format("parquet").bucketBy(n, *PAIR).sortBy(*ordered).saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The readings of a table of write(), with their buckets and order. The session is told to trust the files' order, as each bucket is one file."""
    spark.conf.set(_ORDER, "true")
    return spark.table(name)


def long_pairs(snaps: DataFrame, most: int) -> DataFrame:
    """Pairs with more than `most` readings, by how many: what to look at before a table is written."""
    return snaps.groupBy(*PAIR).agg(F.count("*").alias("readings")).where(F.col("readings") > most)
