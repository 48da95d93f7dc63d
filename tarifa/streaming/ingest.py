"""Landing readings in micro-batches: append what changed, keep the newest row of each pair, and count what came late."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarifa.operators.rollups import PAIR

#: Columns whose change makes a reading worth keeping; buckets of pairs that are rewritten each on its own.
WATCHED, BUCKETS = ("cents", "qty", "in_stock", "sold"), 64


def changed(batch: DataFrame, newest: DataFrame) -> DataFrame:
    """Rows of a batch with `late` and `kept`: late is what was read before the newest kept row of its pair, kept what differs from the reading before it or begins a day.

    The reading before is the one in the batch, or the newest kept row. A late row is never `kept`; rows of one time stand in the order of their values.
    """
    watched = [c for c in WATCHED if c in batch.columns]
    known = newest.select(*PAIR, "crawled_at", *watched)
    last = newest.groupBy(*PAIR).agg(F.max("crawled_at").alias("_last"))
    rows = batch.join(last, PAIR, "left").withColumn("late", F.coalesce(F.col("crawled_at") < F.col("_last"), F.lit(False))).drop("_last")
    both = rows.where("NOT late").withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    state, day = F.struct(*watched), F.to_date("crawled_at")
    before = Window.partitionBy(*PAIR).orderBy("crawled_at", "_new", *watched)
    judged = both.withColumn("_before", F.lag(F.struct(state, day)).over(before)).where("_new")
    kept = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(state, day))
    on_time = judged.withColumn("kept", kept).select(*batch.columns, "late", "kept")
    return on_time.unionByName(rows.where("late").withColumn("kept", F.lit(False)).select(*on_time.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key, the newest by `at`; of rows as new as each other the later table's stays."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "_age")).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def fill_empty(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Dimension rows, where a new value only fills an empty one; unseen keys are added."""
    names = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    return both.select(*keys, *(F.coalesce(F.when(F.col(f"o.{c}").cast("string") != "", F.col(f"o.{c}")), F.col(f"n.{c}")).alias(c) for c in names))


def repulled(old: DataFrame, pulled: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Orders after pulling the last days again: those rows replace what is known of them (late changes of status), older ones stay as they are."""
    fresh = pulled.where(F.col("created_at") >= F.lit(as_of - timedelta(days=days))).dropDuplicates(["order_id"])
    return old.join(fresh.select("order_id"), "order_id", "left_anti").unionByName(fresh.select(*old.columns))


def pages_to_read(pages: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Rows (page, created_at, ...) of an order list, newest first, up to and without the first page that is older than `days` as a whole."""
    floor = F.lit(as_of - timedelta(days=days))
    old = pages.groupBy("page").agg(F.max("created_at").alias("newest")).where(F.col("newest") < floor).agg(F.min("page").alias("stop"))
    return pages.crossJoin(F.broadcast(old)).where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")  # one row


def _bucket():
    return F.pmod(F.xxhash64(*PAIR), F.lit(BUCKETS)).cast("int").alias("bucket")


def newest_rows(spark: SparkSession, newest: str, schema, before: int, buckets: list[int] | None = None) -> DataFrame:
    """The newest kept row of each pair after batch `before - 1`: of each bucket (of `buckets`, or all) the folder that was written last."""
    empty = spark.createDataFrame([], schema)
    if not before:
        return empty
    table = spark.read.option("basePath", newest).parquet(f"{newest}/batch=*")
    found = table.select("batch", "bucket").where(F.col("batch") < before)
    last = {r.bucket: r.batch for r in found.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}  # a row a bucket
    parts = [(F.col("bucket") == b) & (F.col("batch") == n) for b, n in last.items() if buckets is None or b in buckets]
    return table.where(reduce(lambda x, y: x | y, parts)).select(*empty.columns) if parts else empty


def run(stream: DataFrame, facts: str, newest: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Append every changed reading to the table at `facts`, a folder a batch, and keep `newest` up to date, rewriting only the buckets that a batch touches.

    Late readings go to the table at `late` (beside facts, if not given), so none is lost and their number is that table's. A batch that is replayed after
    a lost driver overwrites its own folders, so nothing is written twice.
    """
    spark = stream.sparkSession
    late = late or f"{facts.rstrip('/')}-late"

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(_bucket()).distinct().collect()]  # BUCKETS rows at most
        known = newest_rows(spark, newest, batch.schema, number, touched)
        judged = changed(batch, known).persist()
        judged.where("kept").select(*batch.columns).write.mode("overwrite").parquet(f"{facts}/batch={number}")
        judged.where("late").select(*batch.columns).write.mode("overwrite").parquet(f"{late}/batch={number}")
        latest = upsert(known, judged.where("NOT late").select(*batch.columns), PAIR, "crawled_at").select(*batch.columns)
        latest.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{newest}/batch={number}")
        judged.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
