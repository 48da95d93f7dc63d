"""Alerts on a stream of readings: each product's last two readings are kept, and a batch fires the alerts that its own readings set off."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarifa.operators import audits
from tarifa.streaming.commits import Commits, State, Table

LAST, EVENTS = "last_readings", "alert_events"
_READING = ("crawled_at", "store_id", "seq", "cents", "qty", "in_stock")
_EVENT = "id int, sku int, alert_type string, change_pct double, at timestamp"


def _newest(readings: DataFrame) -> DataFrame:
    """The two newest readings of each product, newest first, as `two`; tasks keep two of their own."""
    order = Window.partitionBy("sku").orderBy(F.desc("crawled_at"), F.desc("store_id"), F.desc("seq"))
    few = readings.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return few.groupBy("sku").agg(F.reverse(F.array_sort(F.collect_list(F.struct(*_READING)))).alias("two"))


def _merged(rows: DataFrame) -> DataFrame:
    both = rows.groupBy("sku").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("two")))), 1, 2).alias("two"), F.max("born").alias("born"))
    return both.select("sku", "two", "born")


def tables(readings: DataFrame) -> dict[str, Table]:
    """The kept tables for readings (sku, store_id, crawled_at, seq, cents, qty, in_stock)."""
    kinds = dict(readings.dtypes)
    return {LAST: Table(_newest(readings.limit(0)).schema, _merged), EVENTS: Table(_EVENT.replace("sku int", f"sku {kinds['sku']}"))}


def _both(two: DataFrame) -> DataFrame:
    return two.select("sku", F.get("two", F.lit(0)).alias("now"), F.get("two", F.lit(1)).alias("before"))


def batch_rows(batch: DataFrame, alerts: DataFrame, commits: Commits, state: State, number: int) -> dict[str, DataFrame]:
    """What a batch adds: its readings, and an event for each active alert that a product's new newest reading sets off against the one before."""
    new = _newest(batch)
    known = commits.read(LAST, state).join(new.select("sku"), "sku", "left_semi")
    after = _merged(known.unionByName(new.withColumn("born", F.lit(number).cast("bigint"))))
    was = known.select("sku", F.get("two", F.lit(0)).alias("was"))
    moved = _both(after).join(was, "sku", "left").where(~F.col("now").eqNullSafe(F.col("was"))).drop("was")
    at = moved.select("sku", F.col("now.crawled_at").cast("timestamp").alias("at"))
    return {LAST: new, EVENTS: audits.judged(alerts, moved).join(at, "sku").select("id", "sku", "alert_type", F.col("change_pct").cast("double").alias("change_pct"), "at")}


def run(stream: DataFrame, alerts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Fire alerts (id, sku, alert_type, threshold, is_active) on a stream of readings; a replayed batch fires once."""
    commits = Commits(stream.sparkSession, root, tables(stream.sparkSession.createDataFrame([], stream.schema)))

    def land(batch: DataFrame, number: int) -> None:
        batch, state = batch.persist(), commits.last()
        commits.publish(number, batch_rows(batch, alerts, commits, state, number))
        batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(commits: Commits, alerts: DataFrame, as_of: datetime | None = None, days: int | None = None) -> DataFrame:
    """audits.fired() of all readings, from the kept ones; with days, only of products that were read in so many days before as_of."""
    rows = _both(commits.read(LAST))
    if days is not None:
        rows = rows.where(F.col("now.crawled_at") >= F.lit(as_of - timedelta(days=days)))
    return audits.judged(alerts, rows)


def events(commits: Commits) -> DataFrame:
    """Everything that has fired, in batches of one commit each."""
    return commits.read(EVENTS).withColumnRenamed("born", "batch")
