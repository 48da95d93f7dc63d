"""The daily ledger: one row a store, product and day at UTC+3, the latest observation winning, sealed half an hour after midnight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarifa.functions.numbers import ksa_day
from tarifa.model import PARTIAL_BELOW
from tarifa.streaming.commits import Commits, State, Table

KEYS = ["store_id", "sku"]
SEAL = "30 minutes"


def day_closes(observations: DataFrame) -> DataFrame:
    """The batch form: store_id, sku, day, close_cents, observations."""
    by_day = observations.groupBy(*KEYS, ksa_day(F.col("observed_at")).alias("day"))
    return by_day.agg(F.max_by("cents", F.struct("observed_at", "id")).alias("close_cents"), F.count("*").alias("observations"))


def sealed_closes(stream: DataFrame) -> DataFrame:
    """The streaming form: a day's row comes out once, when the watermark has passed its seal; later observations are left out. run() keeps them."""
    days = stream.withWatermark("observed_at", SEAL).groupBy(*KEYS, F.window("observed_at", "1 day", "1 day", "21 hours").alias("w"))
    closes = days.agg(F.max_by("cents", F.struct("observed_at", "id")).alias("close_cents"), F.count("*").alias("observations"))
    return closes.select(*KEYS, F.to_date(F.col("w.end")).alias("day"), "close_cents", "observations")


#: The ledger's kept tables: what each batch adds to the closes of days, and the observations that came after their day's seal.
CLOSES, LATE = "ledger", "ledger_late"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, "day").agg(F.max("close").alias("close"), F.sum("observations").alias("observations"), F.max("born").alias("born"))


def ledger_tables(observations: DataFrame) -> dict[str, Table]:
    """The tables that a batch of observations (store_id, sku, cents, observed_at, id) adds to."""
    none = observations.limit(0)
    return {CLOSES: Table(_partial(none).schema, _summed, ("day",)), LATE: Table(none.schema)}


def _partial(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, ksa_day(F.col("observed_at")).alias("day")).agg(F.max(F.struct("observed_at", "id", "cents")).alias("close"), F.count("*").alias("observations"))


def _day_end(day):
    """When a day at UTC+3 ends."""
    return F.to_timestamp(F.date_add(day, 1)) - F.expr("INTERVAL 3 HOURS")


def _clock(state: State):
    """The watermark of a commit, as a column: SEAL before the newest observation of its batches; null before the first."""
    return F.lit(state.marks.get("ledger_clock")).cast("timestamp")


def ledger_rows(batch: DataFrame, state: State) -> tuple[dict[str, DataFrame], dict]:
    """What a batch adds to the ledger's tables after the commit `state`, and its marks.

    A day is sealed once the watermark has passed its end. The watermark moves between batches and never back, so an observation is late if its day was sealed
    when its batch began; late ones are kept as they came, one row each, and change no close.
    """
    sealed = F.coalesce(_day_end(ksa_day(F.col("observed_at"))) <= _clock(state), F.lit(False))
    newest = batch.agg(F.greatest(F.max("observed_at") - F.expr(f"INTERVAL {SEAL}"), _clock(state)).cast("string").alias("clock")).first().clock
    return {CLOSES: _partial(batch.where(~sealed)), LATE: batch.where(sealed)}, {"ledger_clock": newest}


def kept_closes(commits: Commits, sealed: bool = True) -> DataFrame:
    """day_closes() of what came in time, from the kept tables: of the sealed days, or of the open ones."""
    state = commits.last()
    passed = F.coalesce(_day_end(F.col("day")) <= _clock(state), F.lit(False))
    return commits.read(CLOSES, state).where(passed if sealed else ~passed).select(*KEYS, "day", F.col("close.cents").alias("close_cents"), "observations")


def late_observations(commits: Commits) -> DataFrame:
    """Every observation that came after its day's seal."""
    return commits.read(LATE).drop("born")


def run(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the ledger of a stream of observations under root; a batch that is replayed after a lost driver counts once."""
    commits = Commits(stream.sparkSession, root, ledger_tables(stream.sparkSession.createDataFrame([], stream.schema)))

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        commits.publish(number, *ledger_rows(batch, commits.last()))
        batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_days(closes: DataFrame) -> DataFrame:
    """Per store and day: products seen, new and absent, and whether the day is ok, partial or without data."""
    known = closes.groupBy(*KEYS).agg(F.min("day").alias("first_day"))
    days = closes.select("day").distinct()
    grid = known.select("store_id").distinct().crossJoin(days)  # stores x days
    seen = closes.join(known, KEYS).groupBy("store_id", "day").agg(F.count("*").alias("seen"), F.count_if(F.col("day") == F.col("first_day")).alias("first_seen"))
    firsts = known.groupBy("store_id", "first_day").agg(F.count("*").alias("n"))
    before = grid.join(firsts, "store_id").where("first_day < day").groupBy("store_id", "day").agg(F.sum("n").alias("known"))
    rows = grid.join(seen, ["store_id", "day"], "left").join(before, ["store_id", "day"], "left").fillna(0, ["seen", "first_seen", "known"])
    status = F.when(F.col("seen") == 0, "no_data").when(F.col("seen") < PARTIAL_BELOW * F.col("known"), "partial").otherwise("ok")
    return rows.select("store_id", "day", "seen", "first_seen", (F.col("known") - (F.col("seen") - F.col("first_seen"))).alias("absent"), status.alias("status"))
