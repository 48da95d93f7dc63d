"""Tables that answer insight pages without reading the log: coverage, day closes, confidence by day, and what moved from close to close.

Each batch adds what its own rows come to. Coverage, closes and confidence are sums or maxima, so adding needs no look at what is there. What
moved depends on the close before: for the pairs of a batch, it is found again from the first day that the batch touches on, from the
kept closes of the stores that the batch has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.operators import rollups
from tarifa.operators.rollups import PAIR
from tarifa.streaming.commits import Commits, State, Table, newest

#: Raised whenever the kept tables' columns or rules change: tables of another version are made anew from the log.
VERSION = 1
CELL = [*PAIR, "day"]
#: The columns of readings that the kept tables are made of.
READ = [*PAIR, "crawled_at", "seq", "cents", "qty", "sold", "in_stock", "confidence"]
#: Pairs of a batch up to which only their known closes are looked at.
FEW_PAIRS = 100_000
COVERAGE, CLOSES, TRUST, MOVES = "coverage", "closes", "trust", "moves"
_SALES = ("units_sold", "rev_sold", "units_qty", "rev_qty", "qty_drop")
_by_cell, _latest_cell = newest(CELL, ["crawled_at", "seq"]), newest(CELL, [])


def _coverage(states: DataFrame) -> DataFrame:
    return rollups.merged_coverage(states)


def _trust(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "day").agg(F.sum("conf_sum").alias("conf_sum"), F.sum("conf_count").alias("conf_count"), F.max("born").alias("born"))


def _closes(snaps: DataFrame) -> DataFrame:
    return rollups.day_closes(snaps).select(*CELL, "crawled_at", "seq", "cents", "qty", "sold")


def _moves(closes: DataFrame) -> DataFrame:
    """What each close differs from the one before by, zeros too: they take the place of older cells. Windows over one partitioning, by pair."""
    cells = rollups.with_drops(closes).select(*closes.columns, "dropped")
    return rollups.with_sales(cells).select(*CELL, "dropped", *_SALES, *(c for c in closes.columns if c == "first_day"))


def kept_tables(snaps: DataFrame) -> dict[str, Table]:
    """The kept tables of readings with the columns of snaps."""
    none = snaps.limit(0)
    return {
        COVERAGE: Table(rollups.coverage_state(none).schema, _coverage), CLOSES: Table(_closes(none).schema, _by_cell, ("store_id",)),
        TRUST: Table(rollups.trust(none).schema, _trust), MOVES: Table(_moves(_closes(none)).schema, _latest_cell),
    }


def kept_rows(batch: DataFrame, commits: Commits, state: State, number: int) -> dict[str, DataFrame]:
    """What a batch of readings adds to the kept tables after the commit `state`."""
    closes = _closes(batch)
    counts = batch.groupBy("store_id").agg(F.approx_count_distinct("sku").alias("n")).where("store_id IS NOT NULL").collect()  # a row a store
    known = commits.read(CLOSES, state, merged=False).where(F.col("store_id").isin([r.store_id for r in counts]))
    if sum(r.n for r in counts) <= FEW_PAIRS:  # else what is known is dealt by pair as it is, once, and other pairs fall out there
        known = known.join(F.broadcast(closes.select(*PAIR).distinct()), PAIR, "left_semi")
    both = known.withColumn("first_day", F.lit(None).cast("date")).unionByName(closes.withColumn("born", F.lit(number).cast("bigint")).withColumn("first_day", F.col("day")))
    # dealt by pair once: the newest row of a cell, the first day touched and what moved are found within a pair
    now = _newest_cells(both.repartition(*PAIR)).withColumn("first_day", F.min("first_day").over(Window.partitionBy(*PAIR)))
    moves = _moves(now.drop("born")).where(F.col("day") >= F.col("first_day")).drop("first_day")
    return {COVERAGE: rollups.coverage_state(batch), CLOSES: closes, TRUST: rollups.trust(batch), MOVES: moves}


def _newest_cells(rows: DataFrame) -> DataFrame:
    """_by_cell() of rows with the day that a batch touches (first_day), which stays with its cell whichever row is the newest."""
    rest = [c for c in rows.columns if c not in (*CELL, "first_day")]
    found = rows.groupBy(*CELL).agg(F.max_by(F.struct(*rest), F.struct("crawled_at", "seq", "born")).alias("r"), F.min("first_day").alias("first_day"))
    return found.select(*CELL, *(f"r.{c}" for c in rest), "first_day")


def refreshed(commits: Commits, batch: DataFrame, number: int) -> None:
    """Add a batch of readings to kept tables that stand alone."""
    state = commits.last()
    commits.publish(number, kept_rows(batch, commits, state, number), {**state.marks, "kept_version": VERSION})


def backfilled(commits: Commits, log: DataFrame, number: int) -> bool:
    """Make the kept tables anew from the whole log, if there are none or they are of an older version; whether that was so."""
    state = commits.last()
    if state.marks.get("kept_version") == VERSION:
        return False
    rows = kept_rows(log, commits, State(), number)
    commits.publish(number, rows, {**state.marks, "kept_version": VERSION}, anew=True)
    return True


def coverage(commits: Commits) -> DataFrame:
    """rollups.coverage() of the log, from the kept tables."""
    return rollups.coverage_of(commits.read(COVERAGE).drop("born"))


def sales_daily(commits: Commits) -> DataFrame:
    """rollups.sales_daily() of the log, from the kept tables."""
    return commits.read(MOVES).where(rollups.SOLD).select("store_id", "sku", "day", *_SALES)


def daily_rollups(commits: Commits) -> DataFrame:
    """rollups.daily_rollups() of the log, from the kept tables."""
    state = commits.last()
    return rollups.rollups_of(commits.read(MOVES, state), commits.read(TRUST, state).drop("born"))
