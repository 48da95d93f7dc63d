"""What the operators of this subpackage share: the shared folder, words, column access."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: The characters between words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Small tables with at most this many rows are sent to every task; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
#: How many rows a salted join deals each key over.
SALTS = 32
#: Rows of a few numbers that are worth a task of their own.
GATHERED_ROWS = 50_000
#: Stored tables after which the driver gives back what finished jobs have left in it.
RELEASED_AFTER = 6


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and one process does all."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tarifa_folder", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._tarifa_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


class _Paths(threading.local):
    """Paths of the tables that stored() has written in this thread and nobody has removed yet: runs in two threads don't meet."""

    def __init__(self):
        self.paths: list[str] = []
        self.tables = 0


_OWN = _Paths()


def stored_paths() -> set[str]:
    return set(_OWN.paths)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.paths.append(path)
    return path


def stored(df: DataFrame, name: str, **more: Column) -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage and survives lost executors.

    Its rows are counted as they are written, and the aggregates `more` are worked out: seen() has them without another run.
    The table stays as long as what is made of it may be read; who has written that down removes it by remove_stored().
    """
    path, counts = new_path(df.sparkSession, name), Observation()
    df.observe(counts, F.count(F.lit(1)).alias("rows"), *(x.alias(k) for k, x in more.items())).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tarifa_seen = counts.get
    _OWN.tables += 1
    if _OWN.tables % RELEASED_AFTER == 0:
        release(df.sparkSession)
    return table


def gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """df in no more partitions than its rows fill, but in one a core; for narrow tables that come out of a shuffle.

    rows: how many df has at most; None: nobody knows, and df stays as it is. A shuffle's partitions are as many as the session says, each a task and a file,
    however few rows they hold; a chain of small tables then takes its time by their number.
    """
    return df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // GATHERED_ROWS)))


def release(spark: SparkSession) -> None:
    """What finished jobs have left goes: plans and broadcasts in the driver, and shuffle files, which Spark keeps until the driver collects its garbage.

    The driver's heap grows by garbage rather than collect it, though some 100 MB are in use, and many small jobs in a row make much of it.
    """
    spark.sparkContext._jvm.System.gc()


def seen(table: DataFrame) -> dict:
    """What was counted as stored() wrote this very table: `rows`, and what it was asked for besides. A table made of it has no such counts."""
    return table._tarifa_seen


def remove_stored(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove all tables that stored() and new_path() have named in this thread, but for those to keep."""
    keep = set(keep)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _OWN.paths if p not in keep]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        _OWN.paths.remove(path)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """big joined with a table that has one row a key, hot keys included.

    small is stored(), or made of a stored table and given with its number of rows. Up to BROADCAST_ROWS rows it is broadcast; beyond that
    every key is dealt over SALTS partitions, so that a key with a third of all rows is split.
    """
    if (seen(small)["rows"] if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def top(rows: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked: within parts of the group first, so that no task gets all of one."""
    within = Window.partitionBy(*group, "_deal").orderBy(*order)
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns if c not in group)), F.lit(SALTS)))
    rows = rows.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k).drop("_deal")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def word_count(text: Column) -> Column:
    """Words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


#: What workers remember between tasks, by operator.
REMEMBERED: dict[str, dict] = {}


def forget(but: str = "") -> None:
    """Drop what this worker remembers of operators other than `but`: workers live longer than a query."""
    for operator, memory in REMEMBERED.items():
        if operator != but:
            memory.clear()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null counts as empty. Nothing is decoded."""
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(offsets: np.ndarray, limit: int):
    """Row ranges whose texts hold about limit bytes at most; a longer text has a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_ODD, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_ODD, _INVERSE)):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row, dtype=np.uint64)
    return _POWERS


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums from which hashes() reads the hash of any byte range."""
    power = _powers(len(data))[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of the byte ranges, the same wherever they stand."""
    return mix64((sums[ends] - sums[starts]) * _powers(len(sums))[1][: len(sums)][starts])


def word_ranges(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts laid end to end, and how many words precede each text (one more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACES[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)
