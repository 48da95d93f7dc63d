"""Tables that change together: what a batch writes to several of them becomes visible at once, by one commit file.

A table is a list of Parquet folders, oldest first, each with the rows of a run of batches. A batch adds a folder to the tables it changes. Once
FAN folders of one level stand together, they are merged into one of the next level, so a table of n batches has some FAN * log(n)
folders. The commit file of a batch names every table's folders and small marks; it is renamed into place when all are written. A
batch that was cut off before that has changed nothing: it is written again over its own folders. A batch that has its commit is not done again.

Rows carry `born`, the batch that wrote them; a merge keeps the order of batches, as folders of one level stand together.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarifa.session import release

#: Folders of one level that are merged.
FAN = 4


@dataclass
class State:
    """What the last commit says: its batch, each table's (folder, level)s, marks, and the folders that it has replaced."""

    number: int = -1
    tables: dict[str, list] = field(default_factory=dict)
    marks: dict = field(default_factory=dict)
    replaced: list[str] = field(default_factory=list)


@dataclass
class Table:
    """schema without `born`; merge: rows of several batches to one row a key (nothing: rows are only appended); by: columns that folders are partitioned by."""

    schema: str | StructType
    merge: Callable[[DataFrame], DataFrame] | None = None
    by: tuple[str, ...] = ()


class Commits:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> State:
        folder, files = self._path("_commits")
        if not files.exists(folder):
            return State()
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return State()
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/_commits/{max(numbers)}.json").first().value
        return State(**json.loads(text))

    def read(self, name: str, state: State | None = None, merged: bool = True) -> DataFrame:
        """A table's rows with `born`, as the last commit has them, or as state does."""
        table, folders = self.tables[name], [f for f, _ in (state or self.last()).tables.get(name, [])]
        rows = self._rows(name, folders)
        return table.merge(rows) if merged and table.merge and len(folders) > 1 else rows

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        own = self.tables[name].schema
        schema = (StructType.fromDDL(own) if isinstance(own, str) else StructType(list(own.fields))).add("born", "long")
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}") for f in folders]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.select(*(f.name for f in schema.fields))

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(*self.tables[name].by) if self.tables[name].by else out).parquet(f"{self.root}/{folder}")
        release(self.spark)

    def publish(self, number: int, rows: dict[str, DataFrame], marks: dict | None = None, anew: bool = False) -> None:
        """Write a batch's rows to its tables, merge where it is time, and commit; a batch that is committed already is left as it is.

        anew: the rows stand in place of all that these tables have.
        """
        state = self.last()
        if number <= state.number:
            return
        tables, replaced = {name: list(folders) for name, folders in state.tables.items()}, []
        for name, own in rows.items():
            self._write(own.withColumn("born", F.lit(number).cast("bigint")), name, folder := f"{name}/batch-{number}")
            folders = tables.setdefault(name, [])
            if anew:
                replaced += [f for f, _ in folders]
                folders.clear()
            folders.append([folder, 0])
            level = 0
            while len(folders) >= FAN and all(x[1] == level for x in folders[-FAN:]):
                several = [f for f, _ in folders[-FAN:]]
                together = self._rows(name, several)
                merge = self.tables[name].merge
                level += 1
                self._write(merge(together) if merge else together, name, folder := f"{name}/merged-{number}-{level}")
                folders[-FAN:] = [[folder, level]]
                replaced += several
        self._commit(State(number, tables, marks if marks is not None else state.marks, replaced))
        for old in [*state.replaced, *(f"_commits/{n}.json" for n in (state.number - 1,) if n >= 0)]:  # readers had a batch's time to finish
            path, files = self._path(old)
            files.delete(path, True)
        release(self.spark)

    def _commit(self, state: State) -> None:
        draft, files = self._path(f"_commits/{state.number}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(vars(state)).encode()))
        out.close()
        files.rename(draft, self._path(f"_commits/{state.number}.json")[0])


def newest(keys: list[str], at: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps of each key the row with the greatest `at`, of equals the one of the later batch."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at, "born")).alias("r")).select(*keys, *(f"r.{c}" for c in rest))

    return merge


def first_filled(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps of each key and column the first value that isn't empty; `born` is that of the key's first row."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "born")]
        filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("born"))).alias(c) for c in rest]
        return rows.groupBy(*keys).agg(*filled, F.min("born").alias("born")).select(*keys, *rest, "born")

    return merge
