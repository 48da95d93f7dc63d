"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tarifa", **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Rows and bytes that Python gets at a time; rows may hold long texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Make a session ready: Python gets few rows and bytes at a time, which this sets for the whole session, and executors can import this package, which is sent once a context."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not getattr(context, "_tarifa_shipped", False):
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tarifa.zip")
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(path)
        context._tarifa_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a `local` master without that setting one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tarifa_shared", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._tarifa_shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written once to the shared folder as a table, in folders by a column, and read back; who reads it takes the columns that it needs. It stays there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    release(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tarifa_path = path
    return table


def stored_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One stored() table of several with equal columns, each written before the next one is made: of their shuffle files only one's are there at a time."""
    path = None
    for n, df in enumerate(parts):
        path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/turn={n}")
        release(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
    table._tarifa_path = path
    return table


def unstored(table: DataFrame, part: str = "") -> None:
    """Remove a stored() table, or one of its folders (column=value), from which nothing will be read any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table._tarifa_path}/{part}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go: Spark keeps them until the driver collects its garbage, which it may not do for long."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: for loops whose plans would grow, and what is read several times."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
