import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-")
    settings = {
        "spark.master": "local[4]", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": f"file://{scratch}/shared",
    }
    made = SparkSession.builder.config(map=settings).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a registered query with its SQL on the smallest tables."""

    def shown(value):
        if value is None:
            return "null"
        return f"{float(value):.9g}" if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)

    def rows(names, found):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(shown(r[i]) for i in order) for r in found)

    def compare(query, sql):
        ours = query(spark, SMALL)
        theirs = duck.execute(sql)
        names = [d[0] for d in theirs.description]
        assert sorted(ours.columns) == sorted(names)
        assert rows(ours.columns, ours.collect()) == rows(names, theirs.fetchall())

    return compare
