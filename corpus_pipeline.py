"""From documents to packed sequences: quality rules, exact and near copies, source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarifa.llm import stages
from tarifa.llm.shared import new_path, remove_stored, stored_paths
from tarifa.session import ship


def _stage(function):
    return lambda spark, docs, sf_dir: function(_ready(spark, docs))


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship(spark)
    return docs


#: (name, function): each takes (spark, docs, sf_dir) and works on all that the one before has kept.
STAGES = [
    ("quality_rules", _stage(stages.quality_rules)),
    ("exact_dedup", _stage(stages.exact_duplicates)),
    ("near_dedup", _stage(stages.near_duplicates)),
    ("mixing", _stage(stages.mixture)),
    ("packing", _stage(stages.packed)),
]
#: The near-copy and packing stages are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again; what a stage has left there goes once it is written."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_paths()
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove_stored(spark, keep=before | {path})
    return docs
