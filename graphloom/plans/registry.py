"""Names of queries, their plans and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_INDEXES: dict[tuple, object] = {}


def text_index(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """The term index of the documents; built once a session for a table as it is (its files and their times)."""
    from graphloom.operators import index

    docs = table(spark, sf_dir, "documents")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(at)
    key = (spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(at).getModificationTime(), size.getLength(), size.getFileCount())
    if key not in _INDEXES:
        _INDEXES[key] = index.build(docs)
    return _INDEXES[key]
