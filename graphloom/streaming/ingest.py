"""Incremental ingestion: a manifest of fingerprints decides which documents of a batch are new or different."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.functions import text as X
from graphloom.operators.lineage import written
from graphloom.operators.triples import change_set


def manifest(sources: DataFrame, path: str = "path", content: str = "content", canonical: str | None = None, order: str | None = None) -> DataFrame:
    """(path, fingerprint); of several rows of a path the last by ``order`` counts (without one, that of greatest hash)."""
    printed = X.fingerprint(F.col(path), F.col(canonical) if canonical else F.lit(None).cast("string"), F.coalesce(F.col(content), F.lit("")))
    rows = sources.select(F.col(path).alias("path"), printed.alias("fingerprint"), F.col(order).alias("at") if order else F.lit(0).alias("at"))
    return rows.groupBy("path").agg(F.max_by("fingerprint", F.struct("at", "fingerprint")).alias("fingerprint"))


def plan(before: DataFrame | None, sources: DataFrame) -> DataFrame:
    """(path, change) of sources against an earlier manifest; without one all are changed."""
    after = manifest(sources)
    if before is None:
        return after.select("path", F.lit("changed").alias("change"))
    return change_set(before, after)


def latest(known: DataFrame) -> DataFrame:
    """(path, fingerprint) of the last part of each path."""
    return known.groupBy("path").agg(F.max_by("fingerprint", "part").alias("fingerprint"))


def compact(spark: SparkSession, manifest_path: str, to: str) -> None:
    """Writes the manifest with a row a path to another folder, to go on from when no stream runs."""
    known = spark.read.schema("path string, fingerprint string, part bigint").parquet(manifest_path)
    known.groupBy("path").agg(F.max_by("fingerprint", "part").alias("fingerprint"), F.max("part").alias("part")).write.partitionBy("part").parquet(to)


def ingest(stream: DataFrame, manifest_path: str, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Feeds ``handle`` the documents of each micro-batch that differ from what the manifest has last of their path.

    The manifest is a Parquet folder with one part a batch, the later counting for a path. A batch that is run again after
    a failure replaces its part. ``compact`` folds the parts of ended batches into one.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest_path)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        known = spark.read.schema("path string, fingerprint string, part bigint").parquet(manifest_path).where(F.col("part") != number) if there else None
        new = manifest(df)
        fresh = new.join(latest(known), ["path", "fingerprint"], "left_anti") if known is not None else new
        fresh = written(fresh)  # read twice, and the stream's rows may not be there again
        handle(df.join(fresh.select("path"), "path", "left_semi"))
        fresh.write.mode("overwrite").parquet(f"{manifest_path}/part={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
