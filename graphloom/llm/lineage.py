"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs in this process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        at = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is the cluster's to clear then
        pass


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, so that no name of its own, dotted or clashing, matters."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))
