"""Event windows: the same plans for tables and, behind a watermark, for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total)."""
    out = _late(events, ts, delay).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(window_start, n) of overlapping windows."""
    return _late(events, ts, delay).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """(user_id, session_start, last_event_end, n): events of a key less than the gap apart."""
    out = _late(events, ts, delay).groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col(key), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
