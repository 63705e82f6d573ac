"""Event-time windows over the events table, for batches and streams alike (an extension: volumes have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, by: list[str], time: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, by, n, total) of windows of ``value``; on a stream rows later than ``late`` behind the newest are dropped."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    out = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events without a pause of ``gap``."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    out = rows.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
