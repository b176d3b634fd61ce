"""Event-time windows; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late else e


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, kind, n, total by window (sliding with ``slide``) and event type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(w.alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """k, start, n by user and session: events less than ``gap`` apart belong together."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("k")).agg(F.count("*").alias("n"))
    return out.select("k", F.col("w.start").alias("start"), "n")
