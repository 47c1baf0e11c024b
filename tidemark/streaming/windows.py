"""Event-time windows; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay and events.isStreaming else events


def tumbling(events: DataFrame, width: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Counts per window of fixed width and keys: (window_start, keys, n)."""
    return _late(events, delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """As ``tumbling`` for windows that start every ``step``."""
    return _late(events, delay).groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Runs of events closer than ``gap``: (keys, session_start, session_end, n); the end is gap after the last event."""
    return _late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
