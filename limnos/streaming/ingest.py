"""Event-time windows and sessions over streams; ``state`` holds what is keyed by content. An addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, width: str, late: str, slide: str | None = None, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and key; rows later than ``late`` are dropped by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    base = events.withWatermark(time, late) if events.isStreaming else events
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = base.groupBy(window.alias("w"), *(keys or [])).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), *[c for c in ("n", "total") if c in out.columns])


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
