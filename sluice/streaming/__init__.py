"""Streams: session states, distinct requests, windowed counts; timers and ledgers in `timers`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.sessions import streamed as session_outcomes


def distinct_requests(events: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Each request once; repeats within the watermark go."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each group in tumbling windows."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width), *by).count()
    return counts.select(F.col("window.start").alias("begins"), *by, F.col("count").alias("n"))


__all__ = ["distinct_requests", "session_outcomes", "windowed_counts"]
