"""Structured Streaming forms of the report counts, for results that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per key and time window; works on a stream (with a watermark) and on a table alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), key).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), key, "rows")


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a stream forgets keys that are older than the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
