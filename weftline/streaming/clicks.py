"""An extension: counts of a stream of events per window, with a watermark, by the built-in streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """window_start, window_end, keys, cnt of a stream or a table; rows later than ``late`` are dropped from a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("_w"), *keys).agg(F.count("*").alias("cnt")).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "cnt")
