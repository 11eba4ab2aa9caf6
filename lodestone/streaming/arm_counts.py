"""Arm and outcome counts kept up to date over a stream: they are sums, so late rows only add to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_arm_counts(stream: DataFrame, event_time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of arms and events in windows of event time, of a stream with treatment and conversion."""
    t, y = F.col("treatment"), F.col("conversion")
    w = stream.withWatermark(event_time, late).groupBy(F.window(event_time, window))
    out = w.agg(F.sum(t).alias("n1"), F.sum(1 - t).alias("n0"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0"))
    return out.select(F.col("window.start").alias("start"), "n1", "n0", "y1", "y0")
