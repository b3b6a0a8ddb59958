"""Running light curves of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def light_curve_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, count) of each bin once the watermark has passed it; empty bins have no row, as a stream has no span."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").alias("start"), "count")
