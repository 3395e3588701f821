"""Gauge samples as a stream: an extension for live wells; the batch operators are the reference semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_rates(samples: DataFrame, width: str = "6 hours", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """well_id, start_ts, end_ts, n, mean, low, high of each tumbling window, closed when the watermark has passed it."""
    x = samples.withWatermark(ts, late).groupBy("well_id", F.window(ts, width)).agg(F.count("rate").alias("n"), F.avg("rate").alias("mean"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    return x.select("well_id", F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "n", "mean", "low", "high")


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to parquet, as much as is there now, exactly once by the checkpoint."""
    return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
