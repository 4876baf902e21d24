"""Request rates and latencies over event time.

Rows later than the watermark delay are dropped; that rule is this library's
own addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def request_rate(df: DataFrame, ts: str, key: str, width: str = "60 seconds", slide: str | None = "10 seconds",
                 delay: str = "1 minute") -> DataFrame:
    """Requests per key in each (sliding) window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = _timed(df, ts, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("requests"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "requests")


def latency(df: DataFrame, ts: str, key: str, value: str, success: Column, width: str, delay: str = "1 minute") -> DataFrame:
    """Mean, approximate p95 and p99, and success rate per key and window."""
    stats = _timed(df, ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(
        F.count("*").alias("requests"), F.avg(value).alias("mean"),
        F.percentile_approx(value, [0.95, 0.99], 1000).alias("tail"), F.avg(success.cast("double")).alias("success_rate"))
    return stats.select(F.col("w.start").alias("start"), key, "requests", "mean", F.col("tail")[0].alias("p95"),
                        F.col("tail")[1].alias("p99"), "success_rate")
