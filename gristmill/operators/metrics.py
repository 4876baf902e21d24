"""Metrics over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.ordered import percentiles
from gristmill.session import cut_lineage


def run_metrics(log: DataFrame, mode: str, success: Column, latency: str) -> DataFrame:
    """Runs, successes, failures, rate and mean latency per mode."""
    return log.groupBy(mode).agg(
        F.count("*").alias("total_runs"), F.count_if(success).alias("success_count"), F.count_if(~success).alias("failure_count"),
        F.round(F.avg(success.cast("double")), 4).alias("success_rate"), F.round(F.avg(latency), 2).alias("avg_latency"))


def latency_summary(log: DataFrame, latency: str, order: list[Column], samples: int = 1000) -> DataFrame:
    """Mean, min, max, p95 and p99 of the newest samples."""
    recent = cut_lineage(log.orderBy(*order).limit(samples).select(latency))
    tail = percentiles(recent, [], latency, {"p95": 0.95, "p99": 0.99})
    basic = recent.agg(F.count("*").alias("samples"), F.avg(latency).alias("avg"), F.min(latency).alias("min"), F.max(latency).alias("max"))
    return basic.withColumn("__one", F.lit(1)).join(tail.withColumn("__one", F.lit(1)), "__one").drop("__one")


def ratio(hit: Column) -> Column:
    """Share of hits among all rows, 0 without rows."""
    return F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), F.lit(0.0))


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Rows of the same key in the ``seconds`` up to each row.

    Time is cut into spans of that length, so one busy key is counted by many
    tasks. A row counts those of its own span up to its offset, and those of
    the span before from the same offset on. Both counts run on from row to
    row; a sliding frame would count its rows anew for each.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("__at", at).withColumn("__span", F.floor(F.col("__at") / width)).withColumn("__offset", F.col("__at") - F.col("__span") * width)
    copies = F.array_compact(F.array(F.struct(F.col("__span").alias("span"), F.lit(True).alias("own")),
                                     F.when(F.col("__span").isNotNull(), F.struct((F.col("__span") + 1).alias("span"), F.lit(False).alias("own")))))
    spread = rows.withColumn("__c", F.explode(copies))
    span = Window.partitionBy(key, "__c.span").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.count_if("__c.own").over(span.orderBy("__offset"))
    before = F.count_if(~F.col("__c.own")).over(span.orderBy(F.desc("__offset")))
    return spread.withColumn(name, own + before).filter("__c.own").drop("__at", "__span", "__offset", "__c")


def rolling_metrics(df: DataFrame, key: str, ts: str, value: str, success: Column, width: str = "1 day") -> DataFrame:
    """Mean, median and success rate per key and time window."""
    return df.groupBy(F.window(ts, width).alias("w"), key).agg(
        F.count("*").alias("requests"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.5, 10_000).alias("median"),
        F.avg(success.cast("double")).alias("success_rate")).select(F.col("w.start").alias("start"), key, "requests", "mean", "median", "success_rate")
