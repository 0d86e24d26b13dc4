"""Service metrics from request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

KEPT = 1000


def latest(rows: DataFrame, key: str, order: Column, n: int = KEPT) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__n") <= n).drop("__n")


def _rate(part: Column, whole: Column, empty: float = 0) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(empty)


def totals(rows: DataFrame, order: str = "event_id") -> DataFrame:
    """One row: requests, errors and their rate; mean, median and 95th percentile of the newest latencies."""
    newest = rows.orderBy(F.desc(order)).limit(KEPT).agg(F.collect_list("latency_ms").alias("l"), F.coalesce(F.round(F.avg("latency_ms")), F.lit(0.0)).alias("avg_ms"))
    sums = rows.agg(F.count("*").alias("total"), F.count_if("error").alias("errors"), F.count_if("escalated").alias("escalations"))
    half = F.when(F.size("l") > 0, F.get(F.array_sort("l"), F.floor(F.size("l") / 2).cast("int"))).otherwise(0)
    # Both sides have one row.
    joined = sums.join(newest)
    return joined.select("total", "errors", _rate(F.col("errors"), F.col("total")).alias("error_rate"), _rate(F.col("escalations"), F.col("total")).alias("escalation_rate"), F.col("avg_ms").cast("bigint").alias("avg_ms"), half.alias("p50_ms"), stats.p95_floor(F.col("l")).alias("p95_ms"))


def by(rows: DataFrame, key: str, order: str = "event_id") -> DataFrame:
    """Per key: calls, failures, success rate, cache hits, and the mean and 95th percentile of the newest latencies."""
    sums = rows.groupBy(key).agg(F.count("*").alias("calls"), F.count_if("error").alias("failures"), F.count_if("cache_hit").alias("cache_hits"), F.count_if("escalated").alias("escalations"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    lat = latest(rows, key, F.desc(order)).groupBy(key).agg(F.collect_list("latency_ms").alias("l"), F.round(F.avg("latency_ms")).cast("bigint").alias("avg_ms"))
    return sums.join(lat, key).select(
        key, "calls", "failures", _rate(F.col("calls") - F.col("failures"), F.col("calls"), 1).alias("success_rate"), "cache_hits", "escalations", "prompt", "completion", "avg_ms",
        stats.nearest(F.col("l"), 0.5).alias("p50_ms"), stats.nearest(F.col("l"), 0.95).alias("p95_ms"),
    )


def hit_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses")).withColumn("hit_rate", _rate(F.col("hits"), F.col("hits") + F.col("misses")))
