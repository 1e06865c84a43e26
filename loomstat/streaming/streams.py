"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .processors import ALERTS, BUCKET_US, DAY_US, DECISIONS, MINUTE_US, SUMS, BucketSums, Crossings, Decisions


def sliding_summary(metrics: DataFrame, length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Count, successes and mean time for each sliding window; events later than the window's length are dropped."""
    return (
        metrics.withWatermark("ts", length)
        .groupBy(F.window("ts", length, step))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(F.col("success").cast("long")).alias("successes"),
            F.avg(F.when(F.col("success"), F.col("processing_ms"))).alias("avg_ms"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "successes", "avg_ms")
    )


def error_spikes(errors: DataFrame, length: str = "10 minutes", more_than: int = 5) -> DataFrame:
    """Error types that come more than so often in a window."""
    return (
        errors.withWatermark("ts", length)
        .groupBy(F.window("ts", length, "1 minute"), "error_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > more_than)
        .select(F.col("window.start").alias("start"), "error_type", "n")
    )


def admission(usage: DataFrame, limits: dict[str, dict[str, float]], lateness: str = "10 minutes") -> DataFrame:
    """Decisions as the batch query ``rate_limit_admission`` makes them, for requests of all APIs in ``limits``.

    ``usage`` has id, api_type, us (microseconds), tokens and cost (micro-units, long).  ``limits`` of an API: rpm, rpd,
    tpm, tpd and day_cost.  A full day rejects (cost, requests, tokens, in this order), a full minute delays until its
    oldest request leaves it.  What counts is all that came in the day (minute) before, up to but without the same instant.

    Each request asks three time buckets how much of them lies before a time; a bucket answers from the prefix sums of
    what it holds, and tells the buckets of the next day its totals.  So a request never reads a day again, keys are API
    and time bucket, and timers drop a bucket a day after its end.  Rows that come out of order are judged by what has come.
    """
    known = usage.filter(F.col("api_type").isin(*limits))
    timed = known.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("us") - back).alias("x")) for k, back in enumerate((0, MINUTE_US, DAY_US))]))
    asked = timed.select("api_type", "ts", "id", "us", "tokens", "cost", asks.alias("a"))
    asked = asked.select("api_type", F.floor(F.col("a.x") / BUCKET_US).alias("bucket"), "ts", "id", "us", "tokens", "cost", "a.kind", "a.x")
    sums = asked.groupBy("api_type", "bucket").transformWithStateInPandas(BucketSums(), SUMS, "append", "EventTime", eventTimeColumnName="ts")
    return sums.groupBy("api_type", "bucket").transformWithStateInPandas(Decisions(limits), DECISIONS, "append", "EventTime")


def error_alerts(errors: DataFrame, span_us: int = 600_000_000, more_than: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """``id``, ``key``, ``n`` of each error (id, error_type, us) at which its type's count of the last span first passes a bound.

    An alert fires once at the crossing, and again only after the count has been at the bound or under it.
    """
    timed = errors.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    return timed.groupBy("error_type").transformWithStateInPandas(Crossings(span_us, more_than), ALERTS, "append", "EventTime")
