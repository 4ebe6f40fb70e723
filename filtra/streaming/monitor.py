"""Requests, QPS and latency per tumbling event-time window and label.

Two steps. The stream keeps one small state row per (window, label, latency value)
with its count, never a row that grows: no percentile buffer, and a label that
holds a third of all requests is spread over its values. In append mode a
window's rows are written (and their state dropped) once the watermark -- max
event time seen minus ``delay`` -- passes its end; events for a window already
written are dropped as late. The second step reads closed windows and takes the
percentiles from the counted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.operators.ordering import join_on
from filtra.operators.stats import weighted_percentiles


def latency_counts(requests: DataFrame, window: str = "1 day", delay: str = "1 hour",
                   keys: Sequence[str] = ("query",), resolution: float | None = None) -> DataFrame:
    """Streaming (or batch) counts: window_start, window_end (epoch seconds), *keys, latency_ms, n.

    ``resolution`` (milliseconds) rounds the values, which bounds the state by the range of
    latencies over it, whatever arrives; percentiles are then off by half of it at most. Without
    it they are exact and the state is bounded by the distinct values.
    """
    value = F.col("latency_ms").cast("double")
    if resolution is not None:
        if resolution <= 0:
            raise ValueError("resolution must be positive")
        value = F.round(value / F.lit(float(resolution))) * F.lit(float(resolution))
    w = (requests.withWatermark("ts", delay).select(F.window("ts", window).alias("w"), *keys, value.alias("latency_ms"))
         .groupBy("w", *keys, "latency_ms").agg(F.count(F.lit(1)).alias("n")))
    return w.select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"),
                    *keys, "latency_ms", "n")


def latency_windows(counts: DataFrame, window_seconds: float = 86400.0, keys: Sequence[str] = ("query",)) -> DataFrame:
    """window_start, window_end, *keys, requests, qps, p50_ms, p99_ms from the counted values of
    closed windows. Requests without a latency count as requests and have no percentile."""
    by = ["window_start", "window_end", *keys]
    total = counts.groupBy(*by).agg(F.sum("n").alias("requests"))
    pct = weighted_percentiles(counts, by, "latency_ms", "n", (0.5, 0.99), ("p50_ms", "p99_ms"))
    return join_on(total, pct, by, "left").select(
        *by, "requests", F.round(F.col("requests") / F.lit(window_seconds), 6).alias("qps"),
        F.round("p50_ms", 6).alias("p50_ms"), F.round("p99_ms", 6).alias("p99_ms"))
