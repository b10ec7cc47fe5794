"""Metrics over the system event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequeue.functions.ranges import continuous_quantiles
from casequeue.operators.views import count_where, ratio

REFUSAL_EVENT = "summary_refusal"


def system_metrics(events: DataFrame, refusal_event: str = REFUSAL_EVENT) -> DataFrame:
    """One row: requests, failures, refusals, cost, interpolated latency quantiles."""
    counts = events.agg(
        F.count("*").alias("request_count"),
        count_where(F.col("success").eqNullSafe(False)).alias("failure_count"),
        count_where(F.col("event_type") == refusal_event).alias("refusal_count"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.count("latency_ms").alias("latency_observation_count"),
    )
    latency = continuous_quantiles(events, "latency_ms", {"p50": 0.5, "p95": 0.95})
    quantiles = latency.select(F.struct("p50", "p95").alias("q")).scalar()
    requests = F.col("request_count")
    return counts.select(
        "request_count",
        "failure_count",
        "refusal_count",
        ratio(F.col("failure_count"), requests).alias("failure_rate"),
        ratio(F.col("refusal_count"), requests).alias("refusal_rate"),
        "latency_observation_count",
        "total_cost_usd",
        quantiles.getField("p50").alias("p50_latency_ms"),
        quantiles.getField("p95").alias("p95_latency_ms"),
    )
