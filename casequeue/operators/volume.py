"""Source volumes, trends and robust volume anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.sources.snapshot import in_months

# Fixed values of the anomaly rule.
PUBLICATION_LAG_DAYS = 15
WINDOW_DAYS = 7
BASELINE_WINDOWS = 8
MINIMUM_CURRENT_COUNT = 5
ROBUST_Z_THRESHOLD = 3.0
HIGH_Z = 6.0
MEDIUM_Z = 4.0
MAD_TO_SIGMA = 1.4826


def source_volume(windows: DataFrame) -> DataFrame:
    """Window totals in date order, with whether all of them are exact."""
    exact = windows.agg(F.every(F.col("source_total_relation") == "eq").alias("exact"))
    return windows.withColumn(
        "exact_population_volume", F.coalesce(exact.scalar(), F.lit(True))
    ).orderBy("date_received_min")


def trends(complaints: DataFrame, dimension: str, days: int, as_of: date | None = None) -> DataFrame:
    """Daily volumes of the last `days` days up to the newest received date."""
    if not 7 <= days <= 400:
        raise ValueError("days must be between 7 and 400")
    newest = (
        F.lit(as_of) if as_of else complaints.agg(F.max("date_received").alias("newest")).scalar()
    )
    first = F.date_sub(newest, days - 1)
    recent = in_months(complaints, first, newest).where(F.col("date_received") >= first)
    return (
        recent.groupBy(F.col("date_received").alias("date"), F.col(dimension).alias("label"))
        .agg(F.count("*").alias("count"))
        .orderBy("date", "label")
    )


def window_counts(
    complaints: DataFrame,
    dimensions: Sequence[str],
    *,
    as_of: date | Column,
    lag_days: int = PUBLICATION_LAG_DAYS,
    weight: Column | None = None,
) -> DataFrame:
    """Nine 7-day counts per label of each dimension: the current one, then 8 before.

    One scan of the dated range. Rows are first reduced to counts per window
    and label combination, and only those are unpivoted into dimensions.
    """
    cutoff = F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), lag_days)
    span = WINDOW_DAYS * (BASELINE_WINDOWS + 1)
    received = F.col("date_received")
    slot = F.floor(F.datediff(cutoff, received) / F.lit(WINDOW_DAYS)).cast("int")
    before = F.date_sub(cutoff, span)
    combined = (
        in_months(complaints, before, cutoff)
        .where((received > before) & (received <= cutoff))
        .groupBy(slot.alias("slot"), *dimensions)
        .agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    )
    labelled = combined.select(
        "slot",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label"))
                    for d in dimensions
                ]
            )
        ),
    )
    slots = [
        F.coalesce(F.sum(F.when(F.col("slot") == k, F.col("n"))), F.lit(0)).cast("bigint")
        for k in range(BASELINE_WINDOWS + 1)
    ]
    counts = labelled.groupBy("dimension", "label").agg(
        slots[0].alias("current_count"), F.array(*slots[1:]).alias("baseline_counts")
    )
    return counts.select(
        "dimension",
        "label",
        F.date_sub(cutoff, WINDOW_DAYS - 1).alias("window_start"),
        cutoff.alias("window_end"),
        "current_count",
        "baseline_counts",
    )


def _median(values: Column) -> Column:
    """Median of an array with an even, fixed number of entries."""
    ordered = F.array_sort(values)
    middle = BASELINE_WINDOWS // 2
    return (ordered[middle - 1] + ordered[middle]).cast("double") / F.lit(2.0)


def robust_scores(counts: DataFrame) -> DataFrame:
    """Median, MAD and the robust z of the current window."""
    medians = counts.withColumn("baseline_median", _median(F.col("baseline_counts")))
    spread = F.transform(
        "baseline_counts", lambda n: F.abs(n.cast("double") - F.col("baseline_median"))
    )
    scale = F.greatest(
        F.lit(MAD_TO_SIGMA) * F.col("baseline_mad"),
        F.sqrt(F.col("baseline_median") + F.lit(1.0)),
        F.lit(1.0),
    )
    return medians.withColumn("baseline_mad", _median(spread)).withColumn(
        "robust_z", (F.col("current_count") - F.col("baseline_median")) / scale
    )


def detect(scores: DataFrame) -> DataFrame:
    """Windows that stand out, with a severity."""
    z = F.col("robust_z")
    return scores.where(
        (F.col("current_count") >= MINIMUM_CURRENT_COUNT) & (z >= ROBUST_Z_THRESHOLD)
    ).select(
        "dimension",
        "label",
        "window_start",
        "window_end",
        "current_count",
        "baseline_median",
        "robust_z",
        F.when(z >= HIGH_Z, "high").when(z >= MEDIUM_Z, "medium").otherwise("low").alias("severity"),
    )


def anomaly_report(
    complaints: DataFrame,
    *,
    as_of: date | Column,
    dimensions: Sequence[str] = ("product", "issue"),
    lag_days: int = PUBLICATION_LAG_DAYS,
) -> DataFrame:
    """Anomalies of every dimension, in the order of `dimensions`, strongest first."""
    found = detect(
        robust_scores(window_counts(complaints, dimensions, as_of=as_of, lag_days=lag_days))
    )
    block = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    return found.orderBy(block, F.desc("robust_z"), F.desc("current_count"), "label")


def anomaly_direction(z: Column) -> Column:
    return F.when(z < 0, F.lit("down")).otherwise(F.lit("up"))
