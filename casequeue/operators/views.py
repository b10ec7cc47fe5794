"""Case views, volumes and headline metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINIMUM_NARRATIVE_CHARS = 20

# Reasons in the order they are listed.
REASON_UNCERTAIN = "uncertain_model_route"
REASON_UNTIMELY = "untimely_company_response"
REASON_NO_NARRATIVE = "no_published_narrative"


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as a double; NULL over an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def operational_cases(complaints: DataFrame) -> DataFrame:
    """Cases with the manual-attention flag and its reasons.

    An unknown `timely` is not a reason; only a reported FALSE is.
    """
    uncertain = F.coalesce(F.col("prediction_abstained"), F.lit(False))
    untimely = F.col("timely").eqNullSafe(False)
    silent = F.col("has_narrative").eqNullSafe(False)
    reasons = F.array_compact(
        F.array(
            F.when(uncertain, F.lit(REASON_UNCERTAIN)),
            F.when(untimely, F.lit(REASON_UNTIMELY)),
            F.when(silent, F.lit(REASON_NO_NARRATIVE)),
        )
    )
    return complaints.withColumns(
        {
            "requires_manual_attention": uncertain | untimely | silent,
            "attention_reasons": reasons,
        }
    )


def daily_volume(complaints: DataFrame, dimension: str) -> DataFrame:
    """Rows per received date and label of `dimension`."""
    return complaints.groupBy(
        F.col("date_received").alias("date"), F.col(dimension).alias("label")
    ).agg(F.count("*").alias("count"))


def monthly_response_metrics(complaints: DataFrame) -> DataFrame:
    """Counts and timely rate by month and product; no denominator, no rate."""
    known, timely = F.col("timely").isNotNull(), F.col("timely").eqNullSafe(True)
    grouped = complaints.groupBy(
        F.trunc("date_received", "month").alias("month"), "product"
    ).agg(
        F.count("*").alias("complaint_count"),
        count_where(known).alias("response_status_denominator"),
        count_where(timely).alias("timely_response_count"),
    )
    return grouped.withColumn(
        "timely_response_rate",
        ratio(F.col("timely_response_count"), F.col("response_status_denominator")),
    )


def as_of(complaints: DataFrame) -> DataFrame:
    """One row: the newest received date, or today when there is none."""
    return complaints.agg(
        F.coalesce(F.max("date_received"), F.current_date()).alias("as_of")
    )


def warehouse_stats(complaints: DataFrame, schema_version: str = "1.0.0") -> DataFrame:
    return complaints.agg(
        F.count("*").alias("row_count"),
        F.min("date_received").alias("min_date_received"),
        F.max("date_received").alias("max_date_received"),
    ).withColumn("schema_version", F.lit(schema_version))


def eligible_narratives(complaints: DataFrame) -> DataFrame:
    """Rows the router may learn from: a published text of at least 20 characters."""
    return complaints.where(
        F.col("has_narrative")
        & F.col("narrative").isNotNull()
        & (F.length(F.trim("narrative")) >= MINIMUM_NARRATIVE_CHARS)
        & F.col("product").isNotNull()
    ).select("complaint_id", "date_received", "narrative", "product")


def overview(cases: DataFrame) -> DataFrame:
    """Headline counts and rates in one pass; an empty set reports rates of 0."""
    counts = cases.agg(
        F.count("*").alias("total_complaints"),
        count_where(F.col("has_narrative")).alias("narrative_count"),
        count_where(F.col("timely").isNotNull()).alias("timely_denominator"),
        count_where(F.col("timely").eqNullSafe(True)).alias("timely_response_count"),
        count_where(F.col("requires_manual_attention")).alias("manual_attention_count"),
        count_where(F.col("prediction_abstained")).alias("abstained_count"),
    )

    def share(part: str, whole: str) -> Column:
        return ratio(F.col(part), F.greatest(F.col(whole), F.lit(1)))

    return counts.select(
        "total_complaints",
        "narrative_count",
        share("narrative_count", "total_complaints").alias("narrative_rate"),
        "timely_response_count",
        share("timely_response_count", "timely_denominator").alias("timely_response_rate"),
        "manual_attention_count",
        "abstained_count",
    )


def abstention_rate(overview_row: DataFrame) -> DataFrame:
    return overview_row.select(
        ratio(F.col("abstained_count"), F.col("total_complaints")).alias("abstention_rate")
    )


def mean_cost_per_request(system_row: DataFrame) -> DataFrame:
    return system_row.select(
        ratio(F.col("total_cost_usd"), F.col("request_count")).alias("mean_cost_per_request")
    )
