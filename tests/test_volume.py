from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from casequeue.operators import events, views, volume

AS_OF = date(2026, 8, 21)


def daily(spark, *rows):
    df = spark.createDataFrame(list(rows), "date_received date, product string, n int")
    return df.withColumn("issue", F.lit("x")).select(
        "date_received", "product", "issue", F.explode(F.sequence(F.lit(1), "n"))
    )


def weeks(label, counts, current):
    """Counts of the 8 weeks before the current one, newest first."""
    cutoff = AS_OF - timedelta(days=15)
    rows = [(cutoff - timedelta(days=7 * (i + 1)), label, n) for i, n in enumerate(counts) if n]
    return [*rows, (cutoff, label, current)]


def test_lag_interval_is_left_out(spark):
    rows = [*weeks("a", [2] * 8, 30), (AS_OF - timedelta(days=3), "a", 1000)]
    found = volume.anomaly_report(daily(spark, *rows), as_of=AS_OF, dimensions=["product"]).collect()
    assert [(r["label"], r["current_count"], r["severity"]) for r in found] == [("a", 30, "high")]
    assert found[0]["window_end"] == date(2026, 8, 6) and found[0]["window_start"] == date(2026, 7, 31)
    assert found[0]["robust_z"] == pytest.approx(28 / 3**0.5)


def test_scores_match_the_formula(spark):
    series = {"a": ([3, 9, 4, 0, 7, 5, 5, 2], 12), "b": ([0] * 8, 5), "c": ([10, 30] * 4, 4)}
    rows = [r for label, (base, now) in series.items() for r in weeks(label, base, now)]
    scores = volume.robust_scores(
        volume.window_counts(daily(spark, *rows), ["product"], as_of=AS_OF)
    )
    for r in scores.collect():
        base, now = series[r["label"]]
        ordered = sorted(base)
        median = (ordered[3] + ordered[4]) / 2
        gaps = sorted(abs(n - median) for n in base)
        scale = max(1.4826 * (gaps[3] + gaps[4]) / 2, (median + 1) ** 0.5, 1)
        assert r["baseline_counts"] == base
        assert r["robust_z"] == pytest.approx((now - median) / scale)


def test_small_or_ordinary_counts_are_no_anomaly(spark):
    rows = [*weeks("few", [0] * 8, 4), *weeks("usual", [20] * 8, 22)]
    assert volume.anomaly_report(daily(spark, *rows), as_of=AS_OF).where("dimension = 'product'").isEmpty()


def test_trend_bounds(spark):
    with pytest.raises(ValueError):
        volume.trends(daily(spark, *weeks("a", [1] * 8, 1)), "product", 6)


def test_system_metrics(spark):
    rows = [("summary_generation", True, 100, 0.2), ("summary_refusal", False, 200, None)]
    log = spark.createDataFrame(rows, "event_type string, success boolean, latency_ms long, cost_usd double")
    row = events.system_metrics(log).first()
    assert (row["failure_rate"], row["refusal_rate"], row["request_count"]) == (0.5, 0.5, 2)
    assert (row["p50_latency_ms"], row["total_cost_usd"]) == (150.0, 0.2)
    none = events.system_metrics(log.limit(0)).first()
    assert none["failure_rate"] is None and none["p50_latency_ms"] is None


CASE = "complaint_id string, product string, timely boolean, has_narrative boolean, prediction_abstained boolean"


def test_attention_and_reasons(spark):
    rows = [("1", "p", None, True, False), ("2", "p", False, False, True), ("3", "p", True, True, False)]
    cases = views.operational_cases(spark.createDataFrame(rows, CASE))
    got = {r["complaint_id"]: (r["requires_manual_attention"], r["attention_reasons"]) for r in cases.collect()}
    assert got["1"] == (False, []) and got["3"] == (False, [])
    assert got["2"] == (
        True,
        ["uncertain_model_route", "untimely_company_response", "no_published_narrative"],
    )


def test_overview_of_nothing_is_zero_but_monthly_rate_is_null(spark):
    empty = views.overview(views.operational_cases(spark.createDataFrame([], CASE))).first()
    assert (empty["narrative_rate"], empty["timely_response_rate"]) == (0.0, 0.0)
    rows = spark.createDataFrame([("1", "p", None, True, False)], CASE).withColumn(
        "date_received", F.lit(date(2026, 7, 3))
    )
    assert views.monthly_response_metrics(rows).first()["timely_response_rate"] is None
