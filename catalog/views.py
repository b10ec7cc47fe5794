"""Queries over case views and headline metrics."""

from __future__ import annotations

from casequeue.operators import events, views
from catalog.adapters import (
    CASES_SQL,
    EVENTS_SQL,
    OPERATIONAL_SQL,
    cases,
    flat_list,
    rounded,
    system_events,
)


def operational_cases(spark, sf_dir):
    return flat_list(
        views.operational_cases(cases(spark, sf_dir)).select(
            "complaint_id", "date_received", "requires_manual_attention", "attention_reasons"
        ),
        "attention_reasons",
    )


def monthly_response_metrics(spark, sf_dir):
    return rounded(views.monthly_response_metrics(cases(spark, sf_dir)), "timely_response_rate")


def overview(spark, sf_dir):
    row = views.overview(views.operational_cases(cases(spark, sf_dir)))
    return rounded(row, "narrative_rate", "timely_response_rate")


def abstention_rate(spark, sf_dir):
    row = views.overview(views.operational_cases(cases(spark, sf_dir)))
    return rounded(views.abstention_rate(row), "abstention_rate")


def system_metrics(spark, sf_dir):
    row = events.system_metrics(system_events(spark, sf_dir), refusal_event="signup")
    return rounded(
        row, "failure_rate", "refusal_rate", "total_cost_usd", "p50_latency_ms", "p95_latency_ms"
    )


def mean_cost_per_request(spark, sf_dir):
    row = events.system_metrics(system_events(spark, sf_dir), refusal_event="signup")
    return rounded(views.mean_cost_per_request(row), "mean_cost_per_request", digits=9)


QUERIES = {
    "operational_cases": operational_cases,
    "daily_product_volume": lambda s, d: views.daily_volume(cases(s, d), "product"),
    "daily_issue_volume": lambda s, d: views.daily_volume(cases(s, d), "issue"),
    "monthly_response_metrics": monthly_response_metrics,
    "warehouse_stats": lambda s, d: views.warehouse_stats(cases(s, d)),
    "eligible_narratives": lambda s, d: views.eligible_narratives(cases(s, d)),
    "overview": overview,
    "abstention_rate": abstention_rate,
    "as_of_date": lambda s, d: views.as_of(cases(s, d)),
    "system_metrics": system_metrics,
    "mean_cost_per_request": mean_cost_per_request,
}

ORACLES = {
    "operational_cases": f"""WITH {OPERATIONAL_SQL}
SELECT complaint_id, date_received, requires_manual_attention, attention_reasons
FROM operational""",
    "daily_product_volume": f"""WITH {CASES_SQL}
SELECT date_received AS date, product AS label, count(*) AS count FROM cases GROUP BY ALL""",
    "daily_issue_volume": f"""WITH {CASES_SQL}
SELECT date_received AS date, issue AS label, count(*) AS count FROM cases GROUP BY ALL""",
    "monthly_response_metrics": f"""WITH {CASES_SQL}
SELECT CAST(date_trunc('month', date_received) AS DATE) AS month, product,
  count(*) AS complaint_count, count(timely) AS response_status_denominator,
  count(*) FILTER (WHERE timely) AS timely_response_count,
  round(CAST(count(*) FILTER (WHERE timely) AS DOUBLE) / nullif(count(timely), 0), 6)
    AS timely_response_rate
FROM cases GROUP BY 1, 2""",
    "warehouse_stats": f"""WITH {CASES_SQL}
SELECT count(*) AS row_count, min(date_received) AS min_date_received,
  max(date_received) AS max_date_received, '1.0.0' AS schema_version FROM cases""",
    "eligible_narratives": f"""WITH {CASES_SQL}
SELECT complaint_id, date_received, narrative, product FROM cases
WHERE has_narrative AND narrative IS NOT NULL AND length(trim(narrative)) >= 20
  AND product IS NOT NULL""",
    "overview": f"""WITH {OPERATIONAL_SQL}
SELECT count(*) AS total_complaints,
  count(*) FILTER (WHERE has_narrative) AS narrative_count,
  round(CAST(count(*) FILTER (WHERE has_narrative) AS DOUBLE) / greatest(count(*), 1), 6)
    AS narrative_rate,
  count(*) FILTER (WHERE timely) AS timely_response_count,
  round(CAST(count(*) FILTER (WHERE timely) AS DOUBLE) / greatest(count(timely), 1), 6)
    AS timely_response_rate,
  count(*) FILTER (WHERE requires_manual_attention) AS manual_attention_count,
  count(*) FILTER (WHERE prediction_abstained) AS abstained_count
FROM operational""",
    "abstention_rate": f"""WITH {CASES_SQL}
SELECT round(CAST(count(*) FILTER (WHERE prediction_abstained) AS DOUBLE)
  / nullif(count(*), 0), 6) AS abstention_rate FROM cases""",
    "as_of_date": f"""WITH {CASES_SQL}
SELECT coalesce(max(date_received), current_date) AS as_of FROM cases""",
    "system_metrics": f"""WITH {EVENTS_SQL}
SELECT count(*) AS request_count, count(*) FILTER (WHERE NOT success) AS failure_count,
  count(*) FILTER (WHERE event_type = 'signup') AS refusal_count,
  round(CAST(count(*) FILTER (WHERE NOT success) AS DOUBLE) / nullif(count(*), 0), 6)
    AS failure_rate,
  round(CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE)
    / nullif(count(*), 0), 6) AS refusal_rate,
  count(latency_ms) AS latency_observation_count,
  round(coalesce(sum(cost_usd), 0), 6) AS total_cost_usd,
  round(CAST(quantile_cont(latency_ms, 0.5) AS DOUBLE), 6) AS p50_latency_ms,
  round(CAST(quantile_cont(latency_ms, 0.95) AS DOUBLE), 6) AS p95_latency_ms
FROM system_events""",
    "mean_cost_per_request": f"""WITH {EVENTS_SQL}
SELECT round(sum(cost_usd) / nullif(count(*), 0), 9) AS mean_cost_per_request
FROM system_events""",
}
