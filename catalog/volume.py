"""Queries over volumes, trends and anomalies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.operators import volume
from catalog.adapters import CASES_SQL, cases, flat_list, rounded

_AS_OF = date(2000, 1, 15)
_DIMENSIONS = ("product", "issue")


def _lanes(spark, sf_dir):
    """Cases whose issue is the priority and segment: many small series."""
    return cases(spark, sf_dir).withColumn(
        "issue", F.concat_ws("/", "submitted_via", "issue", "product")
    )


def anomaly_windows(spark, sf_dir):
    counts = volume.window_counts(_lanes(spark, sf_dir), _DIMENSIONS, as_of=_AS_OF)
    return flat_list(counts, "baseline_counts")


def robust_scores(spark, sf_dir):
    counts = volume.window_counts(_lanes(spark, sf_dir), _DIMENSIONS, as_of=_AS_OF)
    scores = volume.robust_scores(counts).select(
        "dimension", "label", "current_count", "baseline_median", "baseline_mad", "robust_z"
    )
    return rounded(scores, "robust_z")


def anomaly_report(spark, sf_dir):
    report = volume.anomaly_report(_lanes(spark, sf_dir), as_of=_AS_OF)
    return rounded(report, "robust_z")


def anomaly_direction(spark, sf_dir):
    counts = volume.window_counts(_lanes(spark, sf_dir), _DIMENSIONS, as_of=_AS_OF)
    return volume.robust_scores(counts).select(
        "dimension", "label", volume.anomaly_direction(F.col("robust_z")).alias("direction")
    )


QUERIES = {
    "trends_product": lambda s, d: volume.trends(cases(s, d), "product", 400),
    "trends_issue": lambda s, d: volume.trends(cases(s, d), "issue", 30),
    "anomaly_windows": anomaly_windows,
    "anomaly_scores": robust_scores,
    "anomaly_report": anomaly_report,
    "anomaly_direction": anomaly_direction,
}

_SLOTS = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS c{k}" for k in range(9))
_BASELINE = ", ".join(f"c{k}" for k in range(1, 9))
_SCORES_SQL = f"""WITH {CASES_SQL},
lanes AS (
  SELECT 'product' AS dimension, product AS label, date_received FROM cases
  UNION ALL
  SELECT 'issue', concat_ws('/', submitted_via, issue, product), date_received FROM cases
),
dated AS (
  SELECT *, DATE '2000-01-15' - 15 AS cutoff,
    CAST(floor((DATE '2000-01-15' - 15 - date_received) / 7e0) AS INTEGER) AS k
  FROM lanes
),
slots AS (
  SELECT dimension, label, cutoff, {_SLOTS} FROM dated
  WHERE k BETWEEN 0 AND 8 AND date_received <= cutoff GROUP BY 1, 2, 3
),
medians AS (
  SELECT *, list_median([{_BASELINE}]) AS med FROM slots
),
mads AS (
  SELECT *, list_median(list_transform([{_BASELINE}], lambda c: abs(c - med))) AS mad
  FROM medians
),
scores AS (
  SELECT *, (c0 - med) / greatest(1.4826e0 * mad, sqrt(med + 1e0), 1e0) AS z FROM mads
)"""


def _trend_sql(label: str, days: int) -> str:
    return f"""WITH {CASES_SQL}
SELECT date_received AS date, {label} AS label, count(*) AS count FROM cases
WHERE date_received >= (SELECT max(date_received) FROM cases) - {days - 1} GROUP BY 1, 2"""


ORACLES = {
    "trends_product": _trend_sql("product", 400),
    "trends_issue": _trend_sql("issue", 30),
    "anomaly_windows": f"""{_SCORES_SQL}
SELECT dimension, label, cutoff - 6 AS window_start, cutoff AS window_end,
  c0 AS current_count, array_to_string([{_BASELINE}], ';') AS baseline_counts FROM scores""",
    "anomaly_scores": f"""{_SCORES_SQL}
SELECT dimension, label, c0 AS current_count, med AS baseline_median, mad AS baseline_mad,
  round(z, 6) AS robust_z FROM scores""",
    "anomaly_report": f"""{_SCORES_SQL}
SELECT dimension, label, cutoff - 6 AS window_start, cutoff AS window_end,
  c0 AS current_count, med AS baseline_median, round(z, 6) AS robust_z,
  CASE WHEN z >= 6 THEN 'high' WHEN z >= 4 THEN 'medium' ELSE 'low' END AS severity
FROM scores WHERE c0 >= 5 AND z >= 3""",
    "anomaly_direction": f"""{_SCORES_SQL}
SELECT dimension, label, CASE WHEN z < 0 THEN 'down' ELSE 'up' END AS direction FROM scores""",
}
