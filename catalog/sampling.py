"""Queries over selection windows, strata, caps and the sample."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.operators import sampling
from catalog.adapters import CASES_SQL, cases

# Covers every order date of the driver tables, and the cap binds in most windows.
PLAN = sampling.SelectionPlan(as_of=date(2001, 8, 1), max_records=5_000, complete_months=79)


def _population(spark, sf_dir):
    rows = cases(spark, sf_dir).select("complaint_id", "date_received", "product")
    return sampling.assign_stratum(sampling.assign_window(rows, PLAN))


def _drawn(spark, sf_dir):
    rows = cases(spark, sf_dir).select("complaint_id", "date_received", "product")
    return sampling.draw_sample(spark, rows, PLAN)


def _strata(spark, sf_dir):
    daily = sampling.daily_counts(_population(spark, sf_dir))
    return sampling.stratum_totals(daily, sampling.selection_windows(spark, PLAN))


def window_membership(spark, sf_dir):
    return _population(spark, sf_dir).select(
        "complaint_id", "window_name", "window_start", "window_end", "complete_month"
    )


def reconcile_totals(spark, sf_dir):
    totals = sampling.window_totals(sampling.daily_counts(_population(spark, sf_dir)))
    return sampling.require_reconciled(sampling.reconcile_totals(_strata(spark, sf_dir), totals))


def stratified_take(spark, sf_dir):
    taken, _, _ = _drawn(spark, sf_dir)
    return taken.select("complaint_id", "date_received", "window_name", "stratum_start")


def dedup_global(spark, sf_dir):
    """Each sampled case is also offered by the next window; the first one stays."""
    taken, _, _ = _drawn(spark, sf_dir)
    repeated = taken.withColumns(
        {
            "window_start": F.add_months("window_start", 1),
            "window_name": F.concat("window_name", F.lit("-again")),
        }
    )
    return sampling.dedup_global(taken.unionByName(repeated)).select("complaint_id", "window_name")


def retained_per_window(spark, sf_dir):
    taken, _, _ = _drawn(spark, sf_dir)
    return sampling.retained_per_window(sampling.dedup_global(taken))


def final_cap(spark, sf_dir):
    taken, _, _ = _drawn(spark, sf_dir)
    deduped = sampling.dedup_global(taken)
    return sampling.final_cap(deduped, 1_000).select("complaint_id", "date_received")


def sampling_report(spark, sf_dir):
    taken, caps, totals = _drawn(spark, sf_dir)
    return sampling.sampling_report(caps, taken, totals)


QUERIES = {
    "selection_windows": lambda s, d: sampling.selection_windows(s, PLAN).join(
        sampling.window_totals(sampling.daily_counts(_population(s, d))).drop("window_relation"),
        "window_name",
        "left",
    ),
    "window_membership": window_membership,
    "weekly_strata": lambda s, d: _population(s, d).select(
        "complaint_id", "stratum_start", "stratum_end"
    ),
    "stratum_totals": lambda s, d: _strata(s, d).select(
        "window_name", "stratum_start", "stratum_end", "source_total"
    ),
    "reconcile_totals": reconcile_totals,
    "allocate_caps": lambda s, d: sampling.allocate_caps(_strata(s, d)).select(
        "window_name", "stratum_start", "source_total", "selection_cap", "stratum_cap"
    ),
    "stratified_take": stratified_take,
    "dedup_global": dedup_global,
    "retained_per_window": retained_per_window,
    "final_cap": final_cap,
    "sampling_report": sampling_report,
}

_WINDOWS_SQL = f"""WITH {CASES_SQL},
windows AS (
  SELECT strftime(m, '%Y-%m') || CASE WHEN i = 79 THEN '-current-slice' ELSE '' END
      AS window_name,
    CAST(m AS DATE) AS window_start,
    CASE WHEN i = 79 THEN DATE '2001-08-02' ELSE CAST(m + INTERVAL 1 MONTH AS DATE) END
      AS window_end,
    CAST(5000 // 80 + CASE WHEN i >= 80 - 5000 % 80 THEN 1 ELSE 0 END AS BIGINT)
      AS selection_cap,
    i < 79 AS complete_month
  FROM (SELECT i, TIMESTAMP '1995-01-01' + to_months(CAST(i AS INTEGER)) AS m
        FROM range(80) r(i))
),
population AS (
  SELECT complaint_id, date_received, product, w.*,
    window_start + 7 * CAST(floor((date_received - window_start) / 7e0) AS INTEGER)
      AS stratum_start
  FROM cases JOIN windows w ON date_received >= window_start AND date_received < window_end
),
calendar AS (
  SELECT w.*, CAST(s AS DATE) AS stratum_start,
    least(CAST(s AS DATE) + 7, window_end) AS stratum_end
  FROM windows w, LATERAL (SELECT unnest(generate_series(
    CAST(window_start AS TIMESTAMP), CAST(window_end - 1 AS TIMESTAMP), INTERVAL 7 DAY)) AS s)
),
strata AS (
  SELECT c.*, count(complaint_id) AS source_total
  FROM calendar c LEFT JOIN population p USING (window_name, stratum_start)
  GROUP BY ALL
),
sums AS (
  SELECT *, sum(source_total) OVER (PARTITION BY window_name) AS total FROM strata
),
quotas AS (
  SELECT *, least(selection_cap, total) AS target,
    coalesce(CAST(least(selection_cap, total) * source_total AS DOUBLE) / nullif(total, 0), 0)
      AS quota
  FROM sums
),
shares AS (
  SELECT *, floor(quota) AS base,
    target - sum(floor(quota)) OVER (PARTITION BY window_name) AS leftover,
    row_number() OVER (PARTITION BY window_name
      ORDER BY quota - floor(quota) DESC, source_total DESC, stratum_start) AS place
  FROM quotas
),
caps AS (
  SELECT window_name, stratum_start, stratum_end, source_total, selection_cap,
    CAST(base + CASE WHEN place <= leftover AND base < source_total THEN 1 ELSE 0 END
      AS BIGINT) AS stratum_cap
  FROM shares
),
taken AS (
  SELECT * FROM (
    SELECT p.*, stratum_cap, row_number() OVER (PARTITION BY window_name, stratum_start
      ORDER BY date_received DESC, complaint_id DESC) AS rn
    FROM population p JOIN caps c USING (window_name, stratum_start))
  WHERE rn <= stratum_cap
)"""

ORACLES = {
    "selection_windows": f"""{_WINDOWS_SQL}
SELECT w.*, t.window_total FROM windows w LEFT JOIN
  (SELECT window_name, count(*) AS window_total FROM population GROUP BY 1) t
  USING (window_name)""",
    "window_membership": f"""{_WINDOWS_SQL}
SELECT complaint_id, window_name, window_start, window_end, complete_month FROM population""",
    "weekly_strata": f"""{_WINDOWS_SQL}
SELECT complaint_id, stratum_start, least(stratum_start + 7, window_end) AS stratum_end
FROM population""",
    "stratum_totals": f"""{_WINDOWS_SQL}
SELECT window_name, stratum_start, stratum_end, source_total FROM strata""",
    "reconcile_totals": f"""{_WINDOWS_SQL}
SELECT window_name, CAST(strata_total AS BIGINT) AS strata_total,
  coalesce(n, 0) AS window_total, CAST(strata_total - coalesce(n, 0) AS BIGINT) AS delta,
  true AS exact, strata_total = coalesce(n, 0) AS reconciled
FROM (SELECT window_name, sum(source_total) AS strata_total FROM strata GROUP BY 1)
LEFT JOIN (SELECT window_name, count(*) AS n FROM population GROUP BY 1) USING (window_name)""",
    "allocate_caps": f"""{_WINDOWS_SQL}
SELECT window_name, stratum_start, source_total, selection_cap, stratum_cap FROM caps""",
    "stratified_take": f"""{_WINDOWS_SQL}
SELECT complaint_id, date_received, window_name, stratum_start FROM taken""",
    "dedup_global": f"{_WINDOWS_SQL} SELECT complaint_id, window_name FROM taken",
    "retained_per_window": f"""{_WINDOWS_SQL}
SELECT window_name, count(*) AS selected_sample_rows FROM taken GROUP BY 1""",
    "final_cap": f"""{_WINDOWS_SQL}
SELECT complaint_id, date_received FROM taken
ORDER BY date_received DESC, complaint_id DESC LIMIT 1000""",
    "sampling_report": f"""{_WINDOWS_SQL}
SELECT window_name, stratum_start, stratum_end, source_total,
  'eq' AS source_total_relation, stratum_cap, coalesce(n, 0) AS retrieved,
  coalesce(t, 0) AS window_total,
  CAST(sum(source_total) OVER (PARTITION BY window_name) - coalesce(t, 0) AS BIGINT)
    AS window_delta
FROM caps
LEFT JOIN (SELECT window_name, stratum_start, count(*) AS n FROM taken GROUP BY 1, 2)
  USING (window_name, stratum_start)
LEFT JOIN (SELECT window_name, count(*) AS t FROM population GROUP BY 1) USING (window_name)""",
}
