"""Queries over the review queue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.operators import queue, search_index
from casequeue.operators.views import operational_cases
from casequeue.sources.handover import shared_folder
from casequeue.sources.ordered import stored_total
from catalog.adapters import OPERATIONAL_SQL, REVIEWS_SQL, cases, reviews, table

_SEARCH = "eau"
_STORED_ROWS = 2_000
_AFTER = (date(1998, 1, 1), "5000")


def _cases(spark, sf_dir):
    return operational_cases(cases(spark, sf_dir))


def _shown(df):
    return df.select(
        "complaint_id", "date_received", "product", "issue", "route_status", "assigned_product"
    )


def _routed(spark, sf_dir):
    return queue.with_routes(_cases(spark, sf_dir), reviews(spark, sf_dir), tie="review_id")


def _prioritized(spark, sf_dir):
    given = F.when(F.col("submitted_via") == "1", F.lit("URGENT")).when(
        F.col("submitted_via") == "5", F.lit("low")
    )
    return _cases(spark, sf_dir).withColumn(
        "priority", queue.priority(given, F.col("requires_manual_attention"))
    )


def _ranked(df, mode, column):
    """Every case with the column it is sorted by and its place in the order."""
    return queue.queue_rank(df, mode).select("complaint_id", column, "place")


def queue_page(spark, sf_dir):
    page = queue.queue_page(
        queue.filter_queue(_cases(spark, sf_dir), manual_attention=True),
        reviews(spark, sf_dir),
        page=2,
        size=50,
        tie="review_id",
    )
    return _shown(page)


def stored_queue_page(spark, sf_dir):
    """A page behind some nine tenths of the cases, read from a queue stored in ranges."""
    path = shared_folder(spark)
    stored = _cases(spark, sf_dir).select("complaint_id", "date_received", "product", "issue")
    queue.write_queue(stored, path, rows=_STORED_ROWS)
    pages = stored_total(spark, path) // 50
    page = queue.stored_queue_page(
        spark, path, reviews(spark, sf_dir), page=1 + pages * 9 // 10, size=50, tie="review_id"
    )
    return _shown(page)


def queue_page_after(spark, sf_dir):
    page = queue.queue_page_after(
        _cases(spark, sf_dir), reviews(spark, sf_dir), _AFTER, size=50, tie="review_id"
    )
    return _shown(page)


def search_indexed(spark, sf_dir):
    """The rows of `search_cases`, found by posting lists written before."""
    path, found = shared_folder(spark), _cases(spark, sf_dir)
    search_index.write_search_index(found, path)
    return search_index.indexed_search(spark, path, found, _SEARCH).select("complaint_id", "product")


def filter_queue(spark, sf_dir):
    found = queue.filter_queue(
        _cases(spark, sf_dir), product="BUILDING", issue="HIGH", manual_attention=True
    )
    return found.select("complaint_id", "date_received", "product", "issue")


def get_cases(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("complaint_id"))
    return _shown(
        queue.get_cases(_cases(spark, sf_dir), reviews(spark, sf_dir), ids, tie="review_id")
    )


def quick_filter(spark, sf_dir):
    found = queue.quick_filter(
        _routed(spark, sf_dir), manual_only=True, status="overridden", text=" 00001 "
    )
    return found.select("complaint_id", "company", "route_status")


def case_priority(spark, sf_dir):
    return _prioritized(spark, sf_dir).select("complaint_id", "priority")


def queue_sort_priority(spark, sf_dir):
    return _ranked(_prioritized(spark, sf_dir), "priority", "priority")


def queue_sort_newest(spark, sf_dir):
    return _ranked(_prioritized(spark, sf_dir), "newest", "date_received")


def queue_sort_confidence(spark, sf_dir):
    return _ranked(_prioritized(spark, sf_dir), "confidence", "prediction_confidence")


QUERIES = {
    "latest_review": lambda s, d: queue.latest_review(reviews(s, d), tie="review_id"),
    "queue_with_routes": lambda s, d: _shown(_routed(s, d)),
    "route_status_counts": lambda s, d: _routed(s, d)
    .groupBy("route_status")
    .agg(F.count("*").alias("count")),
    "filter_queue": filter_queue,
    "search_cases": lambda s, d: queue.search(_cases(s, d), _SEARCH).select("complaint_id", "product"),
    "search_indexed": search_indexed,
    "queue_page": queue_page,
    "queue_page_after": queue_page_after,
    "stored_queue_page": stored_queue_page,
    "queue_total": lambda s, d: queue.queue_total(
        queue.filter_queue(_cases(s, d), manual_attention=True, text=_SEARCH)
    ),
    "get_cases": get_cases,
    "case_priority": case_priority,
    "queue_sort_priority": queue_sort_priority,
    "queue_sort_newest": queue_sort_newest,
    "queue_sort_confidence": queue_sort_confidence,
    "quick_filter": quick_filter,
}

_ROUTED_SQL = f"""WITH {OPERATIONAL_SQL}, {REVIEWS_SQL},
routed AS (
  SELECT o.*, CASE decision WHEN 'approve' THEN 'approved' WHEN 'override' THEN 'overridden'
      WHEN 'reject' THEN 'rejected' ELSE 'unreviewed' END AS route_status,
    approved_route AS assigned_product
  FROM operational o LEFT JOIN latest USING (complaint_id)
)"""
_SHOWN = "complaint_id, date_received, product, issue, route_status, assigned_product"
_SEARCH_SQL = f"""(complaint_id ILIKE '%{_SEARCH}%' OR product ILIKE '%{_SEARCH}%'
  OR issue ILIKE '%{_SEARCH}%' OR coalesce(company, '') ILIKE '%{_SEARCH}%'
  OR coalesce(narrative, '') ILIKE '%{_SEARCH}%')"""
_SEARCH_CASES_SQL = f"""WITH {OPERATIONAL_SQL}
SELECT complaint_id, product FROM operational WHERE {_SEARCH_SQL}"""
_PRIORITY_SQL = f"""WITH {OPERATIONAL_SQL},
given AS (SELECT *, CASE submitted_via WHEN '1' THEN 'urgent' WHEN '5' THEN 'low' END AS p
  FROM operational),
ranked AS (SELECT *, coalesce(p, CASE WHEN requires_manual_attention THEN 'high'
  ELSE 'standard' END) AS priority FROM given)"""

ORACLES = {
    "latest_review": f"""WITH {REVIEWS_SQL}
SELECT complaint_id, review_id, decision, approved_route, reviewed_at FROM latest""",
    "queue_with_routes": f"{_ROUTED_SQL} SELECT {_SHOWN} FROM routed",
    "route_status_counts": f"""{_ROUTED_SQL}
SELECT route_status, count(*) AS count FROM routed GROUP BY 1""",
    "filter_queue": f"""WITH {OPERATIONAL_SQL}
SELECT complaint_id, date_received, product, issue FROM operational
WHERE product = 'BUILDING' AND issue = 'HIGH' AND requires_manual_attention""",
    "search_cases": _SEARCH_CASES_SQL,
    "search_indexed": _SEARCH_CASES_SQL,
    "queue_page": f"""{_ROUTED_SQL} SELECT {_SHOWN} FROM routed
WHERE requires_manual_attention
ORDER BY date_received DESC, complaint_id DESC LIMIT 50 OFFSET 50""",
    "stored_queue_page": f"""{_ROUTED_SQL} SELECT {_SHOWN} FROM routed
ORDER BY date_received DESC, complaint_id DESC
LIMIT 50 OFFSET 50 * ((SELECT count(*) // 50 FROM orders) * 9 // 10)""",
    "queue_page_after": f"""{_ROUTED_SQL} SELECT {_SHOWN} FROM routed
WHERE (date_received, complaint_id) < (DATE '1998-01-01', '5000')
ORDER BY date_received DESC, complaint_id DESC LIMIT 50""",
    "queue_total": f"""WITH {OPERATIONAL_SQL}
SELECT count(*) AS total FROM operational WHERE requires_manual_attention AND {_SEARCH_SQL}""",
    "get_cases": f"""{_ROUTED_SQL} SELECT {_SHOWN} FROM routed
WHERE complaint_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "case_priority": f"{_PRIORITY_SQL} SELECT complaint_id, priority FROM ranked",
    "queue_sort_priority": f"""{_PRIORITY_SQL} SELECT complaint_id, priority, row_number() OVER (
  ORDER BY list_position(['urgent', 'high', 'standard', 'low'], priority), complaint_id) AS place
FROM ranked""",
    "queue_sort_newest": f"""{_PRIORITY_SQL} SELECT complaint_id, date_received,
  row_number() OVER (ORDER BY date_received DESC, complaint_id) AS place FROM ranked""",
    "queue_sort_confidence": f"""{_PRIORITY_SQL}
SELECT complaint_id, prediction_confidence, row_number() OVER (
  ORDER BY coalesce(prediction_confidence, -1), complaint_id) AS place FROM ranked""",
    "quick_filter": f"""{_ROUTED_SQL} SELECT complaint_id, company, route_status FROM routed
WHERE requires_manual_attention AND route_status = 'overridden'
  AND contains(lower(concat_ws(' ', complaint_id, company, product, issue, state)), '00001')""",
}
