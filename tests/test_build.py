from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path

import pytest

from casequeue.operators import quality
from casequeue.operators.sampling import SelectionPlan
from casequeue.plans.build import BuildPaths, build_all, current_version

PLAN = SelectionPlan(as_of=date(2026, 8, 19), max_records=300, complete_months=7)


def pages(folder, stale=False):
    """Search responses over eight months, 100 hits a page."""
    hits = []
    for i in range(460):
        day = date(2026, 1, 1) + timedelta(days=i // 2)
        label = ("Card", "Loan")[i % 2]
        words = ("credit card charge dispute", "mortgage loan escrow payment")[i % 2]
        hits.append(
            {
                "_source": {
                    "complaint_id": 1000 + i,
                    "date_received": f"{day}T12:00:00Z",
                    "date_sent_to_company": f"{day}T12:00:00Z",
                    "product": label,
                    "issue": "Fees",
                    "company": "Bank",
                    "timely": "Yes",
                    "complaint_what_happened": f"{words} in my account {i}",
                    "has_narrative": "true",
                }
            }
        )
    root = Path(folder, "pages")
    root.mkdir()
    for p in range(0, len(hits), 100):
        page = {
            "_meta": {"is_data_stale": stale, "has_data_issue": False},
            "hits": {"total": {"value": len(hits), "relation": "eq"}, "hits": hits[p : p + 100]},
        }
        Path(root, f"p{p}.json").write_text(json.dumps(page))
    return str(root)


def test_build_from_pages_to_scored_cases(spark, folder):
    cases = build_all(spark, pages(folder), f"{folder}/out", "v1", PLAN)
    # The current slice has 18 days of two cases, two fewer than its cap of 38.
    assert cases.count() == 298
    assert cases.where("predicted_product = product").count() > 280
    paths = BuildPaths(f"{folder}/out", "v1")
    report = spark.read.parquet(paths.of("quality"))
    assert report.count() == 14 and quality.overall(report).first()["passed"]
    support = spark.read.parquet(paths.of("routing_support")).first()
    assert tuple(support) == (298, 500)
    windows = spark.read.parquet(paths.of("source_windows"))
    sums = windows.selectExpr("sum(source_total)", "sum(selected_sample_rows)").first()
    assert tuple(sums) == (460, 298)
    assert current_version(spark, f"{folder}/out") == "v1"


def test_a_version_built_twice_is_the_same(spark, folder):
    source = pages(folder)
    held = []
    for _ in range(2):
        build_all(spark, source, f"{folder}/out", "v1", PLAN, train=False)
        paths = BuildPaths(f"{folder}/out", "v1")
        held.append(
            {
                name: sorted(map(str, spark.read.parquet(paths.of(name)).collect()))
                for name in ("lineage", "selected", "source_windows", "quality", "complaints")
            }
        )
    assert held[0] == held[1]
    build_all(spark, source, f"{folder}/out", "v2", PLAN, train=False)
    assert current_version(spark, f"{folder}/out") == "v2"


def test_build_stops_on_stale_source(spark, folder):
    with pytest.raises(quality.QualityGateError, match="source_reports_fresh"):
        build_all(spark, pages(folder, stale=True), f"{folder}/out", "v1", PLAN, train=False)
    assert not Path(f"{folder}/out/current").exists()
