from __future__ import annotations

import itertools
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from casequeue.functions.hashing import rowset_fingerprint
from casequeue.operators import quality

AS_OF = date(2026, 8, 1)
GOOD = {
    "complaint_id": "1",
    "date_received": "2026-07-01",
    "product": "Card",
    "issue": "Fee",
    "company": "Bank",
    "state": "NY",
    "submitted_via": "Web",
    "date_sent_to_company": "2026-07-02",
    "timely": True,
    "narrative": "A narrative with more than twenty characters.",
    "has_narrative": True,
}


def lines(spark, *items):
    texts = [i if isinstance(i, str) else json.dumps({**GOOD, **i}) for i in items]
    return quality.parse_lines(spark.createDataFrame([(t,) for t in texts], "value string"))


def counters(spark, *items):
    return quality.quality_counters(lines(spark, *items), AS_OF).first().asDict()


def failing(report):
    return {r["name"] for r in report.collect() if not r["passed"]}


def test_only_json_objects_are_rows(spark):
    c = counters(spark, {}, "not json", "[1]", '{"a":1', "  ", '"text"', '[{"complaint_id":"2"}]')
    assert (c["row_count"], c["invalid_lines"]) == (1, 5)


@pytest.mark.parametrize(
    "tail", ["{}", ' {"a": 1}', ',{"a": 1}', " x", "]", "}", '"', " {", "null", ',"b":2}', '{"}":1}']
)
def test_nothing_may_follow_the_object(spark, tail):
    c = counters(spark, json.dumps(GOOD) + tail)
    assert (c["row_count"], c["invalid_lines"]) == (0, 1)


def test_braces_inside_strings_and_values_are_part_of_a_row(spark):
    texts = ['say "}{" \\', "{", "}", '\\"}']
    c = counters(spark, *[{"complaint_id": str(i), "narrative": t * 9} for i, t in enumerate(texts)])
    assert (c["row_count"], c["invalid_lines"]) == (4, 0)
    nested = json.dumps({**GOOD, "extra": {"a": {"b": {}}, "c": [{}, {}]}})
    assert counters(spark, nested)["row_count"] == 1


def test_braces_outside_of_strings_are_found_in_one_scan(spark):
    """what two scans left of a line, one leaves, whatever its quotes and escapes."""
    texts = ["".join(t) for n in range(6) for t in itertools.product('{}"\\a', repeat=n)]
    texts += ['{"a":"' + '\\"}{\\\\' * 5000 + '"}', '{"' + "x" * 50_000 + '}"}', "\x85\\\x85{", '"\\\r{"}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    outside = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*+"', "")
    twice = F.regexp_replace(outside, r"[^{}]", "")
    assert df.where(~twice.eqNullSafe(quality._braces(F.col("value")))).count() == 0


def test_a_line_is_scanned_and_parsed_once(spark, folder):
    """the plan names the scan for braces, the parser and the dates of a row once each."""
    spark.createDataFrame([(json.dumps(GOOD),)], "value string").write.parquet(folder + "/lines")
    parsed = quality.parse_lines(spark.read.parquet(folder + "/lines"))
    frame = quality.quality_counters(parsed, AS_OF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("regexp_replace("), plan.count("from_json("), plan.count("aggregate(")) == (1, 1, 1)
    assert plan.count(r"^\d{8}$") == 2  # the days of receiving and of sending


def test_missing_key_is_not_a_null_value(spark):
    without = {k: v for k, v in GOOD.items() if k != "issue"}
    c = counters(spark, json.dumps(without), {"complaint_id": "2", "issue": None})
    assert (c["missing_required_columns"], c["missing_labels"]) == (1, 2)


def test_ids(spark):
    c = counters(spark, {}, {"complaint_id": " 1 "}, {"complaint_id": " "}, {"complaint_id": None})
    assert (c["missing_ids"], c["duplicate_rows"]) == (2, 1)
    c = counters(spark, {"complaint_id": 7}, {"complaint_id": "7"}, {"complaint_id": 7})
    assert c["duplicate_rows"] == 2


@pytest.mark.parametrize(
    ("received", "sent", "invalid", "future", "early"),
    [
        ("2026-07-01", "2026-06-30", 0, 0, 1),
        ("2026-07-01", "soon", 0, 0, 1),
        ("2026-07-01", None, 0, 0, 0),
        ("2026-07-01", "", 0, 0, 0),
        ("2026-09-01", "2026-09-01", 0, 1, 0),
        ("20260701", "20260701", 0, 0, 0),
        ("2026-7-1", "2026-01-01", 1, 0, 0),
        ("2026", None, 1, 0, 0),
        (None, "2026-01-01", 1, 0, 0),
    ],
)
def test_dates(spark, received, sent, invalid, future, early):
    c = counters(spark, {"date_received": received, "date_sent_to_company": sent})
    got = (c["invalid_dates"], c["future_dates"], c["sent_before_received"])
    assert got == (invalid, future, early)


@pytest.mark.parametrize(
    ("flag", "narrative", "mismatch"),
    [
        (True, "text", 0),
        (False, None, 0),
        (False, "  ", 0),
        (True, " ", 1),
        ("false", None, 1),
        ("", None, 0),
        (None, "text", 1),
        (1, "text", 0),
        (0, None, 0),
        (True, 123, 1),
    ],
)
def test_flag_truthiness(spark, flag, narrative, mismatch):
    c = counters(spark, {"has_narrative": flag, "narrative": narrative})
    assert c["narrative_mismatch"] == mismatch


def test_report_names_and_gate(spark):
    report = quality.quality_report(quality.quality_counters(lines(spark, {}), AS_OF))
    assert report.count() == 11
    assert failing(report) == {"narrative_support_for_routing_evaluation"}
    assert quality.overall(report).first()["passed"]
    quality.gate(report)
    bad = quality.quality_report(quality.quality_counters(lines(spark, {}, {"issue": ""}), AS_OF))
    with pytest.raises(quality.QualityGateError, match="complaint_id_unique.*routing_labels"):
        quality.gate(bad)


def test_no_rows_fail_the_contract(spark):
    report = quality.quality_report(quality.quality_counters(lines(spark, " "), AS_OF))
    assert "row_count_within_snapshot_contract" in failing(report)


def manifest(spark, sha, windows):
    shape = (
        "snapshot_sha256 string, windows array<struct<name string, "
        "source_meta struct<is_data_stale boolean, has_data_issue boolean>>>"
    )
    return spark.createDataFrame([(sha, windows)], shape)


def test_manifest_checks(spark):
    parsed = lines(spark, {})
    count = quality.quality_counters(parsed, AS_OF)
    prints = rowset_fingerprint(parsed.select("complaint_id"))
    sha = prints.first()["rowset_sha256"]

    def bad(m):
        return failing(quality.quality_report(count, manifest=m, fingerprint=prints)) - {
            "narrative_support_for_routing_evaluation"
        }

    assert bad(manifest(spark, sha, [("w", (False, False)), ("x", None)])) == set()
    assert bad(manifest(spark, "0" * 64, [("w", (True, True))])) == {
        "manifest_snapshot_sha256_matches",
        "source_reports_no_data_issue",
        "source_reports_fresh",
    }
    assert bad(manifest(spark, sha, [])) == {
        "source_reports_no_data_issue",
        "source_reports_fresh",
    }
    assert len(bad(manifest(spark, None, None))) == 3


def test_profile_caps_distinct_counts(spark):
    rows = [{"complaint_id": str(i), "state": "NY" if i % 2 else ""} for i in range(60)]
    parsed = lines(spark, *rows, "no row")
    profile = {r["column"]: r for r in quality.column_profile(parsed, cap=20).collect()}
    assert (profile["complaint_id"]["distinct_count_observed"], profile["complaint_id"]["distinct_count_capped"]) == (20, True)
    assert profile["state"]["null_count"] == 30 and profile["state"]["null_rate"] == 0.5
    assert profile["state"]["distinct_count_observed"] == 1
    exact = {r["column"]: r for r in quality.column_profile(parsed).collect()}
    assert (exact["complaint_id"]["distinct_count_observed"], exact["complaint_id"]["distinct_count_capped"]) == (60, False)
    assert quality.snapshot_rows(parsed).where(F.col("complaint_id").isNull()).count() == 0


def test_capped_profile_is_exact_around_the_cap(spark):
    rows = [{"complaint_id": str(i % 33), "state": str(i % 32), "issue": str(i % 31)} for i in range(3000)]
    profile = {r["column"]: r for r in quality.column_profile(lines(spark, *rows).repartition(7), cap=32).collect()}
    found = [(profile[c]["distinct_count_observed"], profile[c]["distinct_count_capped"]) for c in ("complaint_id", "state", "issue")]
    assert found == [(32, True), (32, True), (31, False)]
    assert quality.column_profile(lines(spark, "no row"), cap=32).count() == 0
