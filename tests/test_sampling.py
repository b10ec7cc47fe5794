from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from casequeue.operators import sampling


def test_windows_cover_months_and_share_the_cap(spark):
    plan = sampling.SelectionPlan(as_of=date(2026, 8, 19))
    rows = sampling.selection_windows(spark, plan).orderBy("window_start").collect()
    assert len(rows) == 13
    assert sum(r["selection_cap"] for r in rows) == 100_000
    caps = [r["selection_cap"] for r in rows]
    assert caps == sorted(caps) and caps[-1] - caps[0] == 1
    assert (rows[0]["window_name"], rows[-1]["window_name"]) == ("2025-08", "2026-08-current-slice")
    assert rows[-1]["window_end"] == date(2026, 8, 20)
    assert [r["complete_month"] for r in rows] == [True] * 12 + [False]
    assert all(a["window_end"] == b["window_start"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("bad", [{"max_records": 0}, {"complete_months": 3}])
def test_plan_bounds(bad):
    with pytest.raises(ValueError):
        sampling.SelectionPlan(as_of=date(2026, 1, 1), **bad)


def shares(spark, totals, cap):
    rows = [("w", date(2026, 1, 1) + timedelta(days=7 * i), n, cap) for i, n in enumerate(totals)]
    df = spark.createDataFrame(
        rows, "window_name string, stratum_start date, source_total long, selection_cap long"
    )
    return [r["stratum_cap"] for r in sampling.allocate_caps(df).orderBy("stratum_start").collect()]


def test_caps_are_proportional(spark):
    assert shares(spark, [100, 200, 300, 0], 60) == [10, 20, 30, 0]
    assert shares(spark, [2, 1], 10) == [2, 1]
    assert shares(spark, [0, 0], 10) == [0, 0]
    with pytest.raises(Exception, match="negative"):
        shares(spark, [1], -1)


def largest_remainder(totals, cap):
    available = sum(totals)
    target = min(cap, available)
    if not available:
        return [0] * len(totals)
    quotas = [target * n / available for n in totals]
    given = [int(q) for q in quotas]
    order = sorted(range(len(totals)), key=lambda i: (-(quotas[i] - int(quotas[i])), -totals[i], i))
    while sum(given) < target:
        for i in order:
            if sum(given) < target and given[i] < totals[i]:
                given[i] += 1
    return given


def test_caps_match_a_loop_on_random_strata(spark):
    draw = random.Random(11)
    rows, wanted = [], {}
    for w in range(60):
        totals = [draw.choice([0, 1, 2, 5, draw.randint(0, 500)]) for _ in range(draw.randint(1, 6))]
        cap = draw.choice([0, 1, 7, draw.randint(0, 800)])
        wanted[f"w{w}"] = largest_remainder(totals, cap)
        rows += [(f"w{w}", date(2026, 1, 1) + timedelta(days=7 * i), n, cap) for i, n in enumerate(totals)]
    df = spark.createDataFrame(
        rows, "window_name string, stratum_start date, source_total long, selection_cap long"
    )
    got = defaultdict(list)
    for r in sampling.allocate_caps(df).orderBy("window_name", "stratum_start").collect():
        got[r["window_name"]].append(r["stratum_cap"])
    assert dict(got) == wanted


def test_sample_with_a_hot_day_matches_a_loop(spark):
    """A third of the population falls on one day, and ids repeat across windows."""
    plan = sampling.SelectionPlan(as_of=date(2026, 5, 20), max_records=400, complete_months=4)
    draw = random.Random(5)
    start, span = date(2026, 1, 1), 140
    rows = [
        (f"c{i:05d}", date(2026, 3, 17) if i % 3 == 0 else start + timedelta(days=draw.randrange(span)))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "complaint_id string, date_received date").repartition(7)
    taken, caps, totals = sampling.draw_sample(spark, df, plan)
    got = {(r["complaint_id"], r["date_received"]) for r in taken.collect()}

    cap_of = {(r["window_name"], r["stratum_start"]): r["stratum_cap"] for r in caps.collect()}
    strata = defaultdict(list)
    for key, day in rows:
        first = day.replace(day=1)
        name = f"{day:%Y-%m}" + ("-current-slice" if first == date(2026, 5, 1) else "")
        strata[name, first + timedelta(days=7 * ((day - first).days // 7))].append((day, key))
    wanted = {
        (key, day)
        for stratum, members in strata.items()
        for day, key in sorted(members, reverse=True)[: cap_of[stratum]]
    }
    assert got == wanted
    report = sampling.sampling_report(caps, taken, totals).collect()
    assert all(r["retrieved"] == r["stratum_cap"] and r["window_delta"] == 0 for r in report)
    assert sum(r["retrieved"] for r in report) == len(got)


def test_first_window_keeps_a_repeated_id(spark):
    rows = [
        ("a", date(2026, 2, 1), "2026-02", date(2026, 2, 1), date(2026, 2, 1)),
        ("a", date(2026, 1, 5), "2026-01", date(2026, 1, 1), date(2026, 1, 1)),
        ("", date(2026, 1, 5), "2026-01", date(2026, 1, 1), date(2026, 1, 1)),
    ]
    df = spark.createDataFrame(
        rows,
        "complaint_id string, date_received date, window_name string, window_start date, stratum_start date",
    )
    kept = sampling.dedup_global(df).collect()
    assert [(r["complaint_id"], r["window_name"]) for r in kept] == [("a", "2026-01")]


def test_totals_that_do_not_add_up_stop_the_job(spark):
    strata = spark.createDataFrame(
        [("w", 5, "eq")], "window_name string, source_total long, source_total_relation string"
    )
    totals = spark.createDataFrame(
        [("w", 6, "eq")], "window_name string, window_total long, window_relation string"
    )
    wrong = sampling.reconcile_totals(strata, totals)
    assert wrong.first()["reconciled"] is False
    with pytest.raises(Exception, match="do not add up"):
        sampling.require_reconciled(wrong).collect()
    loose = totals.withColumn("window_relation", F.lit("gte"))
    assert sampling.reconcile_totals(strata, loose).first()["reconciled"] is True
