from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from casequeue.operators import metrics

SHAPE = "row_id int, label string, probabilities array<double>"


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SHAPE)


def test_brier_charges_an_unseen_label(spark):
    cells = metrics.evaluation_cells(scored(spark, [("new", [0.7, 0.3])]), ["a", "b"], 0.5)
    assert metrics.accuracy_summary(cells).first()["brier"] == pytest.approx(1.58)


def values(cells, classes, **minimums):
    return {r["metric"]: r["value"] for r in metrics.evaluate_router(cells, classes, **minimums).collect()}


def test_support_gate_nulls_metrics_but_not_counts(spark):
    rows = [("a", [0.8, 0.2]), ("b", [0.7, 0.3])]
    cells = metrics.evaluation_cells(scored(spark, rows), ["a", "b"], 0.75)
    closed = values(cells, ["a", "b"], minimum_rows=3, minimum_class=1)
    assert all(closed[m] is None for m in metrics.GATED_METRICS)
    assert (closed["test_rows"], closed["accepted_rows"], closed["support_gate_passed"]) == (2, 1, 0)
    opened = values(cells, ["a", "b"], minimum_rows=2, minimum_class=1)
    assert opened["accuracy"] == 0.5 and opened["selective_accuracy"] == 1.0
    assert opened["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)
    status = metrics.evaluation_status(cells, minimum_rows=3).first()["status"]
    assert status == "unavailable_insufficient_test_support"


def test_nothing_accepted_has_no_selective_metrics(spark):
    cells = metrics.evaluation_cells(scored(spark, [("a", [0.6, 0.4])] * 2), ["a", "b"], 0.99)
    got = values(cells, ["a", "b"], minimum_rows=1, minimum_class=1)
    assert got["selective_accuracy"] is None and got["selective_macro_f1"] is None
    assert got["coverage"] == 0 and got["abstention_rate"] == 1


@pytest.mark.parametrize(("value", "index"), [(0.0, 0), (0.3, 2), (0.1, 1), (0.6, 5), (0.7, 6), (1.0, 9)])
def test_bins_follow_the_float_edges(spark, value, index):
    row = spark.range(1).select(metrics.confidence_bin(F.lit(value)).alias("b")).first()
    assert row["b"] == index


def sweep(rows, target, minimum):
    """Every candidate against every row."""
    grid = set(metrics.linear_grid(*metrics.THRESHOLD_GRID)) | {c for _, c in rows}
    found = []
    for t in sorted(grid):
        kept = [hit for hit, c in rows if c >= t]
        coverage = len(kept) / len(rows)
        accuracy = sum(kept) / len(kept) if kept else 0.0
        found.append((t, coverage, accuracy))
    good = [f for f in found if f[1] >= minimum and f[2] >= target]
    if good:
        return max(good, key=lambda f: (f[1], f[2], -f[0]))
    return max(found, key=lambda f: (f[2] * f[1], f[1], -f[0]))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("target", "minimum"), [(0.8, 0.5), (0.6, 0.2)])
def test_threshold_matches_a_full_sweep(spark, seed, target, minimum):
    draw = random.Random(seed)
    rows = []
    for _ in range(150):
        c = round(draw.random(), draw.choice([1, 2, 6]))
        rows.append((draw.random() < (c if seed % 2 else 0.4), c))
    df = spark.createDataFrame(
        [("a", "a" if hit else "b", c) for hit, c in rows], "label string, predicted string, confidence double"
    )
    got = metrics.choose_threshold(df, target_accuracy=target, minimum_coverage=minimum).first()
    assert (got["threshold"], got["coverage"], got["accuracy"]) == pytest.approx(sweep(rows, target, minimum))


def test_temperature_matches_a_loop(spark):
    draw = random.Random(2)
    rows = [(draw.choice("abz"), [draw.gauss(0, 3) for _ in "abc"]) for _ in range(60)]
    df = spark.createDataFrame(rows, "label string, logits array<double>")
    got = metrics.fit_temperature(df, ["a", "b", "c"]).first()

    def loss(t):
        total, n = 0.0, 0
        for label, logits in rows:
            if label in "abc":
                e = [math.exp((x - max(logits)) / t) for x in logits]
                total -= math.log(max(e["abc".index(label)] / sum(e), 1e-12))
                n += 1
        return total / n

    best = min(metrics.geometric_grid(0.25, 4.0, 81), key=loss)
    assert got["temperature"] == pytest.approx(best)
    assert got["negative_log_likelihood"] == pytest.approx(loss(best))
    unseen = sum(label == "z" for label, _ in rows)
    assert (got["known_label_rows"], got["unseen_label_rows"]) == (60 - unseen, unseen)
    with pytest.raises(Exception, match="no label"):
        metrics.fit_temperature(df.where("label = 'z'"), ["a", "b", "c"]).collect()
