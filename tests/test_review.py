from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casequeue.operators import lineage, review
from casequeue.schemas import FACTUALITY_REVIEWS, WORKSHEET
from casequeue.sources import manifests


@pytest.fixture(scope="module")
def population(spark):
    rows = [
        (f"c{m}{p}{i}", date(2026, m, 3), p, True, "text")
        for m in (6, 7)
        for p in ("Card", "Loan")
        for i in range(5)
    ] + [("none", date(2026, 6, 1), "Card", False, None)]
    return spark.createDataFrame(
        rows, "complaint_id string, date_received date, product string, has_narrative boolean, narrative string"
    )


def round_robin(rows, n, seed):
    strata = defaultdict(list)
    for r in rows:
        if r["has_narrative"]:
            strata[f"{r['date_received']:%Y-%m}", r["product"]].append(r["complaint_id"])
    queues = [
        (key, sorted(ids, key=lambda i: hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()))
        for key, ids in sorted(strata.items())
    ]
    depth = max(len(ids) for _, ids in queues)
    order = [(ids[d], *key) for d in range(depth) for key, ids in queues if d < len(ids)]
    return order[:n]


@pytest.mark.parametrize("n", [1, 6, 50])
def test_sample_is_a_round_robin(spark, population, n):
    got = review.freeze_sample(population, n).orderBy("position").collect()
    wanted = round_robin(population.collect(), n, 42)
    assert [(r["complaint_id"], r["month"], r["product"]) for r in got] == wanted
    assert [r["position"] for r in got] == list(range(1, len(wanted) + 1))
    other = review.freeze_sample(population, n, seed=7).orderBy("position").collect()
    assert [r["complaint_id"] for r in other] == [c for c, *_ in round_robin(population.collect(), n, 7)]


def test_template_is_blank(spark, population):
    rows = review.review_template(review.freeze_sample(population, 6)).orderBy("review_row_id").collect()
    assert rows[0]["review_row_id"] == "summary-review-0001" and len(rows) == 6
    assert all(r["reviewer_id"] == "" and r["factuality_score_1_to_5"] == "" for r in rows)


def test_draft_manifest_hashes_and_gates(spark):
    rows = [("1", "s1", "m", "text"), ("2", "s2", " ", "text")]
    df = spark.createDataFrame(rows, "complaint_id string, summary_id string, model string, headline string")
    found = {r["complaint_id"]: r for r in review.draft_manifest(df, ["headline", "model"]).collect()}
    body = json.dumps({"headline": "text", "model": "m"}, sort_keys=True, separators=(",", ":"))
    assert found["1"]["draft_sha256"] == hashlib.sha256(body.encode()).hexdigest()
    assert found["1"]["errors"] == [] and found["2"]["errors"] == ["blank_field"]
    twice = review.draft_manifest(df.where("model = 'm'").union(df.where("model = 'm'")), ["headline"])
    with pytest.raises(Exception, match="repeated_id"):
        review.require_clean(twice).collect()


SAMPLE = [("1", "2026-06", "Card"), ("2", "2026-07", "Loan")]
ROW = ("r", "s1", "1", "2026-06", "Card", "ann", "5", "true", "FALSE", "true")


def checked(spark, *rows):
    sample = spark.createDataFrame(SAMPLE, "complaint_id string, month string, product string")
    manifest = spark.createDataFrame(
        [("1", "s1", "m", "a" * 64, "h"), ("2", "s2", "m", "b" * 64, "h")],
        "complaint_id string, summary_id string, model string, draft_sha256 string, review_manifest_sha256 string",
    )
    return review.validate_review_rows(spark.createDataFrame(list(rows), WORKSHEET), sample, manifest)


@pytest.mark.parametrize(
    ("at", "value", "errors"),
    [
        (1, " s1 ", []),
        (1, "s2", ["summary_not_bound"]),
        (2, "9", ["not_in_sample", "stratum_mismatch", "summary_not_bound"]),
        (3, "2026-07", ["stratum_mismatch"]),
        (4, "", ["product", "stratum_mismatch"]),
        (5, "a\tb", ["reviewer_id"]),
        (5, "x" * 101, ["reviewer_id"]),
        (6, "0", ["factuality_score"]),
        (6, "4.0", ["factuality_score"]),
        (7, "yes", ["all_claims_supported"]),
        (9, None, ["included_in_review_sample"]),
    ],
)
def test_worksheet_rules(spark, at, value, errors):
    row = tuple(value if i == at else v for i, v in enumerate(ROW))
    assert checked(spark, row).first()["errors"] == errors


def test_worksheet_accepts_and_types_values(spark):
    row = review.require_clean(checked(spark, ROW)).first()
    assert (row["factuality_score"], row["quotes_exact"], row["model"]) == (5, False, "m")
    twice = checked(spark, ROW, ROW).first()["errors"]
    assert twice == ["repeated_complaint_id", "repeated_summary_id"]
    with pytest.raises(Exception, match="repeated_complaint_id"):
        review.require_clean(checked(spark, ROW, ROW)).collect()


def stored(spark, *rows):
    at = datetime(2026, 8, 1)
    full = [(s, "old", 4, True, True, True, None, at, *binding) for s, binding in rows]
    return spark.createDataFrame(full, FACTUALITY_REVIEWS)


def test_merge_binds_once(spark):
    incoming = review.require_clean(checked(spark, ROW))
    loose = (None, None, None, None)
    partly = ("1", None, None, None)
    for binding, action in [(loose, "bound"), (partly, "bound"), (("7", None, None, None), "conflict"), (("1", "m", "a" * 64, "h"), "already_reviewed")]:
        merged = review.merge_reviews(stored(spark, ("s1", binding), ("s9", loose)), incoming)
        rows = {r["summary_id"]: r for r in merged.collect()}
        assert rows["s1"]["action"] == action and rows["s9"]["action"] == "kept"
        assert rows["s1"]["factuality_score"] == 4
        if action == "bound":
            assert rows["s1"]["review_manifest_sha256"] == "h"
            assert review.require_mergeable(merged).count() == 2
        else:
            with pytest.raises(Exception, match="review refused"):
                review.require_mergeable(merged).collect()
    fresh = review.merge_reviews(stored(spark), incoming).first()
    assert (fresh["action"], fresh["factuality_score"], fresh["model"]) == ("inserted", 5, "m")


def test_metrics_status_and_reconciliation(spark):
    bound = ("1", "m", "a" * 64, "h")
    rows = stored(spark, ("s1", bound), ("s2", bound))
    row = review.factuality_metrics(rows, expected=3).first()
    assert (row["status"], row["mean_factuality_score"], row["distinct_reviewed_models"]) == ("partially_reviewed", 4.0, 1)
    assert review.factuality_metrics(rows, expected=2).first()["status"] == "reviewed"
    assert review.factuality_metrics(rows.limit(0)).first()["status"] == review.STATUS_NONE
    counts = review.score_distribution(rows)
    assert [r["count"] for r in counts.orderBy("score").collect()] == [0, 0, 0, 2, 0]
    good = review.reconcile_scores(counts, review.factuality_metrics(rows)).first()
    assert all(good.asDict().values())
    off = review.factuality_metrics(rows).withColumn("mean_factuality_score", F.lit(4.5))
    assert review.reconcile_scores(counts, off).first()["mean_matches"] is False
    loose = review.factuality_metrics(stored(spark, ("s1", bound), ("s2", (None,) * 4)))
    assert review.reconcile_scores(counts, loose).first()["all_bound"] is False


def test_lineage_row_names_its_own_content(spark):
    windows = spark.createDataFrame(
        [("w", date(2026, 6, 1), date(2026, 7, 1), 5, True)],
        "window_name string, window_start date, window_end date, selection_cap long, complete_month boolean",
    )
    totals = spark.createDataFrame([("w", 9, "eq")], "window_name string, window_total long, window_relation string")
    kept = spark.createDataFrame([("w", 5)], "window_name string, selected_sample_rows long")
    prints = spark.createDataFrame([(5, "f")], "row_count long, rowset_sha256 string")
    frame = lineage.lineage_frame(windows, totals, kept, prints, "parent")
    assert lineage.verify_lineage(frame).isEmpty()
    assert lineage.verify_lineage(frame.withColumn("source_total", F.lit(10))).count() == 1
    manifest = lineage.snapshot_manifest(frame).first()
    assert manifest["snapshot_sha256"] == "f" and manifest["windows"][0]["source_total"] == 9


def test_chain_from_sample_to_draft_manifest(spark, folder):
    rows = [(f"c{i}", date(2026, 1 + i % 3, 5), "A" if i % 2 else "B", "some text", True) for i in range(30)]
    cases = spark.createDataFrame(
        rows, "complaint_id string, date_received date, product string, narrative string, has_narrative boolean"
    )
    sample = review.freeze_sample(cases, n=7)
    frozen = manifests.frozen_sample(sample, "p" * 64, "r1")
    manifests.write_manifest(frozen, f"{folder}/sample")
    read = manifests.read_frozen_sample(spark, f"{folder}/sample")
    assert [r["complaint_id"] for r in read.orderBy("position").collect()] == [
        r["complaint_id"] for r in sample.orderBy("position").collect()
    ]
    named = read.first()["sample_manifest_sha256"]
    drafts = read.selectExpr("complaint_id", "concat('s', complaint_id) AS summary_id", "'m' AS model")
    items = review.require_clean(review.draft_manifest(drafts, ["complaint_id", "summary_id"]))
    manifests.write_manifest(manifests.drafts_manifest(items, named), f"{folder}/drafts")
    bound = manifests.read_draft_manifest(spark, f"{folder}/drafts", named)
    assert bound.count() == 7
    with pytest.raises(manifests.ManifestError, match="another sample"):
        manifests.read_draft_manifest(spark, f"{folder}/drafts", "0" * 64)
    sheet = review.review_template(read.withColumn("position", F.col("position") + 1)).drop("summary_id")
    sheet = sheet.join(bound.select("complaint_id", "summary_id"), "complaint_id").withColumns(
        {
            "reviewer_id": F.lit("someone"),
            "factuality_score_1_to_5": F.lit("5"),
            **{c: F.lit("true") for c in ("all_claims_supported", "quotes_exact", "included_in_review_sample")},
        }
    )
    checked = review.validate_review_rows(sheet, read, bound)
    assert checked.where(F.size("errors") > 0).count() == 0 and checked.count() == 7


def test_blank_ids_are_blank_and_not_repeated(spark):
    drafts = spark.createDataFrame([(" ", "s1", "m"), ("", "s2", "m"), (None, "s3", "m"), ("c", "s3", "m")],
                                   "complaint_id string, summary_id string, model string")
    got = {r["draft_sha256"]: list(r["errors"]) for r in review.draft_manifest(drafts, drafts.columns).collect()}
    assert sorted(map(tuple, got.values())) == [("blank_field",), ("blank_field",), ("blank_field", "repeated_id"), ("repeated_id",)]


def test_the_first_broken_link_of_a_chain_is_named(spark):
    shape = "kind string, name string, content_sha256 string, parent_sha256 string"
    made, parent = [], None
    for kind in ("window", "snapshot", "sample", "draft manifest", "review"):
        one = lineage.lineage_entries(spark.createDataFrame([(kind, kind[0], f"content of {kind}", parent)], shape))
        made.append(one.first())
        parent = made[-1]["entry_sha256"]
    entries = spark.createDataFrame(made, f"{shape}, entry_sha256 string")

    def broken(df):
        found = lineage.broken_links(df).collect()
        return {r["kind"]: (r["steps"], r["broken_kind"], r["reason"]) for r in found}

    assert broken(entries) == {k: (i, None, None) for i, k in enumerate(r["kind"] for r in made)}
    assert broken(entries.union(entries.limit(2)))["review"] == (4, None, None)
    changed = entries.withColumn(
        "content_sha256", F.when(F.col("kind") == "sample", "other").otherwise(F.col("content_sha256"))
    )
    assert broken(changed) == {
        "window": (0, None, None),
        "snapshot": (1, None, None),
        "sample": (0, "sample", "changed"),
        "draft manifest": (1, "sample", "changed"),
        "review": (2, "sample", "changed"),
    }
    assert broken(entries.where("kind <> 'snapshot'"))["review"] == (3, "sample", "lost")
    assert broken(entries.limit(0)) == {}


def test_repeats_read_the_rows_twice(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("", "b"), ("", "c"), (None, "d")], "complaint_id string, summary_id string")
    marked = review._with_repeats(rows, review._TWICE)
    found = {(r["complaint_id"], r["summary_id"]): (r["_twice_case"], r["_twice_summary"]) for r in marked.collect()}
    assert found == {("1", "a"): (True, None), ("1", "b"): (True, True), ("", "b"): (None, True), ("", "c"): (None, None), (None, "d"): (None, None)}
