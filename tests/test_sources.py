from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casequeue.schemas import ROUTE_REVIEWS, SUMMARY_DRAFTS, SUMMARY_REVIEWS, SYSTEM_EVENTS, WORKSHEET_COLUMNS
from casequeue.sources import logs, manifests, search_pages, snapshot, worksheet


def put(folder, name, value):
    path = Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def hit(i, **more):
    return {"complaint_id": i, "date_received": "2026-07-02T10:00:00Z", "product": " Card ", **more}


def test_pages_flatten_wrapped_and_bare_hits(spark, folder):
    meta = {"is_data_stale": False, "break_points": {"2": ["x", "y"]}}
    put(folder, "a.json", {"_meta": meta, "hits": {"total": {"value": 7, "relation": "gte"}, "hits": [{"_source": hit(1, has_narrative="true", complaint_what_happened="  text ")}, hit(2)]}})
    put(folder, "b.json", {"hits": {"total": 3, "hits": {"complaint_id": "9"}}})
    put(folder, "c.json", {"hits": {"hits": [{"_source": "text", "complaint_id": "3", "timely": True}]}})
    records = search_pages.read_search_pages(spark, folder)
    rows = {r["complaint_id"]: r for r in search_pages.normalize_source(records).collect()}
    assert rows.keys() == {"1", "2", "3"}
    assert rows["1"]["narrative"] == "text" and rows["1"]["has_narrative"] is True
    assert rows["2"]["product"] == "Card" and rows["2"]["date_received"] == "2026-07-02"
    assert rows["2"]["has_narrative"] is False and rows["3"]["timely"] is True

    pages = search_pages.source_total(search_pages.read_pages(spark, folder))
    totals = {r["page"][-6:]: (r["source_total"], r["source_total_relation"]) for r in pages.collect()}
    assert totals == {"a.json": (7, "gte"), "b.json": (3, "eq"), "c.json": (0, "eq")}


def test_snapshot_round_trip_and_failfast(spark, folder):
    records = spark.createDataFrame(
        [(str(i), f"2026-07-0{i}T00:00:00Z", "P", "Yes", None) for i in (1, 3, 2)],
        "complaint_id string, date_received string, product string, timely string, complaint_what_happened string",
    )
    for name in search_pages.SOURCE_RECORD.fieldNames():
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("string"))
    rows = search_pages.normalize_source(records)
    path = f"{folder}/snapshot"
    snapshot.write_snapshot(rows, path)
    written = [line for f in sorted(Path(path).glob("generation-*/lines/part-*")) for line in f.read_text().splitlines()]
    parsed = [json.loads(line) for line in written]
    assert [p["complaint_id"] for p in parsed] == ["3", "2", "1"]
    assert written[0] == json.dumps(parsed[0], sort_keys=True, separators=(",", ":"))
    assert "narrative" in parsed[0] and parsed[0]["narrative"] is None
    typed = snapshot.as_complaints(snapshot.read_snapshot_jsonl(spark, path))
    assert dict(typed.dtypes)["date_received"] == "date" and typed.first()["prediction_abstained"] is False
    snapshot.write_complaints(typed, f"{folder}/complaints")
    assert snapshot.read_complaints(spark, f"{folder}/complaints").where("received_month = '2026-07'").count() == 3
    put(f"{folder}/bad", "part-0", '{"complaint_id": "1", "date_received": "never"}')
    with pytest.raises(Exception):
        snapshot.read_snapshot_jsonl(spark, f"{folder}/bad").collect()


def test_source_windows_have_defaults(spark, folder):
    window = {"name": "2026-07", "date_received_min": "2026-07-01", "date_received_max_exclusive": "2026-08-01", "complete_month": True, "source_total": 1234}
    path = put(folder, "m.json", {"snapshot_sha256": "x", "windows": [window, {**window, "name": "b", "source_total_relation": "gte", "retained_after_global_deduplication": 2}]})
    rows = {r["window_name"]: r for r in manifests.read_source_windows(spark, path).collect()}
    assert (rows["2026-07"]["source_total_relation"], rows["2026-07"]["selected_sample_rows"]) == ("eq", 0)
    assert (rows["b"]["source_total_relation"], rows["b"]["selected_sample_rows"]) == ("gte", 2)
    for _ in range(2):
        manifests.write_source_windows(manifests.read_source_windows(spark, path), f"{folder}/windows")
    assert spark.read.parquet(f"{folder}/windows").count() == 2


def test_unreadable_manifests_are_refused_not_fatal(spark, folder):
    broken = put(folder, "broken.json", '{"snapshot_sha256": "x", ')
    for path in (broken, f"{folder}/missing.json"):
        manifest = manifests.read_manifest(spark, path)
        assert [r["windows"] for r in manifest.collect()] == [None]
        assert manifests.source_windows(manifest).isEmpty()


def test_blank_snapshot_lines_are_no_rows(spark, folder):
    put(f"{folder}/lines", "part-0", '\n{"complaint_id": "1"}\n\n{"complaint_id": "2"}\n')
    assert snapshot.read_snapshot_jsonl(spark, f"{folder}/lines").count() == 2


SAMPLE = {"status": "frozen_unreviewed", "sample_manifest_sha256": "s1", "items": [{"complaint_id": "1", "month": "2026-07", "product": "Card"}]}
DRAFTS = {"schema_version": "summary-draft-manifest-v1", "status": "private_generated_drafts", "source_sample_manifest_sha256": "s1", "manifest_sha256": "m1", "items": [{"complaint_id": "1", "summary_id": "d1", "model": "m", "draft_sha256": "a" * 64}]}


def test_frozen_sample_and_draft_manifest(spark, folder):
    rows = manifests.read_frozen_sample(spark, put(folder, "s.json", SAMPLE)).collect()
    assert [(r["complaint_id"], r["position"], r["sample_manifest_sha256"]) for r in rows] == [("1", 0, "s1")]
    rows = manifests.read_draft_manifest(spark, put(folder, "d.json", DRAFTS), "s1").collect()
    assert [(r["summary_id"], r["review_manifest_sha256"]) for r in rows] == [("d1", "m1")]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"status": "reviewed"}, "not frozen"),
        ({"items": None}, "no item list"),
        ({"items": SAMPLE["items"] * 2}, "unique"),
        ({"items": [{"complaint_id": " ", "month": "m", "product": "p"}]}, "id and stratum"),
    ],
)
def test_sample_contract(spark, folder, change, message):
    with pytest.raises(manifests.ManifestError, match=message):
        manifests.read_frozen_sample(spark, put(folder, "s.json", {**SAMPLE, **change}))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"schema_version": "v0"}, "schema"),
        ({"status": "public"}, "status"),
        ({"source_sample_manifest_sha256": "other"}, "another sample"),
        ({"items": [{**DRAFTS["items"][0], "draft_sha256": "short"}]}, "need ids"),
        ({"items": DRAFTS["items"] * 2}, "unique"),
    ],
)
def test_draft_manifest_contract(spark, folder, change, message):
    with pytest.raises(manifests.ManifestError, match=message):
        manifests.read_draft_manifest(spark, put(folder, "d.json", {**DRAFTS, **change}), "s1")


HEADER = ",".join(WORKSHEET_COLUMNS)


def test_worksheet_shape(spark, folder):
    good = put(folder, "good.csv", f"{HEADER}\nr1,s1,1,2026-07,Card,me,5,true,true,true\n")
    assert worksheet.read_review_worksheet(spark, good).first()["summary_id"] == "s1"
    swapped = ",".join([WORKSHEET_COLUMNS[1], WORKSHEET_COLUMNS[0], *WORKSHEET_COLUMNS[2:]])
    for name, body in {
        "swapped": f"{swapped}\na,b,c,d,e,f,g,h,i,j\n",
        "wider": f"{HEADER},extra\na,b,c,d,e,f,g,h,i,j,k\n",
        "empty": f"{HEADER}\n",
    }.items():
        with pytest.raises(worksheet.WorksheetError):
            worksheet.read_review_worksheet(spark, put(folder, f"{name}.csv", body))
    extra = put(folder, "extra.csv", f"{HEADER}\na,b,c,d,e,f,g,h,i,j,k\n")
    with pytest.raises(Exception):
        worksheet.read_review_worksheet(spark, extra).collect()


NOW = datetime(2026, 8, 1, 12)


def test_route_reviews_append_and_reject(spark, folder):
    cases = spark.createDataFrame([("1",), ("2",)], "complaint_id string")
    batch = spark.createDataFrame(
        [
            ("1", "ann", "approve", "Card", None, NOW),
            ("2", "ann", "reject", None, None, NOW),
            ("2", "ann", "override", None, None, NOW),
            ("9", "ann", "reject", None, None, NOW),
            ("1", "a", "close", None, None, NOW),
        ],
        ROUTE_REVIEWS,
    )
    for _ in range(2):
        logs.append_route_reviews(batch, cases, f"{folder}/log", f"{folder}/rejects")
    assert logs.read_log(spark, ROUTE_REVIEWS, f"{folder}/log").count() == 4
    rejects = spark.read.parquet(f"{folder}/rejects").collect()
    assert sorted({tuple(r["errors"]) for r in rejects}) == [
        ("approved_route_missing",),
        ("decision", "reviewer_id", "approved_route_missing"),
        ("unknown_case",),
    ]


def test_summary_reviews_take_the_case_of_their_draft(spark):
    drafts = spark.createDataFrame([("s1", "7")], "summary_id string, complaint_id string")
    batch = spark.createDataFrame(
        [("s1", None, "ann", "approve", None, NOW), ("s2", None, "ann", "approve", None, NOW)],
        SUMMARY_REVIEWS,
    )
    accepted, rejected = logs.check_summary_reviews(batch, drafts)
    assert [r["complaint_id"] for r in accepted.collect()] == ["7"]
    assert [r["errors"] for r in rejected.collect()] == [["unknown_draft"]]


def test_events_append(spark, folder):
    event = spark.createDataFrame([("e", "summary", True, 100, 0.5, None, NOW)], SYSTEM_EVENTS)
    logs.append_events(event, f"{folder}/events")
    logs.append_events(event, f"{folder}/events")
    assert logs.read_log(spark, SYSTEM_EVENTS, f"{folder}/events").count() == 2


def test_drafts_are_checked_before_they_are_appended(spark, folder):
    cases = spark.createDataFrame([("1",), ("2",)], "complaint_id string")
    good = ("A headline", "A summary.", ["point"], [("quote", 0, 5)], [], [], [])
    empty = ("", "A summary.", ["point"], [("quote", 0, 5)], [], [], [])
    rows = [
        ("s1", "1", good, "pending_review", "someone", NOW),
        ("s2", "9", good, "pending_review", "someone", NOW),
        ("s3", "2", good, "pending_review", "someone", NOW),
        ("s3", "2", good, "pending_review", "someone", NOW),
        ("s4", "2", empty, "pending_review", "someone", NOW),
        ("", "2", good, "pending_review", "s", NOW),
        ("s5", "2", None, "pending_review", "someone", NOW),
    ]
    batch = spark.createDataFrame(rows, SUMMARY_DRAFTS)
    logs.append_summary_drafts(batch, cases, f"{folder}/log", f"{folder}/rejects")
    stored = logs.read_log(spark, SUMMARY_DRAFTS, f"{folder}/log")
    assert [r["summary_id"] for r in stored.collect()] == ["s1"]
    rejects = {r["summary_id"]: list(r["errors"]) for r in spark.read.parquet(f"{folder}/rejects").collect()}
    assert rejects["s2"] == ["unknown_case"] and rejects["s3"] == ["summary_id"]
    assert rejects[""][:2] == ["summary_id", "requested_by"] and rejects["s4"] and rejects["s5"]
    again, refused = logs.check_summary_drafts(batch.limit(1), cases, stored)
    assert again.count() == 0 and refused.count() == 1


def cases_of(spark, n, day="2026-07-01"):
    rows = [(f"{i:03d}", f"2026-07-{1 + i % 9:02d}" if day is None else day, f"P{i}") for i in range(n)]
    return spark.createDataFrame(rows, "complaint_id string, date_received string, product string").repartition(4)


def test_snapshot_generations_are_replaced_whole_and_read_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshot, "FILE_ROWS", 7)
    path = f"{folder}/snapshot"
    first = snapshot.write_snapshot(cases_of(spark, 5), path)
    assert snapshot.current_generation(spark, path) == first
    rows = cases_of(spark, 40, None)
    assert snapshot.write_snapshot(rows, path) != first
    files = snapshot.snapshot_files(spark, path).collect()
    assert len(files) >= 6 and sum(f["rows"] for f in files) == 40
    assert all(a["last_key"] > b["first_key"] for a, b in zip(files, files[1:], strict=False))
    got = snapshot.read_ordered_lines(spark, path).orderBy("line_number").collect()
    assert [r["line_number"] for r in got] == list(range(40))
    keys = [(json.loads(r["value"])["date_received"], json.loads(r["value"])["complaint_id"]) for r in got]
    assert keys == sorted(((r["date_received"], r["complaint_id"]) for r in rows.collect()), reverse=True)

    # A write that fails leaves the snapshot before it.
    broken = rows.withColumn("product", F.when(F.col("complaint_id") == "007", F.raise_error(F.lit("lost"))).otherwise(F.col("product")))
    with pytest.raises(Exception, match="lost"):
        snapshot.write_snapshot(broken, path)
    assert snapshot.read_snapshot_lines(spark, path).count() == 40

    empty = f"{folder}/empty"
    snapshot.write_snapshot(rows.limit(0), empty)
    assert snapshot.read_ordered_lines(spark, empty).count() == 0


@pytest.mark.parametrize(("damage", "reason"), [("lose", "lost"), ("add", "added"), ("change", "changed")])
def test_damaged_snapshots_are_refused(spark, folder, monkeypatch, damage, reason):
    monkeypatch.setattr(snapshot, "FILE_ROWS", 5)
    path = f"{folder}/snapshot"
    generation = snapshot.write_snapshot(cases_of(spark, 30, None), path)
    lines = Path(path, generation, "lines")
    target = sorted(lines.glob("part-*"))[1]
    text = target.read_text()
    for crc in lines.glob(".*.crc"):
        crc.unlink()
    if damage == "lose":
        target.unlink()
    elif damage == "add":
        Path(lines, "part-99999.txt").write_text(text)
    else:
        target.write_text(text.replace("P", "Q", 1))
    assert [r["reason"] for r in snapshot.broken_files(spark, path).collect()] == [reason]
    for read in (snapshot.read_snapshot_lines, snapshot.read_ordered_lines, snapshot.read_snapshot_rows):
        with pytest.raises(snapshot.SnapshotError, match=reason):
            read(spark, path)


def test_a_repeated_batch_has_one_copy(spark, folder):
    cases = spark.createDataFrame([("1",), ("2",)], "complaint_id string")
    rows = [("1", "ann", "approve", "Card", None, NOW), ("2", "ann", "reject", None, None, NOW), ("9", "ann", "reject", None, None, NOW)]
    batch = spark.createDataFrame(rows, ROUTE_REVIEWS)
    log, rejects = f"{folder}/log", f"{folder}/rejects"
    for _ in range(2):
        assert logs.append_route_reviews(batch, cases, log, rejects, batch_id="monday") == "monday"
    logs.append_route_reviews(batch.limit(1), cases, log, rejects, batch_id="tuesday")
    assert logs.read_log(spark, ROUTE_REVIEWS, log).count() == 3
    assert spark.read.parquet(rejects).count() == 1
    with pytest.raises(logs.BatchConflictError, match="monday"):
        logs.append_route_reviews(batch.limit(2), cases, log, rejects, batch_id="monday")
    ledger = {r["batch_id"]: (r["rows"], r["done"]) for r in logs.read_ledger(spark, log).collect()}
    assert ledger == {"monday": (3, True), "tuesday": (1, True)}


def test_an_unfinished_batch_is_not_read_and_can_be_repeated(spark, folder):
    events = spark.createDataFrame([("e", "summary", True, 100, 0.5, None, NOW)], SYSTEM_EVENTS)
    log = f"{folder}/events"
    logs.append_events(events, log, "first")
    broken = events.withColumn("detail", F.when(F.col("event_id") == "e", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        logs.append_events(broken, log, "second")
    # Rows that were written, though the batch was not finished.
    logs._note(spark, log, "third", 1, "d", "begun")
    logs._write_batch(events, log, "third")
    assert logs.read_log(spark, SYSTEM_EVENTS, log).count() == 1
    logs.append_events(events, log, "second")
    assert logs.read_log(spark, SYSTEM_EVENTS, log).count() == 2


def test_draft_ids_are_unique_against_the_log_itself(spark, folder):
    cases = spark.createDataFrame([("1",)], "complaint_id string")
    good = ("A headline", "A summary.", ["point"], [("quote", 0, 5)], [], [], [])
    batch = spark.createDataFrame([("s1", "1", good, "pending_review", "someone", NOW)], SUMMARY_DRAFTS)
    log, rejects = f"{folder}/log", f"{folder}/rejects"
    for batch_id in ("a", "a", "b"):
        logs.append_summary_drafts(batch, cases, log, rejects, batch_id=batch_id)
    assert logs.read_log(spark, SUMMARY_DRAFTS, log).count() == 1
    assert [list(r["errors"]) for r in spark.read.parquet(rejects).collect()] == [["summary_id"]]


def test_no_log_yet(spark, folder):
    assert logs.read_log(spark, SYSTEM_EVENTS, f"{folder}/nothing").count() == 0


def test_checked_reviews_move_only_what_is_selected(spark):
    rows = [("c1", "ann", "approve", "Cards", "n" * 1001, None), ("c9", "a", "reject", None, "", None)]
    batch, cases = spark.createDataFrame(rows, ROUTE_REVIEWS), spark.createDataFrame([("c1",)], "complaint_id string")
    _, rejected = logs.check_route_reviews(batch, cases)
    assert rejected.columns == [*ROUTE_REVIEWS.names, "errors"]
    got = {r["complaint_id"]: r["errors"] for r in rejected.collect()}
    assert got == {"c1": ["notes_length"], "c9": ["unknown_case", "reviewer_id"]}
    lines = rejected.select("complaint_id", "errors")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line or "Join RightOuter" in line or "Join Inner" in line)
    assert not any("notes" in line for line in lines[: join + 1])
