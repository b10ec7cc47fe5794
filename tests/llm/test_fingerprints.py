from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from casequeue.llm import fingerprints
from tests.llm.samples import documents, nothing, texts


def test_edits_and_likeness(spark):
    made = [t or "" for t in texts()]
    for r in fingerprints.edited_fingerprints(documents(spark)).collect():
        i = r["doc_id"]
        half = len(made[i]) // 2
        edited = made[i][: len(made[i]) - half] + made[i - 1][:half]
        assert r["n_chars"] == len(made[i])
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1.0) == (made[i] == edited) or r["near_edited"] < 1.0
        assert 0 <= r["near_next"] <= 1


def test_equal_texts_and_changed_leaves(spark):
    text = "\n".join(f"line {i} of the page" for i in range(30))
    rows = [(text, text), (text, text.replace("line 7 ", "line seven ")), ("", None), (text, "")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        *(fingerprints.fingerprint(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in "ab")
    )
    got = [(r["a"] == r["b"], r["changed"]) for r in df.withColumn("changed", fingerprints.changed_leaves(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (True, []) and got[1] == (False, [7]) and got[2] == (True, [])
    assert got[3] == (False, list(range(30)))


def test_edits_have_places_in_both_texts(spark):
    page = [f"line {i} of the page\n" for i in range(300)]
    again = ["a line that comes again\n"] * 3
    cases = [
        (page, page[:40] + ["inserted\n"] + page[40:], [(40, 40, 40, 41)]),
        (page, page[:40] + page[41:], [(40, 41, 40, 40)]),
        (page, page[:40] + [page[200]] + page[41:], [(40, 41, 40, 41)]),
        (page, page[:40] + page[41:250] + [page[40]] + page[250:], [(40, 41, 40, 40), (250, 250, 249, 250)]),
        ([*again, *page], [*again[1:], *page], [(2, 3, 2, 2)]),
        (page, [*page[:100], *page[50:60], *page[100:]], [(100, 100, 100, 110)]),
        ([], page[:5], [(0, 0, 0, 5)]),
        (page, page, []),
    ]
    rows = [(i, "".join(a), "".join(b)) for i, (a, b, _) in enumerate(cases)]
    trees = spark.createDataFrame(rows, "i int, a string, b string").select(
        "i", *(fingerprints.fingerprint(F.col(c)).alias(c) for c in "ab")
    )
    found = trees.select("i", fingerprints.edits(F.col("a"), F.col("b")).alias("e"), fingerprints.changed_leaves(F.col("a"), F.col("b")).alias("c"))
    for r in found.collect():
        before, after, want = cases[r["i"]]
        assert [tuple(e) for e in r["e"]] == want
        assert r["c"] == [p for start, end, _, _ in want for p in range(start, end)]
        made, at = [], 0
        for start, end, new, new_end in want:
            made += [*before[at:start], *after[new:new_end]]
            at = end
        assert made + before[at:] == after


def test_next_rows(spark):
    one = spark.createDataFrame([(1, "only", "x")], "doc_id long, text string, chunk string")
    assert [tuple(r) for r in fingerprints.with_next(one).collect()] == [(1, "only", "x", "only")]
    rows = [(None, "z"), (4, "b"), (4, "b"), (9, "a"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(df).collect()}
    assert got == {(9, "a", "b"), (4, "b", "b"), (4, "b", ""), (2, None, "z"), (None, "z", "a")}
    assert fingerprints.edited_fingerprints(nothing(spark)).count() == 0


def test_roots_tell_texts_apart_that_share_short_hashes(spark):
    pair = [(f"paragraph number {a} is here.", f"paragraph number {b} is here.") for a, b in [(1068, 75114)]]
    df = spark.createDataFrame(pair, "a string, b string")
    made = df.select(*(fingerprints.fingerprint(F.col(c)).alias(c) for c in "ab")).withColumn(
        "e", fingerprints.edits(F.col("a"), F.col("b"))
    )
    row = made.first()
    assert row["a"].split(":")[2] == row["b"].split(":")[2]
    assert row["a"].split(":")[0] != row["b"].split(":")[0]
    assert [tuple(e) for e in row["e"]] == [(0, 1, 0, 1)]
    docs = spark.createDataFrame([(1, pair[0][0]), (2, pair[0][1])], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprints.edited_fingerprints(docs).collect()] == [0.0, 0.0]


def test_next_rows_where_keys_repeat(spark):
    rows = [(None, f"n{i}") for i in range(400)] + [(7, f"s{i}") for i in range(400)]
    rows += [(i, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.with_next(df)
    order = df.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    order.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["tie"]))
    texts = [r["text"] for r in order]
    want = dict(zip(texts, texts[1:] + texts[:1], strict=True))
    assert {r["text"]: r["next_text"] for r in got.collect()} == want
    points = [3, 7, 7, 7, 90]
    placed = df.select(fingerprints._place(F.col("doc_id"), F.xxhash64("text"), points, 4).alias("p"))
    sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 1000
