from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casequeue.llm import mixing
from tests.llm.samples import documents, nothing, texts


def shared(sizes, weights, most=3.0):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_match_repeated_sharing(spark):
    sizes = {"a": 1000, "b": 3, "c": 20, None: 40, "d": 700, "e": 0}
    rows = [(s, n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(shared(sizes, (1, 2, 3)))


def test_words_come_near_targets(spark):
    rows = [(i, "word " * (1 + i % 50), f"s{i % 5 if i % 3 else 0}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_copies(docs)
    assert mixed.count() == 6000
    words = F.sum(F.col("copies") * F.col("size")).alias("taken")
    for r in mixed.groupBy("source", "target").agg(words, F.max("copies").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]
        assert r["most"] <= 3
    again = sorted(tuple(r) for r in mixing.mix_copies(docs.repartition(5)).collect())
    assert again == sorted(tuple(r) for r in mixed.collect())
    other = sorted(tuple(r) for r in mixing.mix_copies(docs, seed=18).collect())
    assert other != again


def test_awkward_rows(spark):
    made = texts()
    got = {r["doc_id"]: r for r in mixing.mix_copies(documents(spark)).collect()}
    assert sorted(got) == list(range(len(made)))
    for i, t in enumerate(made):
        assert got[i]["size"] == len((t or "").split())
        assert got[i]["copies"] * got[i]["size"] <= 3 * got[i]["size"]
    assert mixing.mix_copies(nothing(spark)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark)
    copies = {r["doc_id"]: r["copies"] if r["size"] else 0 for r in mixing.mix_copies(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}
    doubled = docs.unionByName(docs)
    n = mixing.mix_copies(doubled).where("size > 0").agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(doubled).count() == n
    assert mixing.mix_documents(nothing(spark)).count() == 0


def test_rows_without_own_ids_spread(spark):
    rows = [(None if i % 2 else 5, f"w{i} " * (1 + i % 40), f"s{i % 3}") for i in range(6000)]
    rows += [(5, "", "s0"), (5, None, "s0"), *[(None, "same words", None)] * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_copies(docs)
    assert mixed.count() == len(rows)
    keys = docs.select(F.xxhash64("doc_id", mixing._mark(F.col("text"))).alias("k")).distinct()
    assert keys.count() == 6000 + 2
    words = F.sum(F.col("copies") * F.col("size")).alias("taken")
    for r in mixed.groupBy("source", "target").agg(words, F.max("copies").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= max(2, 0.01 * r["target"])
        assert r["most"] <= 3
    again = sorted((tuple(r) for r in mixing.mix_copies(docs.repartition(7)).collect()), key=str)
    assert again == sorted((tuple(r) for r in mixed.collect()), key=str)
    taken = mixing.mix_documents(docs).groupBy("doc_id", "source", "text").count()
    want = mixed.where("size > 0").groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("n")).where("n > 0")
    got = sorted(r["count"] for r in taken.collect())
    assert got == sorted(r["n"] for r in want.collect())
