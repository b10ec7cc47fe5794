from __future__ import annotations

import math
import random

from casequeue.llm import top_k
from pyspark.sql import functions as F


def vectors(spark, n=500, dim=6):
    r = random.Random(4)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.0, 0.5, -0.25]) for _ in range(dim)], i) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [math.nan] * dim, 1), (n + 3, [math.inf] * dim, 1),
             (n + 4, [], 1), (None, [1.0] * dim, 1), (7, rows[7][1], 1), (n + 5, [1.0, 2.0], 1)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    return df.select(F.col("vec_id").alias("id"), top_k.quantized(F.col("embedding")).alias("v"), "score")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 64)
    monkeypatch.setattr(top_k, "BLOCK", 16)
    df = frame(spark, vectors(spark))
    held = [(r["id"], r["v"]) for r in df.collect() if r["id"] is not None and r["v"] is not None]
    got = {}
    for r in top_k.top_k(df.where("id % 5 = 0"), df, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in held:
        if q % 5 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q and len(w) == len(v)]
            want = [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:4])]
            assert sorted(got.get(q, [])) == want


def test_empty_tables(spark):
    df = frame(spark, vectors(spark, 20))
    assert top_k.top_k(df.limit(0), df).count() == 0
    assert top_k.top_k(df, df.limit(0)).count() == 0


def brute(rows, asked, k):
    """Result rows of each query row."""
    out = []
    for q, v in asked:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_repeated_queries_and_candidates(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 16)
    monkeypatch.setattr(top_k, "BLOCK", 4)
    r = random.Random(8)
    rows = [(i % 23, [float(r.randrange(-4, 5)) for _ in range(3)]) for i in range(120)]
    rows += [rows[0]] * 40 + [rows[5]] * 3
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = [x for x in rows if x[0] % 5 == 0]
    got = sorted((tuple(x) for x in top_k.top_k(df.where("id % 5 = 0"), df, 6).collect()), key=str)
    assert got == brute(rows, asked, 6)


def test_products_beyond_longs(spark):
    big = [1e300, -1e300, 4e15, 3.0, -4e15, 2.0**52 + 1, 2.0**62, -(2.0**63), 1e19, 0.0]
    r = random.Random(2)
    rows = [(i, [r.choice(big) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((tuple(x) for x in top_k.top_k(df, df, 55).collect()), key=str)
    assert got == brute(rows, rows, 55)
    assert any(x[3] is None for x in got) and any(x[3] is not None for x in got)
    scaled = spark.createDataFrame([([1e307],), ([1e19, -1.5],)], "e array<double>")
    assert [x["v"] for x in scaled.select(top_k.quantized(F.col("e")).alias("v")).collect()] == [None, [1024e19, -1536.0]]
