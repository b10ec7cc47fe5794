from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from casequeue.llm import suffix_dedup
from casequeue.llm.suffix_kernel import Hashed, Powers, anchors
from tests.llm.samples import documents, nothing, texts


def brute(rows, depth):
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - depth + 1):
            if raw[p : p + depth] in seen:
                gone[p : p + depth] = [True] * depth
            seen.add(raw[p : p + depth])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER_BYTES", 500)
    for depth, digit in ((100, 24), (30, 8), (12, 12)):
        got = found(suffix_dedup.remove_repeats(documents(spark), depth=depth, digit=digit))
        assert got == brute(list(enumerate(texts())), depth)


def test_repeated_and_null_ids(spark):
    long = "a long enough passage of the same words " * 4
    rows = [(None, long), (4, long), (4, long), (9, "short")]
    got = found(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows, 100)


def test_many_rows_of_one_id(spark):
    passage = "the very same passage of more than a hundred bytes, which many rows that have no id have alike " * 2
    own = F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit(passage), F.sha2(F.col("id").cast("string"), 384))
    text = F.when(F.col("id") % 10_000 == 0, own).otherwise(F.col("id").cast("string"))
    docs = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    got = found(suffix_dedup.remove_repeats(docs).where("n_bytes > 100"))
    rows = docs.where(F.length("text") > 100).orderBy(F.xxhash64("text")).collect()
    assert len(got) == 30 and got == sorted(brute(rows, 100), key=lambda r: r[1:])


def test_empty_table(spark):
    assert found(suffix_dedup.remove_repeats(nothing(spark))) == []


def test_equal_windows_have_equal_anchors():
    raw = np.frombuffer(b"xyxyxyxyxyxyabcdefgh" * 9, np.uint8)
    hashed = Hashed(raw, Powers())
    x, lo, hi = anchors(raw, np.array([0]), np.array([len(raw)]), hashed, 24, 6)
    owner = {p: int(a) for a, s, e in zip(x, lo, hi, strict=True) for p in range(s, e + 1)}
    assert sorted(owner) == list(range(len(raw) - 23))
    by = {}
    for p, a in owner.items():
        assert by.setdefault(raw[p : p + 24].tobytes(), a - p) == a - p
