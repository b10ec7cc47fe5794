from __future__ import annotations

import hashlib
import json
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequeue.functions import hashing, ranges, text


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("  a b\n", "a b"), (" \t　", None), ("", None), (None, None), ("\x1cx\x85", "x")],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, text.clean_text) == clean


@pytest.mark.parametrize(
    ("raw", "flag"),
    [(" Yes ", True), ("TRUE", True), ("1", True), ("no", False), ("0", False), ("maybe", None), (None, None)],
)
def test_to_bool(spark, raw, flag):
    assert one(spark, raw, text.to_bool) is flag


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("2026-07-02T23:59:58-05:00", "2026-07-03"),
        ("2026-07-02T23:59:58Z", "2026-07-02"),
        ("2026-07-02T23:59:58.123", "2026-07-02"),
        ("2026-07-02 later", "2026-07-02"),
        ("20260702", "2026-07-02"),
        ("2026-W27-4", "2026-07-02"),
        ("2026W274", "2026-07-02"),
        ("2026-W27", "2026-06-29"),
        ("2020-W53-7", "2021-01-03"),
        ("2026-W54-1", "2026-W54-1"),
        ("2025-W53-1", "2025-W53-1"),
        ("2026-07-02T05", "2026-07-02"),
        ("2026-07-02T23-05:00", "2026-07-03"),
        ("2026-07-02T23:30-0500", "2026-07-03"),
        ("2026-07-02T25", "2026-07-02T25"),
        ("2026-13-02", "2026-13-02"),
        ("2026-07", "2026-07"),
        ("about July", "about July"),
        ("  ", None),
    ],
)
def test_normalize_source_date(spark, raw, day):
    assert one(spark, raw, text.normalize_source_date) == day


def test_dates_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, "2026-07-02T23:59:58Z", text.normalize_source_date) == "2026-07-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strict_date_refuses_malformed_text(spark):
    assert str(one(spark, "2026-07-02T01:00:00+02:00", text.utc_date)) == "2026-07-01"
    assert one(spark, " ", text.utc_date) is None
    with pytest.raises(Exception, match="malformed ISO date"):
        one(spark, "2026/07/02", text.utc_date)


@pytest.mark.parametrize("value", ["Same  TEXT\n here", "Straße Ｆｕｌｌ ﬁne", " İstanbul ", ""])
def test_narrative_group_folds_like_unicode(spark, value):
    folded = " ".join(unicodedata.normalize("NFKC", value).casefold().split())
    assert one(spark, value, text.narrative_group) == hashlib.sha256(folded.encode()).hexdigest()


def test_terms_drop_case_and_accents(spark):
    tokens = one(spark, "Été  a_1 à NAÏVE x", lambda c: text.with_bigrams(text.words(text.accent_free(c))))
    assert tokens == ["ete", "a_1", "naive", "ete a_1", "a_1 naive"]
    assert one(spark, "x", lambda c: text.with_bigrams(text.words(c))) == []


def test_canonical_json_is_python_canonical(spark):
    row = {"b": 'q"\\ \x1f\x0b\n é', "a": None, "c": "\\u001F stays"}
    df = spark.createDataFrame([(row["b"], row["a"], row["c"])], "b string, a string, c string")
    wanted = json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    got = df.select(
        hashing.canonical_json(df.columns).alias("j"), hashing.row_sha256(df.columns).alias("h")
    ).first()
    assert got["j"] == wanted
    assert got["h"] == hashlib.sha256(wanted.encode()).hexdigest()


def test_fingerprint_ignores_order_and_counts_copies(spark):
    rows = [(i, f"t{i % 3}") for i in range(50)]
    shuffled = random.Random(1).sample(rows, len(rows))

    def of(data, partitions=3):
        df = spark.createDataFrame(data, "i int, t string").repartition(partitions)
        return hashing.rowset_fingerprint(df).first()["rowset_sha256"]

    assert of(rows) == of(shuffled, 5)
    assert of(rows) != of(rows + rows[:1])
    assert of(rows) != of(rows[:-1])


def test_hash_tree_matches_its_definition_at_every_depth(spark, monkeypatch):
    def expected(hashes, leaf):
        counts = Counter(hashes)
        half = sum(len(counts) > leaf * 256**k for k in range(7))

        def digest(entries):
            return hashlib.sha256(",".join(entries).encode()).hexdigest()

        leaves, branches = {}, {}
        for h in sorted(counts):
            leaves.setdefault(h[: 2 * half], []).append(f"{h}:{counts[h]}")
        for prefix in sorted(leaves):
            branches.setdefault(prefix[:half], []).append(f"{prefix}:{digest(leaves[prefix])}")
        top = ",".join(f"{prefix}:{digest(branches[prefix])}" for prefix in sorted(branches))
        return len(hashes), hashlib.sha256(f"{len(hashes)}|{top}".encode()).hexdigest()

    made = [hashlib.sha256(str(i % 700).encode()).hexdigest() for i in range(1000)]
    for leaf in (4096, 100, 2):
        monkeypatch.setattr(hashing, "LEAF_ROWS", leaf)
        for rows in (made, made[:1], []):
            frame = spark.createDataFrame([(h,) for h in rows], "h string").repartition(3)
            assert tuple(hashing.hash_tree(frame).first()) == expected(rows, leaf)


def test_rows_whose_lanes_add_up_alike_differ(spark):
    """Sums of 16-bit lanes cannot tell these sets apart."""
    pairs = (["0001" * 16, "0003" * 16], ["0002" * 16, "0002" * 16], ["0000" * 16, "0004" * 16])
    found = {
        hashing.hash_tree(spark.createDataFrame([(h,) for h in pair], "h string")).first()["rowset_sha256"]
        for pair in pairs
    }
    assert len(found) == 3


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("shape", ["spread", "piled"])
def test_running_totals_match_a_loop(spark, descending, shape):
    draw = random.Random(7)
    values = {draw.random() if shape == "spread" else 1 - draw.random() ** 9 for _ in range(400)}
    rows = [(v, draw.randint(0, 9)) for v in values]
    df = spark.createDataFrame(rows, "v double, n long").repartition(5)
    got = {r["v"]: r["cum_n"] for r in ranges.running_totals(df, "v", ["n"], descending=descending, ranges=16).collect()}
    total, wanted = 0, {}
    for v, n in sorted(rows, reverse=descending):
        total += n
        wanted[v] = total
    assert got == wanted


def test_quantiles_interpolate(spark):
    draw = random.Random(3)
    values = [draw.choice([5, 5, 5, draw.randint(0, 1000)]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    row = ranges.continuous_quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.123}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(np.quantile(values, [0.5, 0.95, 0.123]))


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "v long")
    assert ranges.continuous_quantiles(df, "v", {"a": 0.5}).first()["a"] is None


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group_with_a_hot_group(spark, k):
    rows = [("hot", i) for i in range(4000)] + [(f"g{i % 5}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(6)
    top = ranges.top_per_group(df, ["g"], [F.desc("i")], k)
    got = sorted((r["g"], r["i"], r["rn"]) for r in top.collect())
    wanted = []
    for g in {g for g, _ in rows}:
        members = sorted((i for h, i in rows if h == g), reverse=True)[:k]
        wanted += [(g, i, n) for n, i in enumerate(members, 1)]
    assert got == sorted(wanted)
