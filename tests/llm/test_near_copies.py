from __future__ import annotations

import random

import numpy as np

from casequeue.llm import common, near_copies
from tests.llm.samples import documents, nothing, texts


def brute(rows, words):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w)} if 0 < len(w) < words else {tuple(w[j : j + words]) for j in range(len(w) - words + 1)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def copies(n=60):
    """Chains of edits, so that many links lie near the threshold."""
    r = random.Random(6)
    made = []
    for _ in range(4):
        text = [f"w{r.randrange(3000)}" for _ in range(120)]
        for _ in range(n // 4):
            made.append(" ".join(text))
            for _ in range(r.randrange(1, 5)):
                text[r.randrange(len(text))] = f"e{r.randrange(9999)}"
    return made


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PARTNERS", 3)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    made = [*texts(), *copies(), "Same Words here", "same words HERE", "same words"]
    docs = documents(spark, made)
    for words in (4, 5):
        assert found(near_copies.near_copies(docs, words=words)) == brute(list(enumerate(made)), words)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (6, None), (None, "z")]
    out = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(None, 5, False)] * 2 + [(5, 5, True)] * 2 + [(6, 6, True), (None, None, True)], key=str)


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, [*texts(), *copies(20)])
    kept = {i for i, (_, _, k) in found(near_copies.near_copies(docs)).items() if k}
    left = near_copies.without_copies(docs.unionByName(docs.limit(5)))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(kept)


def test_rows_without_own_ids_are_told_apart(spark):
    copy = "a copy of words that a numbered row has too"
    again = "words that rows without an id alone have in common"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, copy), (None, copy), (None, again), (None, again), (None, "clean words of its own and no others"),
        (7, "one text under an id that comes again"), (7, "another text with that very same id here"),
        (8, copy), (8, "a text whose id a copy has as well"), (9, ""), (9, ""), (None, None), (None, ""), (None, ""),
        (None, near), (None, f"{near} end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in near_copies.without_copies(docs).collect()), key=str)
    one_of = [r for r in got if r[1] and r[1].startswith("w0 ")]
    assert len(one_of) == 1
    assert [r for r in got if r not in one_of] == sorted(
        [rows[i] for i in (0, 2, 4, 5, 6, 8, 9, 11, 12, 13)], key=str
    )
    kept = [r for r in near_copies.near_copies(docs).collect() if r["component_id"] is None and r["n_shingles"]]
    assert len(kept) == 5 and sum(r["kept"] for r in kept) == 3


def test_near_copies_of_one_id_alone(spark):
    near = " ".join(f"w{i}" for i in range(60))
    for i in (None, 3):
        docs = spark.createDataFrame([(i, near), (i, f"{near} end"), (i, "words apart")], "doc_id long, text string")
        got = [(r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(docs).collect()]
        assert [g[1] for g in got] == [i] * 3
        assert sum(g[2] for g in got) == (2 if i is None else 3)
        assert near_copies.without_copies(docs).count() == 2


def test_empty_table(spark):
    assert found(near_copies.near_copies(nothing(spark))) == {}
    assert near_copies.without_copies(nothing(spark)).count() == 0


def test_bounds_keep_pairs_at_the_threshold():
    r = np.random.default_rng(1)
    bounds = near_copies.least_matches(0.8)
    matches = (r.random((20000, near_copies.ROWS * near_copies.BANDS)) < 0.8).cumsum(1)
    lost = np.zeros(20000, bool)
    for n, least in bounds:
        lost |= matches[:, n - 1] < least
    assert lost.mean() < 1e-3
    assert bounds[-1][1] > 100


def test_sets_of_one_short_hash_are_told_apart(spark):
    schema = "rid long, hash long, uid long, n long, cid long, check long, sig binary"
    given = [(1, 1, 1, 3, 7, 5), (2, 2, 2, 3, 7, 5), (3, 3, 3, 4, 7, 6), (4, 4, 4, 4, 7, 9), (5, 5, 5, 2, 8, 5), (6, 6, 6, 0, None, None)]
    rows, classes = near_copies.classified(spark.createDataFrame([(*r, None) for r in given], schema))
    name = {r["rid"]: r["cid"] for r in rows.collect()}
    assert name[1] == name[2] == 7 and name[5] == 8 and name[6] is None
    assert len(set(name.values())) == 5
    assert sorted((r["first"]["rid"], r["n"]) for r in classes.collect()) == [(1, 3), (3, 4), (4, 4), (5, 2)]
    assert {r["cid"] for r in classes.collect()} == set(name.values()) - {None}


def test_caches_of_other_operators_go():
    from casequeue.llm import quality

    near_copies.shingles("some words of a text", 2)
    quality.text_features("some words of a text", quality._WORDS)
    common.keep_only(quality._WORDS)
    assert not near_copies._HASHES and quality._WORDS
    common.keep_only()
    assert not quality._WORDS
