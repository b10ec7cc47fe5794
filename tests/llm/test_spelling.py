from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from casequeue.llm import spelling
from casequeue.llm.queries_spelling import one_letter_less
from casequeue.llm.spelling import apart, count_words, group_variants, near_words, variable_grams


def is_near(a: str, b: str) -> bool:
    """One insertion, deletion or replacement apart, from the definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts: dict[str, int], times=10):
    near = {w: [o for o in counts if is_near(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w], 0)) for w, n in counts.items())


def as_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def vocabulary(seed: int, syllables: int, n: int) -> dict[str, int]:
    r = random.Random(seed)
    parts = [r.choice("bdfgklmnprst") + r.choice("aeiouéñ") for _ in range(syllables)]
    made: Counter = Counter()
    while len(made) < n:
        word = "".join(r.choice(parts) for _ in range(r.randrange(4, 7)))
        made[word] = 10 ** r.randrange(1, 5)
        for _ in range(r.randrange(4)):
            at, c = r.randrange(len(word)), r.choice("aeioué")
            variant = r.choice((word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]))
            if len(variant) >= 7:
                made[variant] = max(2, made[word] // r.choice((5, 10, 100)))
                word = r.choice((word, variant))
    return dict(made)


@pytest.mark.parametrize(("seed", "syllables", "rare"), [(1, 6, 1), (2, 30, 8), (3, 4, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, syllables, rare):
    monkeypatch.setattr(spelling, "RARE", rare)
    counts = vocabulary(seed, syllables, 400)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert as_rows(group_variants(words)) == brute(counts)


def test_chains_lead_to_the_last_form(spark):
    counts = {"abcdefg": 100_000, "abcdefgh": 10_000, "abcdefghi": 1_000, "abcdefghij": 100, "abcdefghijk": 10}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert [r[2] for r in as_rows(group_variants(words))] == ["abcdefg"] * 5


def test_ties_repeated_letters_and_long_words(spark):
    counts = {"a" * 7: 2, "a" * 8: 20, "a" * 5_000: 3, "a" * 5_001: 40, "aaabaaa": 20, "aaacaaa": 2, "étéétéé": 2, "etéétéé": 20, "ÉTÉÉTÉÉ": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(group_variants(words)) == brute(counts)


def test_one_window_of_two_apart_is_always_unaffected():
    r = random.Random(9)
    for _ in range(400):
        word = "".join(r.choice("ab") for _ in range(r.randrange(7, 12)))
        frequent = {word[i : i + n]: r.randrange(9, 99) for n in range(2, 6) for i in range(len(word)) if r.random() < 0.6}
        first, second = apart(variable_grams(word, frequent), 4.0)
        assert first[0] + first[2] <= second[0]
        at = r.randrange(len(word) + 1)
        edited = r.choice((word[:at] + word[at + 1 :], word[:at] + "a" + word[at:], word[:at] + "b" + word[at + 1 :]))
        if len(edited) < 7:
            continue
        own = {(start, gram) for start, gram, _, _ in variable_grams(edited, frequent)}
        shift = len(edited) - len(word)
        assert any((g[0] + s, g[1]) in own for g in (first, second) for s in {0, shift})


def test_words_of_whole_texts(spark):
    texts = ["Kitchen kitchen, KITCHEN-kitchens", None, "", "straße123Straßen Straßen×x", "no long " * 3, "x" * 70_000]
    rows = [(None if i == 0 else i, t, "w", 5) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)

    def misspelled(doc_id, run):
        h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run

    plain, changed = Counter(), Counter()
    for doc_id, text, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            plain[run] += 1
            changed[misspelled(doc_id, run)] += 1
    for counts, misspell in ((plain, None), (changed, one_letter_less)):
        got = {r.word: r.n for r in count_words(docs, misspell=misspell).collect()}
        assert got == {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert group_variants(count_words(docs.limit(0))).collect() == []


def test_no_pair_twice(spark):
    counts = vocabulary(4, 8, 300)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [frozenset((r.a, r.b)) for r in near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) == sum(row[4] for row in brute(counts)) // 2
