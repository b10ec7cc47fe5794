"""Groups spelling variants with a variable-length gram index.

Words are runs of letters of a least length and count. The gram dictionary is built level by level from
the grams of ``SHORTEST`` characters: a gram stays in it, and is extended by one character, while more words
than a share of all grams hold it. So it is pruned by frequency, and its size is bounded: at most
``FREQUENT`` grams of each length, whatever the table. A word has one gram at each place: the longest that the
dictionary leads to, of at most ``LONGEST`` characters.

The choice of a gram looks at a window of the word only: its characters, and the word's end if that
stopped it. One inserted, deleted or replaced character affects the grams whose windows hold it. Two windows
of a word that do not overlap are never both affected, so of the two lists of such a pair of grams at least
one holds every near word, at the same place or one further. That is the affected-gram bound for one edit, and
it takes the pair with the shortest lists by the dictionary's counts. Lists are by gram, place and word
length; a word looks into those of its own length and of one more, so each pair is found from its
shorter word. What lists bring together is verified in the join, first by the sets of letters, then by the
edit distance itself, so that only true pairs leave it.

Null texts have no words; null ids are like the text ``null``. Ties in counts go to the smaller word
in code-point order, and since a form occurs many times as often as its word, chains of forms end. An
empty table gives no rows. A very long word has no more than two lists to look into; its own grams grow with its
length. Rows that repeat count again. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.llm.common import bound_batches, handed_over

LETTERS = "A-Za-z\u00C0-\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST = 2, 5
LEAST_LENGTH = SHORTEST + LONGEST  # shorter words may have no two windows apart
FREQUENT = 32_768
RARE = 8  # words with a gram that need no longer one
TIMES = 10  # as often as its word a form occurs at least

Gram = tuple[int, str, int, int]  # start, text, characters looked at, words that hold it if frequent


def count_words(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = 2,
    misspell: Callable[[Column, Column], Column] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``word, n``: words of whole texts; ``misspell`` may change one, given its row's id."""
    # A changed word may become shorter, never longer, so shorter runs need not be looked at.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run")
    ).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if misspell is not None:
        each = each.withColumn("word", misspell(F.col("id"), F.col("word")))
    counted = each.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], float]:
    """Frequent grams with the number of their places, at most ``FREQUENT`` a length, and the limit."""
    places = words.agg(F.sum(F.length("word") - (SHORTEST - 1))).first()[0] or 0
    limit = max(float(RARE), places / FREQUENT)
    found: dict[str, int] = {}
    level: list[str] | None = None
    for length in range(SHORTEST, LONGEST + 1):
        last = F.length("word") - (length - 1)
        at = F.explode(F.sequence(F.lit(1), last)).alias("at")
        grams = words.where(last >= 1).select("word", at).select(F.expr(f"substring(word, at, {length})").alias("gram"))
        if level is not None:  # bounded, like the dictionary itself
            shorter = words.sparkSession.createDataFrame([(g,) for g in level], "head string")
            grams = grams.join(
                F.broadcast(shorter), F.expr(f"substring(gram, 1, {length - 1})") == F.col("head"), "left_semi"
            )
        counts = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        rows = counts.collect()
        if not rows:
            break
        level = [r.gram for r in rows]
        found.update((r.gram, r.n) for r in rows)
    return found, limit


def variable_grams(word: str, frequent: dict[str, int]) -> list[Gram]:
    """The gram at each place of a word."""
    grams = []
    end = len(word)
    for start in range(end - SHORTEST + 1):
        stop = start + SHORTEST
        count = frequent.get(word[start:stop], 0)
        seen = stop
        while count and stop - start < LONGEST:
            if stop == end:
                seen = end + 1  # the word's end decided
                break
            stop += 1
            seen = stop
            count = frequent.get(word[start:stop], 0)
        grams.append((start, word[start:stop], seen - start, count))
    return grams


def apart(grams: list[Gram], rare: float) -> tuple[Gram, Gram]:
    """Two grams with no common window whose lists are the shortest together."""
    cost = [g[3] or rare for g in grams]
    best_from = [len(grams) - 1] * len(grams)
    for i in range(len(grams) - 2, -1, -1):
        later = best_from[i + 1]
        best_from[i] = i if cost[i] < cost[later] else later
    best = None
    for i, (start, _, seen, _) in enumerate(grams):
        if start + seen < len(grams):
            j = best_from[start + seen]
            if best is None or cost[i] + cost[j] < best[0]:
                best = (cost[i] + cost[j], grams[i], grams[j])
    return best[1], best[2]


def _keys(word: str, frequent: dict[str, int], rare: float) -> tuple[list[str], list[str]]:
    """Lists that hold a word, and lists it looks into."""
    length = len(word)
    grams = variable_grams(word, frequent)
    own = [f"{length}.{start}.{gram}" for start, gram, _, _ in grams]
    looks = []
    for start, gram, _, _ in apart(grams, rare):
        looks += [f"{length + more}.{start + shift}.{gram}" for more, shift in ((0, 0), (1, 0), (1, 1))]
    return own, looks


def _indexed(words: DataFrame, frequent: dict[str, int], limit: float) -> DataFrame:
    """Words with their lists, and with a bit for each letter they hold."""
    rare = limit / 2
    shared = words.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT grams a length

    @F.arrow_udf("struct<own: array<string>, looks: array<string>>")
    def keys(column: pa.Array) -> pa.Array:
        rows = [_keys(word.as_py(), shared.value, rare) for word in column]
        own, looks = (pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (0, 1))
        return pa.StructArray.from_arrays([own, looks], ["own", "looks"])

    letters = F.aggregate(
        F.split("word", ""),
        F.lit(0).cast("bigint"),
        lambda mask, letter: mask.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(letter) % 61)
        ),
    )
    return words.withColumn("letters", letters).withColumn("keys", keys("word"))


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one edit apart once, given distinct ``word, n``.

    Words have at least ``LEAST_LENGTH`` characters.
    """
    bound_batches(words.sparkSession)
    frequent, limit = gram_dictionary(words)
    indexed = handed_over(_indexed(words, frequent, limit))
    # A hash of a list's name serves as its key: what meets by chance fails below.
    lists, looks = (
        indexed.select("word", "n", "letters", F.explode(f"keys.{name}").alias("list")).select(
            "word", "n", "letters", F.xxhash64("list").alias("key")
        )
        for name in ("own", "looks")
    )
    a, b = looks.alias("a"), lists.alias("b")
    met = (
        (F.col("a.key") == F.col("b.key"))
        & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2)
        & ((F.length("a.word") < F.length("b.word")) | (F.col("a.word") < F.col("b.word")))
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return (
        a.join(b, met)
        .selectExpr("a.word as a", "a.n as a_n", "b.word as b", "b.n as b_n")
        .distinct()
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the last of each chain, by doubling."""
    reached = handed_over(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = handed_over(reached.join(onward, "root", "left").select("word", "root", "next"))
        reached = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return reached


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with counts.

    The form of a word is its most frequent near word if that occurs ``times`` as often at least.
    """
    words = handed_over(words.select("word", "n"))
    pairs = handed_over(near_words(words))
    sides = pairs.select("a", "a_n", "b", "b_n").union(pairs.select("b", "b_n", "a", "a_n"))
    near = (
        sides.groupBy(F.col("a").alias("word"))
        .agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("b_n"), F.col("b"))).alias("best"))
        .select("word", "n_near", (-F.col("best.col1")).alias("best_n"), F.col("best.b").alias("best"))
    )
    formed = F.col("best_n") >= times * F.col("n")
    found = handed_over(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).cast("long").alias("form_n"),
        )
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
