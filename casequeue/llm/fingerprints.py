"""Merkle-tree fingerprints of documents, and edits located by comparing trees.

Leaves are paragraphs: lines, cut after sentence ends and after 64 characters, so that one long
line has many leaves. A section ends at a leaf whose hash starts with 0 (or after 32 leaves), so an
insertion moves no section but its own. Hashes of leaves and sections have 128 bits, and the root
hashes the whole hashes of the sections, so equal roots mean equal texts. A fingerprint is
``root:sections:leaves`` in hexadecimal; it shows the starts of the hashes below the root, which
only locate edits.

Null texts count as empty: no leaves, the root of nothing. Equal texts have equal fingerprints.
Very long texts have as many leaves as they need. An empty table gives an empty table, and repeated
rows a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import cut_at, fresh, partitions, quantile_points

LEAF = r"[^.!?\n]{1,64}[.!?]*\n?|[.!?]{1,64}\n?|\n+"
LEAF_HEX = 8  # shown of a leaf's hash
SECTION_HEX = 16  # shown of a section's hash
SECTION_LEAVES = 32


def section_pattern(digits: int) -> str:
    """Pattern of a section in joined leaf hashes of ``digits`` digits each."""
    more, rest = f"(?:[1-9a-f][0-9a-f]{{{digits - 1}}})", f"[0-9a-f]{{{digits - 1}}}"
    return f"{more}{{0,{SECTION_LEAVES - 1}}}0{rest}|{more}{{1,{SECTION_LEAVES}}}"


SECTION = section_pattern(32)
SHOWN_SECTION = section_pattern(LEAF_HEX)


def leaf_hashes(text: Column) -> Column:
    """Hash of each paragraph of a text, in order."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEAF), F.lit(0))
    return F.transform(pieces, lambda p: F.md5(p.cast("binary")))


def section_hashes(leaves: Column) -> Column:
    """Hash of each section over the leaf hashes of a text, in order."""
    joined = F.array_join(leaves, "")
    sections = F.regexp_extract_all(joined, F.lit(SECTION), F.lit(0))
    return F.transform(sections, lambda s: F.md5(s.cast("binary")))


def _shown(hashes: Column, digits: int) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.substring(h, 1, digits)), "")


def tree(sections: Column, leaves: Column) -> Column:
    """``root:sections:leaves`` over the hashes of both."""
    root = F.md5(F.array_join(sections, "").cast("binary"))
    return F.concat_ws(":", root, _shown(sections, SECTION_HEX), _shown(leaves, LEAF_HEX))


def fingerprint(text: Column) -> Column:
    leaves = leaf_hashes(text)
    return tree(section_hashes(leaves), leaves)


def likeness(left: Column, right: Column, left_root: Column, right_root: Column) -> Column:
    """0 to 1: 1 for equal roots, else the share of distinct leaves in common (Dice)."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    return F.when(left_root == right_root, F.lit(1.0)).otherwise(
        F.when(total == 0, 0.0).otherwise(2.0 * shared / total)
    )


def _matched(before: list, after: list) -> list[tuple[int, int, int, int]]:
    """Spans that differ once elements equal in order are paired, each with one at most."""
    start, most = 0, min(len(before), len(after))
    while start < most and before[start] == after[start]:
        start += 1
    end = 0
    while end < most - start and before[-1 - end] == after[-1 - end]:
        end += 1
    left, right = before[start : len(before) - end], after[start : len(after) - end]
    codes = SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
    return [tuple(start + x for x in code[1:]) for code in codes if code[0] != "equal"]


def _edits(before: str | None, after: str | None) -> list[tuple[int, int, int, int]] | None:
    if before is None or after is None:
        return None
    old, new = before.split(":"), after.split(":")
    if old[0] == new[0]:
        return []
    sections, leaves, starts = [], [], []
    for _, hashes, joined in (old, new):
        sections.append(re.findall(f".{{{SECTION_HEX}}}", hashes))
        leaves.append(re.findall(f".{{{LEAF_HEX}}}", joined))
        sizes = (len(found) // LEAF_HEX for found in re.findall(SHOWN_SECTION, joined))
        starts.append(list(accumulate(sizes, initial=0)))
    found = []
    for i, j, k, m in _matched(*sections):
        i, j, k, m = starts[0][i], starts[0][j], starts[1][k], starts[1][m]
        spans = _matched(leaves[0][i:j], leaves[1][k:m])
        spans = spans or [(0, j - i, 0, m - k)]  # what is shown agrees, what it stands for does not
        found += [(i + a, i + b, k + c, k + d) for a, b, c, d in spans]
    return found


def edits(before: Column, after: Column) -> Column:
    """Places where the texts of two fingerprints differ, in order: ``start, end, new_start, new_end``.

    Leaves ``start`` to before ``end`` (from 0) of the one are leaves ``new_start`` to before ``new_end``
    of the other; an insertion has no leaves of the one, a deletion none of the other, and what moved is
    both. Works on fingerprints alone: nothing for equal roots; sections equal in order are dropped,
    and the leaves of the others are paired in order; sections that differ in no leaf shown are given
    whole. Null for a null fingerprint.
    """
    kind = "array<struct<start: int, end: int, new_start: int, new_end: int>>"
    return F.udf(_edits, kind)(before, after)


def changed_leaves(before: Column, after: Column) -> Column:
    """Positions (from 0) of leaves of ``before`` that are replaced, moved or deleted in ``after``."""
    spans = F.filter(edits(before, after), lambda e: e["end"] > e["start"])
    return F.flatten(F.transform(spans, lambda e: F.sequence(e["start"], e["end"] - 1)))


def _place(key: Column, tie: Column, points: list, nulls: int) -> Column:
    """Number of a row's range by descending key, then by tie.

    A value that is a cut point several times starts its range, so its rows come after the larger
    keys there, in as many slices of the tie; null keys come last in ``nulls`` slices.
    """
    hot = {p: n for p, n in Counter(points).items() if n > 1}
    slices = F.when(key.isNull(), F.lit(nulls))
    if hot:
        pairs = [x for p, n in hot.items() for x in (F.lit(p), F.lit(n))]
        slices = slices.otherwise(F.element_at(F.create_map(*pairs), key.cast("long")))
    share = tie.cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)
    slice_of = F.least(F.floor(share * slices), slices - 1) + 1
    at = -cut_at(key, sorted(set(points))).cast("long")
    return at * F.lit(1 << 32) + F.coalesce(slice_of, F.lit(0))


def with_next(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "next_text"
) -> DataFrame:
    """Adds the text of the next row by descending key; after the last comes the first.

    Null keys come last, rows with equal keys by a hash of their text; identical rows are
    interchangeable. The rows move once, cut into ranges of the key, and of the hash where one key (or
    null) would fill more than a range; the first row of the following range goes along as a guard. An
    empty table stays empty; a single row is its own next.
    """
    spark = docs.sparkSession
    chunk, tie, to, guard = fresh(docs, "chunk", "tie", "to", "guard")
    ranges = 4 * partitions(spark)
    bounds = quantile_points(docs, key, ranges)
    rows, keyed = docs.agg(F.count("*"), F.count(key)).first()
    tied = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    placed = docs.withColumn(tie, tied).withColumn(
        chunk, _place(F.col(key), F.col(tie), bounds, 1 + ranges * (rows - keyed) // max(1, rows))
    )
    # One row per range: at most some eight times the number of shuffle partitions.
    heads = (
        placed.groupBy(chunk)
        .agg(F.min(F.struct((-F.col(key)).alias("k"), F.col(tie).alias("t"))).alias("h"))
        .orderBy(chunk)
        .collect()
    )
    following = [
        (None if nxt["h"]["k"] is None else -nxt["h"]["k"], nxt["h"]["t"], row[chunk])
        for row, nxt in zip(heads, heads[1:] + heads[:1], strict=True)
    ]
    guards = spark.createDataFrame(following, "gk long, gt long, gc long")
    guards = guards.groupBy("gk", "gt").agg(F.collect_list("gc").alias(to))
    joined = placed.join(
        F.broadcast(guards), F.col(key).eqNullSafe(F.col("gk")) & (F.col(tie) == F.col("gt")), "left"
    ).drop("gk", "gt")
    own = F.array(F.struct(F.lit(False).alias("g"), F.col(chunk).alias("c")))
    extra = F.transform(
        F.coalesce(F.col(to), F.array().cast("array<long>")),
        lambda c: F.struct(F.lit(True).alias("g"), c.alias("c")),
    )
    rows = joined.withColumn(guard, F.explode(F.concat(own, extra))).drop(to)
    order = Window.partitionBy(f"{guard}.c").orderBy(
        F.col(f"{guard}.g"), F.desc_nulls_last(key), F.col(tie)
    )
    led = rows.withColumn(name, F.coalesce(F.lead(text).over(order), F.lit("")))
    return led.where(~F.col(f"{guard}.g")).drop(guard, chunk, tie)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edit, with likenesses.

    The edit replaces the last half of the code points by the first as many of the next document.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(base).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        "next_text",
        F.concat(
            F.substring(F.col("text"), F.lit(1), n - half),
            F.substring(F.col("next_text"), F.lit(1), half),
        ).alias("edited"),
    )
    hashed = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        leaf_hashes(F.col("text")).alias("a"),
        leaf_hashes(F.col("edited")).alias("b"),
        leaf_hashes(F.col("next_text")).alias("c"),
    )
    named = hashed.withColumns({f"{x}_sections": section_hashes(F.col(x)) for x in "abc"})
    trees = named.withColumns({f"{x}_tree": tree(F.col(f"{x}_sections"), F.col(x)) for x in "abc"})
    root = {x: F.substring(F.col(f"{x}_tree"), 1, 32) for x in "abc"}
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("a_tree").alias("fingerprint"),
        F.col("b_tree").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), root["a"], root["b"]).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), root["a"], root["c"]).alias("near_next"),
    )
