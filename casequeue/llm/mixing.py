"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; a document's expected copies are its source's target
over its source's size. Whole copies are given at once. The fractional rests are rounded together:
two documents of a source meet and words of one move to the other, in a random direction whose
expectation is zero, until one of them has a whole number of copies. Words are conserved in each
meeting, so a source would miss its target only by the rounding of its last open document; the
documents of the last group make that good by turning over, largest first, where this comes nearer.

Documents meet in small groups first; the one left open by each group goes up a reduction tree, a
level of which has about ``1 / GROUP`` of the rows of the level below. A hot source is many groups
on every level but the last. All choices are hashes of seed, level and a row's key (id, hash of the
text, running number among rows equal in these), so reruns agree and rows of one id, or without one,
spread like any others. A source's last level, of at most ``LAST_GROUPS`` groups' rests, is one group.

Null texts have size 0 and are taken no times. A null source is a source, last in order. Repeated
rows are rounded one by one. Columns other than the id, text and source are ignored. Texts count
whole, whatever their length. An empty table has no targets and gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import fresh, handed_over

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 64
LAST_GROUPS = 32  # a level of fewer groups for a source is its last, of one group
MAX_COPIES = 3.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = MAX_COPIES
) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target``.

    Sources in code-point order weigh ``weights``, repeating. A target above ``max_copies`` times
    its source's size stops there; the rest is shared by weight among the others. In the order of
    size over weight the stopped sources come first, so running sums give the share per weight at
    which they end. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = per.withColumn("w", F.element_at(cycle, (turn % len(weights) + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(max_copies))
    capped = weighed.withColumn("most", most).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    summed = capped.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("gone"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_gone"),
        F.sum("w").over(whole).alias("w_all"),
        F.sum("source_size").over(whole).alias("all"),
    )
    share = (F.col("all") - F.col("gone")) / (F.col("w_all") - F.col("w_gone"))
    open_share = F.min(F.when(share <= F.col("ratio"), F.col("ratio"))).over(whole)
    level = summed.withColumn("share", share).withColumn("first_open", open_share)
    final = F.max(F.when(F.col("ratio") == F.col("first_open"), F.col("share"))).over(whole)
    target = F.least(F.col("most"), F.coalesce(final, F.lit(float("inf"))) * F.col("w"))
    return level.select("source", "source_size", "n_docs", target.alias("target"))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _uniform(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(items: str, item_type: str) -> Column:
    """Fold documents one after another; ``done`` with their rounding, and the one left open."""
    near = "1e-9D"
    return F.expr(f"""
aggregate({items},
  named_struct('done', cast(array() AS array<struct<e:{item_type},t:int>>),
    'e', cast(null AS {item_type}), 'p', 0D),
  (a, x) -> CASE WHEN a.e IS NULL THEN named_struct('done', a.done, 'e', x, 'p', x.p) ELSE
    transform(transform(transform(array(named_struct(
        'up', least(a.e.size * (1 - a.p), x.size * x.p),
        'down', least(x.size * (1 - x.p), a.e.size * a.p))),
      m -> named_struct('m', m, 'to_a', x.u * (m.up + m.down) < m.down)),
      m -> named_struct(
        'pa', CASE WHEN m.to_a THEN a.p + m.m.up / a.e.size ELSE a.p - m.m.down / a.e.size END,
        'px', CASE WHEN m.to_a THEN x.p - m.m.up / x.size ELSE x.p + m.m.down / x.size END)),
      m -> CASE
        WHEN (m.pa < {near} OR m.pa > 1 - {near}) AND (m.px < {near} OR m.px > 1 - {near})
        THEN named_struct('done', concat(a.done, array(
            named_struct('e', a.e, 't', CAST(round(m.pa) AS int)),
            named_struct('e', x, 't', CAST(round(m.px) AS int)))),
          'e', cast(null AS {item_type}), 'p', 0D)
        WHEN m.pa < {near} OR m.pa > 1 - {near}
        THEN named_struct('done',
          concat(a.done, array(named_struct('e', a.e, 't', CAST(round(m.pa) AS int)))),
          'e', x, 'p', m.px)
        ELSE named_struct('done',
          concat(a.done, array(named_struct('e', x, 't', CAST(round(m.px) AS int)))),
          'e', a.e, 'p', m.pa) END)[0] END)""")


def _made_good(done: str, gap: str) -> Column:
    """``done`` with documents turned over where that brings the sum nearer to the target.

    ``gap`` is the number of words by which the source has too many.
    """
    return F.expr(f"""
aggregate({done}, named_struct('gap', {gap}, 'done', filter({done}, d -> false)),
  (a, d) -> CASE
    WHEN abs(a.gap + (1 - 2 * d.t) * d.e.size) < abs(a.gap)
    THEN named_struct('gap', a.gap + (1 - 2 * d.t) * d.e.size,
      'done', concat(a.done, array(named_struct('e', d.e, 't', 1 - d.t))))
    ELSE named_struct('gap', a.gap, 'done', concat(a.done, array(d))) END).done""")


def _round_level(open_rows: DataFrame, groups: Column, seed: int, level: int) -> DataFrame:
    """One level of the tree: rows with ``t`` 0 or 1, or null and a new ``p`` where still open.

    A source of one group is on its last level, and none of its rows stays open.
    """
    id_hash = [F.col("row_key"), F.lit(seed), F.lit(level)]
    rows = open_rows.withColumn("last", groups == 1).withColumn(
        "bucket", F.pmod(F.xxhash64(*id_hash, F.lit("group")), groups)
    ).withColumn("u", _uniform(*id_hash, F.lit("move")))
    item = F.struct((-F.col("size")).alias("big"), "u", "row_key", "doc_id", "mark", "size", "p",
                    "whole", "n_docs", "source_size", "target")
    grouped = rows.groupBy("source", "last", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = grouped.schema["items"].dataType.elementType.simpleString()
    folded = grouped.select("source", "last", _meet("items", kind).alias("f"))
    gap = "coalesce((round(f.p) - f.p) * f.e.size, 0D)"
    folded = folded.withColumn(
        "done", F.when(F.col("last"), _made_good("f.done", gap)).otherwise(F.col("f.done"))
    )
    ended = F.transform(
        "done", lambda d: F.struct(d["e"].alias("e"), F.lit(0.0).alias("p"), d["t"].alias("t"))
    )
    rounded = F.when(F.col("last"), F.round("f.p").cast("int"))
    left = F.array(F.struct(F.col("f.e").alias("e"), F.col("f.p").alias("p"), rounded.alias("t")))
    every = F.when(F.col("f.e").isNull(), ended).otherwise(F.concat(ended, left))
    out = folded.select("source", F.explode(every).alias("r"))
    return out.select(
        *(F.col(f"r.e.{c}") for c in ("row_key", "doc_id", "mark", "size")),
        "source",
        *(F.col(f"r.e.{c}") for c in ("source_size", "target", "n_docs", "whole")),
        "r.p",
        "r.t",
    )


def mix_copies(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: float = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, mark, size, source, source_size, target, copies`` for each row of ``docs``.

    ``mark`` is a hash of the text.
    """
    marked = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark")
    )
    # Rows equal in all of these are counted before they move, then numbered in place.
    counted = marked.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n"))
    numbered = counted.withColumn("nth", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    sizes = handed_over(
        numbered.withColumn("row_key", F.xxhash64("doc_id", "mark", "nth")).drop("nth")
    )
    targets = handed_over(source_targets(sizes, weights=weights, max_copies=max_copies))
    per_source = targets.select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    expected = F.least(F.lit(float(max_copies)), F.col("target") / F.greatest("source_size", F.lit(1)))
    rows = (
        sizes.join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor(F.col("expected") + 1e-12).cast("int"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    )
    settled = (F.col("size") == 0) | (F.col("p") < 1e-9)
    columns = ["row_key", "doc_id", "mark", "size", "source", "source_size", "target", "n_docs", "whole", "p", "t"]
    level_rows = rows.withColumn("t", F.when(settled, 0)).select(*columns)
    done = level_rows.where(F.col("t").isNotNull())
    rest = level_rows.where(F.col("t").isNull()).drop("t")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    level, spread = 0, 1
    while True:
        spread *= GROUP
        groups = F.ceil(F.col("n_docs") / F.lit(spread)).cast("long")
        groups = F.when(groups < LAST_GROUPS, F.lit(1)).otherwise(groups)
        rounded = handed_over(_round_level(rest, groups, seed, level).select(*columns))
        done = done.unionByName(rounded.where(F.col("t").isNotNull()))
        if -(-most // spread) < LAST_GROUPS:  # every source had one group
            break
        rest, level = rounded.where(F.col("t").isNull()).drop("t"), level + 1
    copies = (F.col("whole") + F.col("t")).alias("copies")
    return done.select("doc_id", "mark", "size", "source", "source_size", "target", copies)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it; none without words.

    Options are those of ``mix_copies``. Rows with equal id, source and text are told apart by a
    running number.
    """
    size, mark, nth, copies = fresh(docs, "size", "mark", "nth", "copies")
    key = [F.col("doc_id"), F.col("source"), F.col(size), F.col(mark)]
    sized = docs.withColumn(size, n_words(F.col("text"))).withColumn(mark, _mark(F.col("text")))
    hashed = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    own = Window.partitionBy(*key).orderBy(F.xxhash64(*hashed))
    numbered = sized.where(F.col(size) > 0).withColumn(nth, F.row_number().over(own))
    taken = mix_copies(docs, **options).where("size > 0").select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"),
        F.col("mark").alias("m"), "copies",
    )
    taken = taken.withColumn(
        "n", F.row_number().over(Window.partitionBy("i", "s", "z", "m").orderBy(F.desc("copies")))
    ).select("i", "s", "z", "m", "n", F.col("copies").alias("c"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("i"))
        & F.col("source").eqNullSafe(F.col("s"))
        & (F.col(size) == F.col("z"))
        & (F.col(mark) == F.col("m"))
        & (F.col(nth) == F.col("n"))
    )
    joined = numbered.join(taken.where("c > 0"), same)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col("c")))).select(*docs.columns)
