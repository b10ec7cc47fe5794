"""Near copies: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document is the set of its distinct ``words``-word shingles (its whole word sequence if shorter);
documents are linked if their Jaccard similarity is at least ``threshold``, and components of links
are groups. Documents with equal sets, by 128 bits of hash, are one class; everything else works on classes.

1. MinHash signatures of ``BANDS`` x ``ROWS`` values; classes that agree on a band meet in a bucket.
2. In ``ROUNDS`` rounds, every bucket that holds several components names a pivot, first the class
   that meets the most others, then classes drawn in proportion; every class is compared with the
   one pivot of another component that it meets most often. A round has at most one pair per class.
3. A pair's signatures are compared ``BATCH`` values at a time. After each batch the posterior of the
   similarity, under a uniform prior, decides: a pair whose chance to reach the threshold is below
   ``MISS`` is dropped.
4. Pairs that are left are confirmed on their full shingle sets, sorted by their common class so
   that a task holds two sets at a time. Classes with many partners are split.
5. What then still shares buckets across components is compared in full: within a cluster of such
   components, blocks of the classes outside the largest one meet blocks of all, by set counts
   inside a task, which returns one link for each two components at most. So no pair of a bucket
   that could join two components is left out, and none is written out to be dropped.

A link is missed only if no band agrees (probability (1 - s**ROWS) ** BANDS, 3e-6 at s = 0.8) or
the posterior errs. Documents without words, and null texts, are linked with nothing. Null ids count
as larger than all others and come back as null. Rows with equal ids have a set and a component each;
a component's number is the smallest id in it. ``kept`` tells rows whose id is that number; of a
component of null ids alone it tells one row. An empty table has no rows.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import bound_batches, fresh, handed_over, keep_only, partitions, worker_cache
from casequeue.llm.suffix_kernel import mix

WORDS = 5
THRESHOLD = (4, 5)
ROWS, BANDS = 5, 32
BATCH = 32
MISS = 1e-5
ROUNDS = 2
BLOCK_SHINGLES = 1_500_000  # of the sets that a task holds in step 5
DENSE_BYTES = 1 << 26
PARTNERS = 2_000  # of one class confirmed in one task
CACHE_WORDS = 150_000
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


_HASHES = worker_cache(_Hashes())


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    if len(h) < words:
        return mix(*(h[i : i + 1] for i in range(len(h))), np.array([len(h)], np.uint64))
    return np.unique(mix(*(h[i : len(h) - words + 1 + i] for i in range(words))))


def signature(found: np.ndarray) -> np.ndarray:
    out = np.empty(ROWS * BANDS, np.uint64)
    for i in range(0, len(out), 32):
        out[i : i + 32] = ((found[None, :] ^ _FLIP[i : i + 32, None]) * _TIMES[i : i + 32, None]).min(1)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """``(n, m)``: of the first n values at least m must agree for a pair to go on.

    Under a uniform prior the similarity given m of n matches has a beta distribution, whose tail
    beyond the threshold is a binomial sum.
    """
    bounds = []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        bounds.append((n, m))
    return bounds


def _signed(words: int):
    def run(batches):
        keep_only(_HASHES)
        for batch in batches:
            size, cid, check, sig = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                size.append(len(s))
                if len(s):
                    digest = blake2b(s.tobytes(), digest_size=16).digest()
                    cid.append(int.from_bytes(digest[:8], "little", signed=True))
                    check.append(int.from_bytes(digest[8:], "little", signed=True))
                    sig.append(signature(s).tobytes())
                else:
                    for column in (cid, check, sig):
                        column.append(None)
            found = [pa.array(c, pa.int64()) for c in (size, cid, check)] + [pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], *found],
                names=["rid", "hash", "uid", "n", "cid", "check", "sig"],
            )

    return run


def _banded(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
        cid = batch.column(0).to_numpy()
        for band in range(BANDS):
            rows = [sig[:, band * ROWS + i] for i in range(ROWS)]
            key = mix(np.full(len(cid), band + 1, np.uint64), *rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid)], names=["bucket", "cid"])


def _likely(bounds):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
                for i in (2, 3)
            )
            alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, least in bounds:
                matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(1)
                alive, at = alive[matches[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _confirmed(words: int, threshold: tuple[int, int]):
    """Pairs at or above the threshold; rows of a common class ``a`` come first with their text."""

    def run(batches):
        current, base = None, None
        for batch in batches:
            found = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (a, b), text in zip(keys, batch.column(2), strict=True):
                s = shingles(text.as_py(), words)
                if a == b:
                    current, base = a, s
                    continue
                if a != current:
                    raise ValueError("a pair came without the text of its common class")
                both = np.intersect1d(base, s, assume_unique=True).size
                if both * threshold[1] >= (len(base) + len(s) - both) * threshold[0]:
                    found.append((a, b))
            if found:
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


def _compared(words: int, threshold: tuple[int, int]):
    """One link ``a, b`` for each two components met, in blocks of classes.

    Rows of a unit come in the order of ``late``: those to compare with, then those to compare.
    """

    def run(batches):
        unit, base, block = None, [], None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for cluster, name, late, cid, label, text in zip(*columns, strict=True):
                at = (cluster, name)
                if at != unit:
                    unit, base, block = at, [], None
                if not late:
                    base.append((cid, label, shingles(text, words)))
                    continue
                if not base:  # no class was dealt to this piece
                    continue
                if block is None:
                    block = _Block(base)
                found += block.links(cid, label, shingles(text, words), threshold)
            if found:
                pairs = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

    return run


class _Block:
    """Sets of classes, against which others are counted."""

    def __init__(self, base: list[tuple[int, int, np.ndarray]]):
        self.cids = [c for c, _, _ in base]
        self.labels = np.array([x for _, x, _ in base], np.int64)
        self.sizes = np.array([len(s) for _, _, s in base], np.int64)
        joined = np.concatenate([s for _, _, s in base])
        owner = np.repeat(np.arange(len(base)), self.sizes)
        self.known, place = np.unique(joined, return_inverse=True)
        self.parent: dict[int, int] = {}
        width = -(-len(self.known) // 64)
        self.bits = None
        if width * 8 * len(base) <= DENSE_BYTES:
            self.bits = np.zeros((len(base), width), np.uint64)
            one = np.uint64(1) << (place % 64).astype(np.uint64)
            np.bitwise_or.at(self.bits, (owner, place // 64), one)
        else:
            order = np.argsort(place, kind="stable")
            self.owners = owner[order]
            self.starts = np.searchsorted(place[order], np.arange(len(self.known) + 1))

    def root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def shared(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        at = at[self.known[at] == s]
        if self.bits is not None:
            mine = np.zeros(self.bits.shape[1], np.uint64)
            np.bitwise_or.at(mine, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
            used = np.flatnonzero(mine)
            return np.bitwise_count(self.bits[:, used] & mine[used]).sum(1, dtype=np.int64)
        spans = [self.owners[self.starts[i] : self.starts[i + 1]] for i in at.tolist()]
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *spans]), minlength=len(self.cids))

    def links(self, cid: int, label: int, s: np.ndarray, threshold: tuple[int, int]) -> list:
        both = self.shared(s)
        hit = np.flatnonzero(
            (both * threshold[1] >= (self.sizes + len(s) - both) * threshold[0]) & (self.labels != label)
        )
        out = []
        for i in hit.tolist():
            a, b = self.root(label), self.root(int(self.labels[i]))
            if a != b:
                self.parent[a] = b
                out.append((cid, self.cids[i]))
        return out


def _row_key() -> list[Column]:
    """Id and hash of the text of a row: rows that agree in both are in one class."""
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return [rid.alias("rid"), F.xxhash64("text").alias("hash")]


def _merge(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """A join by sorting both sides, whatever their size: what moves grows in proportion."""
    return left.join(right.hint("merge"), key)


def classified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with one ``cid`` for each set, and a row for each class with its ``first`` row.

    Sets are told apart by 128 bits, ``cid`` and ``check``. Where different sets have one ``cid``, all but
    that of the least ``check`` get another, until no two share one.
    """
    while True:
        classes = handed_over(
            rows.where("cid is not null")
            .groupBy("cid")
            .agg(
                F.min(F.struct("rid", "hash", "uid")).alias("first"),
                F.max("n").alias("n"),
                F.min("check").alias("least"),
                F.max("check").alias("most"),
            )
        )
        shared = classes.where("least <> most").select("cid", "least")
        if not shared.limit(1).count():
            return rows, classes.drop("least", "most")
        apart = F.when(F.col("check") != F.col("least"), F.xxhash64("cid", "check"))
        marked = rows.join(shared.hint("merge"), "cid", "left").withColumn("cid", F.coalesce(apart, "cid"))
        rows = handed_over(marked.select(*rows.columns))


class _Linker:
    def __init__(self, docs: DataFrame, words: int, threshold: tuple[int, int]):
        self.spark = docs.sparkSession
        bound_batches(self.spark)
        self.words, self.threshold = words, threshold
        self.bounds = least_matches(threshold[0] / threshold[1])
        rid, digest = _row_key()
        self.texts = docs.select(rid, "text", digest)
        # Written with the rows, ``uid`` tells identical ones apart.
        self.rows = handed_over(
            self.texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
                _signed(words), "rid long, hash long, uid long, n long, cid long, check long, sig binary"
            )
        )
        self.rows, self.classes = classified(self.rows)

    def buckets(self) -> DataFrame:
        """Classes of buckets that have several, with the number of meetings of the class."""
        signed = self.rows.where("cid is not null").select("cid", "sig")
        banded = signed.mapInArrow(_banded, "bucket long, cid long")
        shared = handed_over(
            banded.groupBy("bucket")
            .agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.count("*").alias("met"))
            .where("least <> most")
            .select("bucket", "met")
        )
        met = handed_over(_merge(banded, shared, "bucket").groupBy("bucket", "cid").agg(F.max("met").alias("met")))
        degrees = met.groupBy("cid").agg(F.sum("met").alias("degree"))
        return handed_over(met.join(degrees, "cid").select("bucket", "cid", "degree"))

    def gather(self, members: DataFrame) -> None:
        """Signature and text of the classes in shared buckets, from one of their documents."""
        first = members.select("cid", "first.rid", "first.hash")
        signed = _merge(first, self.rows.select("rid", "hash", "sig"), ["rid", "hash"])
        self.signatures = handed_over(signed.select("cid", "sig").dropDuplicates(["cid"]))
        held = _merge(first, self.texts, ["rid", "hash"])
        self.sets = handed_over(held.select("cid", "text").dropDuplicates(["cid"]))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs ``a, b`` of classes; ``a`` is the one with more partners."""
        sig = self.signatures
        likely = handed_over(
            _merge(
                _merge(pairs, sig.select(F.col("cid").alias("a"), F.col("sig").alias("x")), "a"),
                sig.select(F.col("cid").alias("b"), F.col("sig").alias("y")),
                "b",
            )
            .select("a", "b", "x", "y")
            .mapInArrow(_likely(self.bounds), "a long, b long")
        )
        parts = F.ceil(F.count("*") / F.lit(PARTNERS)).alias("parts")
        hubs = handed_over(likely.groupBy("a").agg(parts))
        part = F.pmod(F.xxhash64("b"), F.col("parts"))
        members = likely.join(hubs, "a").select("a", "b", part.alias("part"))
        heads = hubs.select(
            "a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        texts = self.sets.select(F.col("cid").alias("b"), "text")
        rows = _merge(members.unionByName(heads), texts, "b").select("a", "b", "text", "part")
        dealt = rows.repartition(partitions(self.spark), "a", "part").sortWithinPartitions(
            "a", "part", F.col("a") != F.col("b")
        )
        return handed_over(
            dealt.select("a", "b", "text").mapInArrow(
                _confirmed(self.words, self.threshold), "a long, b long"
            )
        )

    def link(self) -> DataFrame:
        """``cid, label``: smallest class of the component, for classes in shared buckets."""
        buckets = self.buckets()
        members = handed_over(buckets.select("cid").distinct().join(self.classes, "cid"))
        labels = members.select("cid", F.col("cid").alias("label"))
        if not members.limit(1).count():
            return labels
        self.gather(members)
        tested = self.spark.createDataFrame([], "a long, b long")
        for turn in range(ROUNDS):
            pairs = handed_over(self.best_pairs(buckets, labels, tested, turn))
            if not pairs.limit(1).count():
                break
            tested = tested.unionByName(pairs)
            labels = merged(labels, self.verify(pairs))
        return merged(labels, self.compared(buckets, labels, tested))

    def marked(self) -> DataFrame:
        """``rid, hash, uid, n, cid`` of every row, with the ``first`` row of its component.

        ``first`` is null for rows without words.
        """
        labelled = handed_over(
            self.classes.join(self.link(), "cid", "left").select(
                "cid", "first", F.coalesce("label", "cid").alias("label")
            )
        )
        firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
        best = handed_over(labelled.select("cid", "label").join(firsts, "label").select("cid", "first"))
        return self.rows.select("rid", "hash", "uid", "n", "cid").join(best, "cid", "left")

    def best_pairs(self, buckets, labels, tested, turn) -> DataFrame:
        """For each class the pivot of another component that most of its buckets name."""
        drawn = F.pmod(F.xxhash64("cid", "bucket", F.lit(turn)), F.lit(1 << 20)) + 1
        score = F.col("degree") if turn == 0 else F.col("degree") * drawn
        open_rows = buckets.join(labels, "cid")
        pivots = handed_over(
            open_rows.groupBy("bucket")
            .agg(
                F.max_by(F.struct("cid", "label"), F.struct(score, "cid")).alias("p"),
                F.min("label").alias("low"),
                F.max("label").alias("high"),
            )
            .where("low <> high")
            .select("bucket", F.col("p.cid").alias("a"), F.col("p.label").alias("pivot_label"))
        )
        met = open_rows.join(pivots, "bucket").where("label <> pivot_label")
        counted = met.groupBy(F.col("cid").alias("b"), "a").count()
        both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = counted.join(both, ["a", "b"], "left_anti")
        return counted.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")

    def compared(self, buckets, labels, tested) -> DataFrame:
        """Links between components that still share a bucket, by full comparison in blocks."""
        named = buckets.join(labels, "cid").select("bucket", "cid", "label")
        both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        spans = (
            named.groupBy("bucket")
            .agg(
                F.min("label").alias("low"),
                F.max("label").alias("high"),
                F.min("cid").alias("a"),
                F.max("cid").alias("b"),
                F.count("*").alias("n"),
            )
            .where("low <> high")
        )
        # A bucket of two classes that were compared is done.
        left = spans.join(both.select("a", "b", F.lit(True).alias("known")), ["a", "b"], "left")
        left = handed_over(left.where("n > 2 or known is null").select("bucket", "low").distinct())
        open_rows = handed_over(named.join(left, "bucket").select("cid", "label", "low").distinct())
        nodes = open_rows.select(F.col("label").alias("cid"), "label").distinct()
        edges = open_rows.where("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b"))
        clusters = merged(nodes, edges.distinct()).select(
            F.col("cid").alias("label"), F.col("label").alias("cluster")
        )
        inside = handed_over(
            open_rows.select("cid", "label")
            .distinct()
            .join(clusters, "label")
            .join(self.classes.select("cid", "n"), "cid")
        )
        parts = inside.groupBy("cluster", "label").agg(F.sum("n").alias("n"))
        weights = parts.groupBy("cluster").agg(
            F.sum("n").alias("all_n"), F.max(F.struct("n", "label")).alias("top")
        )
        blocks = weights.select(
            "cluster",
            F.col("top.label").alias("top"),
            F.ceil(F.col("all_n") / BLOCK_SHINGLES).alias("bases"),
            F.ceil((F.col("all_n") - F.col("top.n")) / BLOCK_SHINGLES).alias("others"),
        )
        texts = self.sets.select("cid", "text")
        dealt = _merge(inside.join(handed_over(blocks), "cluster"), texts, "cid")
        rest = F.col("label") != F.col("top")

        own_base = F.pmod(F.xxhash64("cid"), F.col("bases"))
        own_other = F.pmod(F.xxhash64("cid", F.lit("other")), F.col("others"))
        base_units = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("others") - 1),
            lambda j: F.struct(own_base.alias("i"), j.alias("j"), F.lit(False).alias("late")),
        )
        late_units = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("bases") - 1),
            lambda i: F.struct(i.alias("i"), own_other.alias("j"), F.lit(True).alias("late")),
        )
        none = F.slice(base_units, 1, 0)
        spread = dealt.withColumn(
            "u", F.explode(F.concat(base_units, F.when(rest, late_units).otherwise(none)))
        )
        rows = spread.select(
            "cluster", F.concat_ws(":", "u.i", "u.j").alias("unit"), "u.late", "cid", "label", "text"
        )
        ordered = rows.repartition(partitions(self.spark), "cluster", "unit").sortWithinPartitions(
            "cluster", "unit", "late"
        )
        return handed_over(
            ordered.mapInArrow(_compared(self.words, self.threshold), "a long, b long")
        )


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after linking: the smallest label of each component.

    Every round a class takes the smallest label of its neighbours, then that of the class which
    has its label: the number of rounds grows with the logarithm of a component's width.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = handed_over(both.distinct())
    labels = handed_over(labels)
    while True:
        seen = (
            edges.join(labels.select(F.col("cid").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(seen.withColumnRenamed("a", "cid"), "cid", "left").select(
            "cid", "label", F.least("label", F.coalesce("near", "label")).alias("new")
        )
        # A label stands for all that carry it, so a better one reaches them all at once.
        better = stepped.groupBy("label").agg(F.min("new").alias("best"))
        after = handed_over(
            stepped.join(better, "label").select("cid", "best", (F.col("best") < F.col("label")).alias("moved"))
        )
        labels = after.select("cid", F.col("best").alias("label"))
        if not after.where("moved").limit(1).count():
            return labels


def near_copies(
    docs: DataFrame, *, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    found = _Linker(docs, words, threshold).marked()
    component = F.coalesce("first.rid", "rid")
    nameless = (component == NO_ID) & F.col("first").isNotNull()
    return found.select(
        F.nullif("rid", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        F.when(nameless, F.col("uid") == F.col("first.uid")).otherwise(F.col("rid") == component).alias("kept"),
    )


def without_copies(
    docs: DataFrame, *, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """One row of each group: of the smallest id, then of the smallest hash of its text.

    Rows without words stay, those that also agree in an id and text once.
    """
    rid, digest, nth, alone = fresh(docs, "rid", "hash", "nth", "alone")
    key = [c.alias(name) for c, name in zip(_row_key(), (rid, digest), strict=True)]
    marked = _Linker(docs, words, threshold).marked()
    other = (F.col("rid") != F.col("first.rid")) | (F.col("hash") != F.col("first.hash"))
    gone = marked.where(other).select(F.col("rid").alias(rid), F.col("hash").alias(digest)).distinct()
    # Rows that nothing can repeat get a number of their own, so that they do not meet in one task.
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    free = F.when(F.col("doc_id").isNull() & wordless, F.monotonically_increasing_id())
    left = docs.select("*", *key, free.alias(alone)).join(gone, [rid, digest], "left_anti")
    rest = [c for c, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy(rid, digest, alone).orderBy(F.xxhash64(*rest))
    return left.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
