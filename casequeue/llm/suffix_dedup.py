"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart through ``depth`` bytes only, in passes of ever longer digits; the groups
that are left equal at full depth are the repeated strings. A pass deals suffixes out by the hash of
their digit. A group of one is finished and leaves; so does a group whose members also agree on the
full depth, all of which but the first are repeated. Only the rest goes to the next pass.

1. The first digit is the anchor of a window (see ``suffix_kernel``), one row for all windows that
   an anchor owns. Members agree if all text around the anchor that these windows cover is equal.
2. Of groups that disagree, the windows of ``CELL`` neighbouring offsets share a digit: the bytes
   common to them all.
3. Of those, single windows: the digit is the whole string.

Tasks first settle repeats within chunks of their own input, so that a string found everywhere
sends one row for each chunk to the sort.

Bytes are those of UTF-8; null texts are empty; strings never cross documents. "Earlier" means a
smaller id, null ids before all others; rows with equal ids are taken in the order of a hash of
their text, identical rows in any order. Hashes have 64 bits for the digit and 64 for the whole, both
of which must agree. An empty table has no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import handed_over, partitions
from casequeue.llm.suffix_kernel import Hashed, Powers, anchors, mix

DEPTH = 100
DIGIT = 24
CELL = 10
BUFFER_BYTES = 1 << 20
CHUNK_ANCHORS = 500_000
NO_ID = -(1 << 63)

# place = anchor | anchor - first window | anchor - last window | settled
ROW_SCHEMA = "digit long, whole long, rid long, nth long, place long"
_NAMES = ["digit", "whole", "rid", "nth", "place"]


def _place(anchor, first, last, settled):
    return anchor << 15 | (anchor - first) << 8 | (anchor - last) << 1 | settled


def _batch(*parts):
    columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in parts]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


class _Buffers:
    """Texts of documents joined to buffers of about ``BUFFER_BYTES``."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, text: str | None, payload) -> bool:
        raw = (text or "").encode()
        self.held.append((raw, payload))
        self.size += len(raw)
        return self.size >= BUFFER_BYTES

    def take(self):
        raw = np.frombuffer(b"".join(r for r, _ in self.held), np.uint8)
        ends = np.cumsum([len(r) for r, _ in self.held], dtype=np.int64)
        starts = ends - np.array([len(r) for r, _ in self.held], np.int64)
        payloads = [p for _, p in self.held]
        self.held, self.size = [], 0
        return raw, starts, ends, payloads


def _first_pass(depth: int, digit: int):
    """Anchors of documents: repeats within a chunk settled, the others with digit and whole."""

    def settle(parts):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        d, w, rid, nth, x, lo, hi = cols
        order = np.lexsort((x, nth, rid))
        d, w, rid, nth, x, lo, hi = (c[order] for c in cols)
        both = mix(d, w)
        by = np.argsort(both, kind="stable")
        again = np.zeros(len(by), bool)
        again[by[1:]] = both[by[1:]] == both[by[:-1]]
        new = ~again
        yield _batch(d[new], w[new], rid[new], nth[new], _place(x[new], lo[new], hi[new], 0))
        at = np.flatnonzero(again)
        if len(at):
            # Neighbouring settled anchors of a document are one run of windows.
            r, n, first, last = rid[at], nth[at], lo[at], hi[at]
            cut = np.flatnonzero(
                (r[1:] != r[:-1]) | (n[1:] != n[:-1]) | (first[1:] != last[:-1] + 1)
            ) + 1
            s, e = np.r_[0, cut], np.r_[cut, len(at)] - 1
            spread = mix(r[s], n[s], first[s])
            yield _batch(spread, last[e].astype(np.uint64), r[s], n[s], _place(first[s], first[s], first[s], 1))

    def run(batches):
        powers, buffers, parts, held = Powers(), _Buffers(), [], 0

        def work():
            raw, starts, ends, ids = buffers.take()
            hashed = Hashed(raw, powers)
            x, lo, hi = anchors(raw, starts, ends, hashed, depth, digit)
            doc = np.searchsorted(ends, x, side="right")
            base = starts[doc]
            rid = np.array([i[0] for i in ids], np.int64)[doc]
            nth = np.array([i[1] for i in ids], np.int64)[doc]
            d = mix(hashed.of(x, x + digit))
            w = mix(hashed.of(lo, hi + depth), x - lo, x - hi)
            parts.append((d, w, rid, nth, x - base, lo - base, hi - base))
            return len(x)

        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            for rid, nth, text in zip(*columns, strict=True):
                if buffers.add(text.as_py(), (rid, nth)):
                    held += work()
                    if held >= CHUNK_ANCHORS:
                        yield from settle(parts)
                        parts, held = [], 0
        if buffers.held:
            work()
        if parts:
            yield from settle(parts)

    return run


def _next_pass(depth: int, cell: int):
    """Digits and wholes of the open windows, ``cell`` neighbouring offsets at a time."""

    def run(batches):
        powers, buffers = Powers(), _Buffers()

        def work():
            raw, starts, _, found = buffers.take()
            hashed = Hashed(raw, powers)
            lists = [np.array(f[2], np.int64).reshape(-1, 3) for f in found]
            doc = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
            x, lo, hi = np.concatenate(lists).T + starts[doc]
            low, high = (x - hi) // cell, (x - lo) // cell
            n = high - low + 1
            at = np.repeat(np.arange(len(x)), n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            x, doc = x[at], doc[at]
            last = x - j * cell
            first = last - cell + 1
            d = mix(hashed.of(last, first + depth), j)
            first, last = np.maximum(first, lo[at]), np.minimum(last, hi[at])
            w = mix(hashed.of(first, last + depth), x - first, x - last)
            rid = np.array([f[0] for f in found], np.int64)[doc]
            nth = np.array([f[1] for f in found], np.int64)[doc]
            base = starts[doc]
            return _batch(d, w, rid, nth, _place(x - base, first - base, last - base, 0))

        for batch in batches:
            ids, nths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (text, open_rows) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if open_rows.is_valid and len(open_rows):
                    triples = np.column_stack(
                        [open_rows.values.field(k).to_numpy() for k in range(3)]
                    )
                    if buffers.add(text.as_py(), (ids[i], nths[i], triples)):
                        yield work()
        if buffers.held:
            yield work()

    return run


def _resolved(rows: DataFrame) -> DataFrame:
    """``rid, nth, anchor, first, last, settled`` of rows that are repeated or still open."""
    group = Window.partitionBy("digit")
    ordered = group.orderBy("whole", "rid", "nth", "place")
    again = F.coalesce(F.lag("whole").over(ordered) == F.col("whole"), F.lit(False))
    seen = rows.select(
        "*",
        again.alias("again"),
        (F.min("whole").over(group) != F.max("whole").over(group)).alias("differ"),
    )
    local = F.col("place").bitwiseAND(1) == 1
    anchor = F.shiftright("place", 15)
    first = anchor - F.shiftright("place", 8).bitwiseAND(127)
    last = anchor - F.shiftright("place", 1).bitwiseAND(127)
    kept = seen.where(local | F.col("again") | F.col("differ"))
    return kept.select(
        "rid",
        "nth",
        anchor.alias("anchor"),
        first.alias("first"),
        F.when(local, F.col("whole")).otherwise(last).alias("last"),
        (local | F.col("again")).alias("settled"),
    )


def _identified(docs: DataFrame) -> DataFrame:
    """``rid, nth, text``: ids without nulls, and numbers in the order of rows of equal id.

    Where ids repeat, rows are sorted in ranges of id, hash and a number of their own, which split an
    id and a text alike, and written with their place in that order.
    """
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid")
    rows = docs.select(rid, "text")
    if rows.groupBy("rid").count().where("count > 1").limit(1).count():
        order = ("rid", "hash", "own")
        own = F.monotonically_increasing_id().alias("own")
        told = rows.select("rid", F.xxhash64("text").alias("hash"), own, "text")
        ranged = told.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
        return handed_over(ranged.select("rid", F.monotonically_increasing_id().alias("nth"), "text"))
    return rows.select("rid", F.lit(0).cast("long").alias("nth"), "text")


def _with_rows(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Texts with the list of their rows; every use has the same exchange of the texts."""
    lists = rows.groupBy("rid", "nth").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return texts.join(lists.hint("shuffle_hash"), ["rid", "nth"], "left").select(
        "rid", "nth", "text", "rows"
    )


def _cut(depth: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            out = []
            for rid, text, runs in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode()
                kept, removed, spans = raw, 0, 0
                if runs.is_valid and len(runs):
                    first, last = (runs.values.field(k).to_numpy() for k in range(2))
                    edges = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, last + depth, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                doc = None if rid == NO_ID else rid
                out.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return run


def remove_repeats(docs: DataFrame, *, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    ``kept`` has the bytes that are left; a cut may fall inside a character.
    """
    if not 1 <= digit <= depth <= digit + 127:
        raise ValueError("the first digit must be at most 127 bytes shorter than the depth")
    texts = _identified(docs)
    first = handed_over(_resolved(texts.mapInArrow(_first_pass(depth, digit), ROW_SCHEMA)))
    opened = ("anchor", "first", "last")
    cells = _with_rows(texts, first.where("not settled"), *opened).mapInArrow(
        _next_pass(depth, CELL), ROW_SCHEMA
    )
    second = _resolved(cells)
    windows = _with_rows(texts, second.where("not settled"), *opened).mapInArrow(
        _next_pass(depth, 1), ROW_SCHEMA
    )
    settled = [r.where("settled").select("rid", "nth", "first", "last") for r in (first, second, _resolved(windows))]
    runs = settled[0].unionByName(settled[1]).unionByName(settled[2])
    return _with_rows(texts, runs, "first", "last").mapInArrow(
        _cut(depth),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
