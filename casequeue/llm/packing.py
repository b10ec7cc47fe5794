"""Packing token sequences by multiway differencing (Karmarkar-Karp).

Documents are encoded, ended by an id, and cut into full windows; what is left of each document is
packed with what is left of others of the same task, ``GROUP`` documents at a time. Each rest starts
as a partial partition of its own; the two partitions with the largest differences merge, the
largest windows of one on the smallest of the other, until one partition of near-equal windows is
left. Windows above capacity give their excess to windows with room (``cut``), or the number of
windows rises until none is above. Fewer than ``capacity`` padding ids are needed for a group.

No rows move between tasks. Null texts are empty documents of the end id alone. Repeated rows and
equal ids are packed one by one; an empty table has no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casequeue.llm.common import keep_only
from casequeue.llm.tokens import encoder_of

CAPACITY = 2048
GROUP = 1024
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


def near_equal(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` windows of near-equal sums, by multiway differencing."""
    if k < 1 or not sizes:
        return [[] for _ in range(max(k, 0))]
    # A partition has its filled windows only, (sum, items) by falling sum; the others are empty.
    turn = count()
    heap = [(-s, next(turn), [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def spread(windows):
        return windows[0][0] - (windows[-1][0] if len(windows) == k else 0)

    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both > 0:  # large windows of one stay alone, its small ones meet small ones of the other
            over = [
                (x[0] + y[0], (x[1], y[1]))
                for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)
            ]
            merged = a[: len(a) - both] + over + b[: len(b) - both]
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        heapq.heappush(heap, (-spread(merged), next(turn), merged))
    windows = [_items(w[1]) for w in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def _items(node) -> list[int]:
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        if len(n) == 1:
            found.append(n[0])
        else:
            stack.extend(n)
    return sorted(found)


def pack(sizes: list[int], capacity: int = CAPACITY, *, cut: bool = True) -> list[list[tuple]]:
    """Windows of pieces ``(index, start, length)``; every size must be at most ``capacity``."""
    if max(sizes, default=0) > capacity:
        raise ValueError("a size is above capacity")
    k = -(-sum(sizes) // capacity)
    windows = near_equal(sizes, k)
    while not cut and any(sum(sizes[i] for i in w) > capacity for w in windows):
        k += 1
        windows = near_equal(sizes, k)
    pieces = [[(i, 0, sizes[i]) for i in w] for w in windows]
    spare = []  # cut from windows above capacity
    for w in pieces:
        excess = sum(p[2] for p in w) - capacity
        while excess > 0:
            at = max(range(len(w)), key=lambda j: w[j][2])
            i, start, length = w[at]
            part = min(excess, length)
            spare.append((i, start + length - part, part))
            w[at : at + 1] = [(i, start, length - part)] if part < length else []
            excess -= part
    for w in pieces:
        room = capacity - sum(p[2] for p in w)
        while room > 0 and spare:
            i, start, length = spare.pop()
            part = min(room, length)
            w.append((i, start, part))
            if part < length:
                spare.append((i, start + part, length - part))
            room -= part
    return [w for w in pieces if w]


def _packed(tokenizer: str, end_id: int, capacity: int, group: int, cut: bool):
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        keep_only()
        encoder = encoder_of(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        sequences = count(TaskContext.get().partitionId() << 33)
        rests, rows = [], []

        def piece(doc, ids, start, length, n, sequence, offset):
            part = ids[start : start + length].astype("<u4")
            rows.append((doc, start, length, zlib.crc32(part.tobytes()), n, sequence, offset))

        def flush():
            for window in pack([n - base for _, _, base, n in rests], capacity, cut=cut):
                sequence, offset = next(sequences), 0
                for i, start, length in window:
                    doc, ids, base, n = rests[i]
                    part = ids[start : start + length].astype("<u4")
                    rows.append((doc, base + start, length, zlib.crc32(part.tobytes()), n, sequence, offset))
                    offset += length
            rests.clear()

        def batch_of():
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encoder.encode(text.as_py() or "") + end, encoder.dtype)
                n, start = len(ids), 0
                while n - start >= capacity:
                    piece(doc, ids, start, capacity, n, next(sequences), 0)
                    start += capacity
                if start < n:
                    rests.append((doc, ids[start:].copy(), start, n))
                if len(rests) == group:
                    flush()
            if rows:
                yield batch_of()
        flush()
        if rows:
            yield batch_of()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 1,
    capacity: int = CAPACITY,
    group: int = GROUP,
    cut: bool = True,
) -> DataFrame:
    """One row per piece: where its ids come from and where they lie in which sequence."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packed(tokenizer, end_id, capacity, group, cut), PIECE_SCHEMA)
