"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into shards of about ``SHARD`` vectors. A shard holds, for each dimension, its
vectors in the order of that component. A query reads the lists in step, each from the end that
favours the sign of its own component, scores every vector it meets in full, and stops when the sum
of what the lists still offer, the bound of all unseen vectors, is below its kth score. Blocks of
queries visit every shard; the best k of all shards are the result.

Shards and blocks are packed rows of bounded size, so a task holds one of each. Ties go to the
smaller candidate id. Vectors that are null, empty, or hold null or non-finite components take no
part; vectors of different lengths are never compared; a query is not compared with candidates of its
own id. Rows with null ids take no part. Repeated rows are candidates and queries each: a query is
searched once and its result given as often as its row comes, and of a candidate's equal rows no more
than k are dealt, as more never rank. Products are exact whatever their size; a score beyond a long
ranks by its true value and is null. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import handed_over

SHARD = 8_192
BLOCK = 512
FIRST_DEPTH = 8
EXACT = float(1 << 53)
LONG = float(1 << 62)
_PACKED = "dim int, piece int, ids binary, times binary, vectors binary"
_FOUND = "dim int, piece int, at int, times long, query_id long, vec_id long, score long, side int, digits string"


def quantized(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component as a double; null for vectors that take no part.

    So does a vector with a component that leaves the range of doubles when scaled.
    """
    scaled = F.transform(vector, lambda x: F.lit(scale) * x.cast("double"))
    good = F.forall(
        scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    # Doubles from 2^53 on are whole numbers.
    whole = F.transform(
        scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    )
    return F.when(good & (F.size(vector) > 0), whole)


def _pack(vectors: DataFrame, pieces: Column) -> DataFrame:
    """Vectors ``id, times, v`` of equal length in packed rows, ``pieces`` of them.

    Rows are dealt by id and vector, so that rows of one id spread.
    """
    schema = pa.schema(
        [("dim", pa.int32()), ("piece", pa.int32()), ("ids", pa.binary()), ("times", pa.binary()), ("vectors", pa.binary())]
    )

    def pack(key, table):
        dim, piece = key[0].as_py(), key[1].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
        ids, times = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "times"))
        order = np.argsort(ids, kind="stable")
        packed = (ids[order], times[order], values.reshape(-1, dim)[order])
        return pa.Table.from_arrays([pa.array([x]) for x in (dim, piece, *(p.tobytes() for p in packed))], names=schema.names).cast(schema)

    piece = F.pmod(F.xxhash64("id", "v", "nth"), pieces).cast("int")
    rows = vectors.select(F.size("v").alias("dim"), piece.alias("piece"), "id", "times", "v")
    return rows.groupBy("dim", "piece").applyInArrow(pack, _PACKED)


def _listed(batches):
    """Adds the sorted lists of a shard: vectors by each component, smallest first."""
    for batch in batches:
        lists = []
        for dim, vectors in zip(batch.column("dim").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
            values = np.frombuffer(vectors, np.float64).reshape(-1, dim)
            lists.append(np.argsort(values, axis=0, kind="stable").T.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.binary())], names=[*batch.schema.names, "lists"])


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as unbounded integers."""
    out = np.empty(x.shape, object)
    out.flat = [int(c) for c in x.flat]
    return out


def threshold_search(
    query: np.ndarray, own: np.ndarray, values: np.ndarray, lists: np.ndarray, k: int
) -> tuple[np.ndarray, list[int]]:
    """Rows and scores of the k best of ``values`` for a query; ``own`` marks rows left out.

    Vectors are doubles without fractions. Products are summed as doubles or longs where no sum can
    leave what these hold exactly, else as unbounded integers.
    """
    n, dim = values.shape
    with np.errstate(over="ignore"):
        top = np.abs(values).max(initial=0) * np.abs(query).max(initial=0) * dim
    kind = (lambda x: x) if top < EXACT else (lambda x: x.astype(np.int64)) if top < LONG else _whole
    weights = kind(query)
    at = np.flatnonzero(query)
    ordered = np.where(query[at, None] > 0, lists[at, ::-1], lists[at])
    seen = np.zeros(n, bool)
    best: list[tuple[int, int]] = []  # smallest first: score negated, row
    start, depth = 0, FIRST_DEPTH
    while True:
        depth = min(depth, n)
        met = np.zeros(n, bool)
        met[ordered[:, start:depth].ravel()] = True
        if depth == n or not len(at):
            met[:] = True
        new = np.flatnonzero(met & ~seen & ~own)
        seen |= met
        scores = kind(values[new]) @ weights
        if len(new) > 4 * k and scores.dtype != object:
            edge = np.partition(scores, -k)[-k]
            new, scores = new[scores >= edge], scores[scores >= edge]
        best = sorted([*best, *((-int(s), int(i)) for s, i in zip(scores, new, strict=True))])[:k]
        if seen.all():
            break
        bound = (kind(values[ordered[:, depth - 1], at]) * weights[at]).sum()
        if len(best) == k and -best[-1][0] > bound:
            break
        start, depth = depth, 4 * depth
    return np.array([i for _, i in best], np.int64), [-s for s, _ in best]


def _ranked(score: int) -> tuple[int | None, int, str]:
    """A score as a long, or as a side and digits in the same order where it is beyond one."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, ""
    digits = str(abs(score))
    digits = f"{len(digits):04d}{digits}"
    if score > 0:
        return None, 1, digits
    return None, -1, digits.translate(str.maketrans("0123456789", "9876543210"))


def _searched(k: int):
    schema = pa.schema(
        [("dim", pa.int32()), ("piece", pa.int32()), ("at", pa.int32()), ("times", pa.int64())]
        + [(c, pa.int64()) for c in ("query_id", "vec_id", "score")]
        + [("side", pa.int32()), ("digits", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids = np.frombuffer(row["ids"], np.int64)
                values = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                lists = np.frombuffer(row["lists"], np.int32).reshape(dim, -1)
                queries = np.frombuffer(row["query_vectors"], np.float64).reshape(-1, dim)
                names = (np.frombuffer(row[c], np.int64).tolist() for c in ("query_ids", "query_times"))
                out = []
                for place, (query_id, times, query) in enumerate(zip(*names, queries, strict=True)):
                    at, scores = threshold_search(query, ids == query_id, values, lists, k)
                    own = (dim, row["block"], place, times, query_id)
                    out += [(*own, int(ids[i]), *_ranked(s)) for i, s in zip(at, scores, strict=True)]
                if out:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs have ``id`` and ``v`` as ``quantized`` makes it."""
    whole = "id is not null and v is not null"
    counted = [x.where(whole).groupBy("id", "v").agg(F.count("*").alias("n")) for x in (queries, candidates)]
    asked = handed_over(counted[0].select("id", "v", F.lit(0).alias("nth"), F.col("n").alias("times")))
    copies = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))
    dealt = handed_over(
        counted[1].select("id", "v", F.explode(copies).alias("nth"), F.lit(1).cast("long").alias("times"))
    )
    shards = max(1, -(-dealt.count() // SHARD))
    blocks = max(1, -(-asked.count() // BLOCK))
    indexed = handed_over(_pack(dealt, F.lit(shards)).mapInArrow(_listed, f"{_PACKED}, lists binary"))
    packed = handed_over(_pack(asked, F.lit(blocks)))
    visits = packed.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("piece"),
        F.col("piece").alias("block"),
        F.col("ids").alias("query_ids"),
        F.col("times").alias("query_times"),
        F.col("vectors").alias("query_vectors"),
    )
    found = indexed.drop("times").join(visits, ["dim", "piece"]).mapInArrow(_searched(k), _FOUND)
    order = Window.partitionBy("dim", "piece", "at").orderBy(
        F.desc("side"), F.desc("score"), F.desc("digits"), "vec_id"
    )
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, times)")).alias("nth")
    ).drop("nth")
