from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casequeue.llm.centroids import MOST, Centroids, cluster, clustered_vectors


def brute(vectors, clusters, rounds, salt="2:"):
    """Rows as the operator returns them, from plain integers."""
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors]
    named = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in whole)
    centers = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        members = [[] for _ in centers]
        for _, v in whole:
            members[nearest(v)[1]].append(v)
        centers = [
            [sum(col) // len(m) for col in zip(*m, strict=True)] if m else c
            for m, c in zip(members, centers, strict=True)
        ]
    found = [(i, *nearest(v)) for i, v in whole]
    inertia = [sum(d for _, d, n in found if n == c) for c in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    cut = lambda x: x if x <= MOST else None
    total = sum(inertia)
    unknown = [any(d > MOST for _, d, n in found if n == c) for c in range(len(centers))]
    return sorted(
        (i, n, cut(d), None if unknown[n] else cut(inertia[n]), None if any(unknown) else cut(total), digest[n])
        for i, d, n in found
    )


def run(spark, rows, clusters, rounds, length):
    table = spark.createDataFrame(rows, "ID long, id_ string, vec array<double>, cluster string").repartition(3)
    vectors = clustered_vectors(table, F.col("vec"), F.col("ID"), length)
    return sorted(tuple(r) for r in cluster(vectors, clusters, rounds).collect())


def random_rows(seed, n, length, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.choice((r.gauss(0, scale), r.randrange(-2, 3) / 4)) for _ in range(length)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "length", "clusters"), [(1, 300, 8, 12), (2, 60, 1, 7), (3, 5, 4, 40)])
def test_equals_brute_force(spark, seed, n, length, clusters):
    rows = random_rows(seed, n, length)
    got = run(spark, [(i, None, v, "x") for i, v in rows], clusters, 3, length)
    assert got == brute(rows, clusters, 3)


def test_rows_that_take_no_part_repeats_and_huge_values(spark):
    rows = random_rows(4, 40, 3) + [(100, [1e30, -4e15, 7.0]), (101, [-1e300, 0.0, 1.0]), (102, [70000.0, 1.0, -1.0])]
    out = [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [float("nan")] * 3), (204, [float("inf"), 1.0, 1.0]), (205, [1e308, 1.0, 1.0])]
    got = run(spark, [(i, None, v, "x") for i, v in rows + out], 6, 2, 3)
    assert got == brute(rows, 6, 2)
    twice = run(spark, [(i, None, v, "x") for i, v in [*rows[:20], *rows[:20]]], 4, 2, 3)
    assert twice == brute([*rows[:20], *rows[:20]], 4, 2)


def test_null_ids_and_empty_table(spark):
    rows = [(None, None, [float(i), 1.0], "x") for i in range(5)]
    table = spark.createDataFrame(rows, "id long, id_ string, v array<double>, cluster string")
    vectors = clustered_vectors(table, F.col("v"), F.col("id"), 2)
    got = cluster(vectors, 2, 1).collect()
    assert len(got) == 5 and {r.id for r in got} == {None}
    assert cluster(vectors.limit(0), 2, 1).collect() == []


def test_search_equals_all_distances_with_ties():
    r = np.random.default_rng(5)
    for length in (1, 4, 64):
        rows = r.integers(-3, 4, (40, length)).tolist()
        rows[7] = rows[3]
        values = r.integers(-4, 5, (500, length))
        number, best = Centroids(rows).nearest(values)
        apart = ((values[:, None, :] - np.array(rows)[None]) ** 2).sum(axis=2)
        assert (best == apart.min(axis=1)).all() and (number == apart.argmin(axis=1)).all()
        for v, n, d in zip(values[:50].tolist(), number, best, strict=False):
            assert Centroids(rows).nearest_wide(v) == (n, d)


def test_search_rejects_most_centroids():
    r = np.random.default_rng(6)
    rows = (r.normal(0, 1, (40, 16)) + np.arange(40)[:, None] * 8).round().astype(int).tolist()
    centroids = Centroids(rows)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                looked.append(len(key))
            return super().__getitem__(key)

    centroids.sorted_rows = centroids.sorted_rows.view(Counted)
    values = np.repeat(np.array(rows), 10, axis=0)
    centroids.nearest(values)
    assert sum(looked) < 3 * len(values)
