"""Centroid clustering by equal-average equal-variance search, in whole numbers.

Vectors become integers, and so do centroids, so every run gives the same clusters. Centroids are sorted by
the mean of their components. A vector starts at the centroid whose mean is next to its own and goes outward
in both directions. With k components, sums S and squared deviations D of the components from
their mean, a squared distance is at least (S - S')**2 / k, and at least that plus (sqrt(D) - sqrt(D'))**2. Where the first
bound exceeds the best distance so far, all centroids further out are rejected with it; where the second does, this
one is. The others are finished exactly, in integers. A bound that equals the best distance does not
reject, as the smaller number wins ties.

Vectors are searched a batch at a time, in step: each takes its next centroid outward until all are done. A task
returns one row of sums for each cluster it met, and those are added in two steps, so nothing
but the centroids (their number times their length) reaches the driver.

Vectors of another length, null ones and those that hold null or non-finite components are left out, as are
those whose scaled components are not finite. Values beyond ``NARROW`` are computed with unbounded integers, one vector
at a time; a distance or an inertia beyond a long is null. Repeated rows each take part; first
centroids with equal hashes are taken in the order of their components, null ids as the text ``null``. Fewer vectors
than centroids give fewer clusters, none gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.llm.common import bound_batches, handed_over

SCALE = 256.0
CLUSTERS, ROUNDS, LENGTH = 40, 5, 64
NARROW = 1 << 24  # magnitudes below it keep all products of a vector within 64 bits
LONGEST_VECTOR = 1 << 7  # components for which they do
ROWS = 8_192  # vectors searched in step
ROUNDING = 1e-9  # share by which a bound with roots is lowered, against rounding
MOST = (1 << 63) - 1
GATHERED = 64  # groups of tasks whose sums are added first


def clustered_vectors(vectors: DataFrame, column: Column, vec_id: Column, length: int = LENGTH) -> DataFrame:
    """``id`` and ``v``, doubles, of the vectors that take part."""
    v = F.transform(column, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(SCALE)) < float("inf")))
    return vectors.select(vec_id.alias("id"), v.alias("v")).where((F.size("v") == length) & good)


def _whole(column: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) as doubles, a row for each vector."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


class Centroids:
    """Centroids in the order of their means, with their sums and deviations."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        k = self.length = len(rows[0])
        stats = []
        for number, row in enumerate(rows):
            s, q = sum(row), sum(x * x for x in row)
            stats.append((s, number, k * q - s * s))
        stats.sort()
        self.sums = [s for s, _, _ in stats]
        self.numbers = [n for _, n, _ in stats]
        self.spreads = [d for _, _, d in stats]  # k times the squared deviations
        self.narrow = all(abs(x) < NARROW for row in rows for x in row) and k <= LONGEST_VECTOR
        if self.narrow:
            self.sorted_rows = np.array([rows[n] for n in self.numbers], np.int64)
            self.sum_array = np.array(self.sums, np.int64)
            self.number_array = np.array(self.numbers, np.int64)
            self.root_array = np.sqrt(np.array(self.spreads, np.float64))

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of the nearest centroids of narrow integer vectors."""
        n, k = values.shape
        sums = values.sum(axis=1)
        roots = np.sqrt((k * (values * values).sum(axis=1) - sums * sums).astype(np.float64))
        best = np.full(n, MOST, np.int64)
        number = np.full(n, len(self.rows), np.int64)
        right = np.searchsorted(self.sum_array, sums)  # next centroid to each side
        left = right - 1
        active = np.arange(n)
        last = len(self.rows)
        while len(active):
            lo, hi, s = left[active], right[active], sums[active]
            low_gap = np.where(lo >= 0, s - self.sum_array[np.maximum(lo, 0)], MOST)
            high_gap = np.where(hi < last, self.sum_array[np.minimum(hi, last - 1)] - s, MOST)
            go_low = low_gap <= high_gap
            gap = np.minimum(low_gap, high_gap)
            # The nearer mean decides for all further out.
            on = gap != MOST
            on[on] = gap[on].astype(np.float64) ** 2 * (1 - ROUNDING) <= k * best[active[on]].astype(np.float64)
            active, go_low, gap = active[on], go_low[on], gap[on]
            at = np.where(go_low, lo[on], hi[on])
            left[active] -= go_low
            right[active] += ~go_low
            bound = (gap.astype(np.float64) ** 2 + (roots[active] - self.root_array[at]) ** 2) / k
            close = bound * (1 - ROUNDING) - 1 <= best[active].astype(np.float64)
            rows, at = active[close], at[close]
            apart = values[rows] - self.sorted_rows[at]
            distance = (apart * apart).sum(axis=1)
            found = self.number_array[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < number[rows]))
            best[rows[better]] = distance[better]
            number[rows[better]] = found[better]
        return number, best

    def nearest_wide(self, vector: list[int]) -> tuple[int, int]:
        """The same for one vector of any size."""
        k = self.length
        total = sum(vector)
        root = isqrt(k * sum(x * x for x in vector) - total * total)
        best: tuple[int, int] | None = None
        order = sorted(range(len(self.rows)), key=lambda i: abs(self.sums[i] - total))
        for i in order:
            gap = (self.sums[i] - total) ** 2
            if best and gap > k * best[0]:
                break
            between = max(0, abs(root - isqrt(self.spreads[i])) - 1)  # roots are cut to integers
            if best and gap + between**2 > k * best[0]:
                continue
            row = self.rows[self.numbers[i]]
            distance = sum((x - y) ** 2 for x, y in zip(vector, row, strict=True))
            best = min(best or (distance, self.numbers[i]), (distance, self.numbers[i]))
        return best[1], best[0]

    def search(self, whole: np.ndarray):
        """Pieces of whole-number doubles with their clusters and distances; wide values as lists."""
        wide = np.abs(whole).max(axis=1, initial=0) >= NARROW if self.narrow else np.ones(len(whole), bool)
        narrow = np.flatnonzero(~wide)
        for start in range(0, len(narrow), ROWS):
            rows = narrow[start : start + ROWS]
            values = whole[rows].astype(np.int64)
            yield rows, values, *self.nearest(values)
        for row in np.flatnonzero(wide):
            vector = [int(x) for x in whole[row]]
            number, distance = self.nearest_wide(vector)
            yield [row], [vector], [number], [distance]


def _first_centroids(vectors: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    name = F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return [[int(x) for x in np.floor(SCALE * np.array(r.v, np.float64))] for r in first]


_SUMS = "cluster int, batch int, n long, sums array<string>"


def _cluster_sums(vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of their components by cluster."""
    length = centroids.length

    def partial(batches):
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for _, values, numbers, _ in centroids.search(_whole(batch.column(0), length)):
                for number in np.unique(numbers):
                    # Sums of a piece stay within 64 bits; those of a task are Python integers.
                    if isinstance(values, list):
                        rows = [v for v, m in zip(values, numbers, strict=True) if m == number]
                        sums, n = [sum(c) for c in zip(*rows, strict=True)], len(rows)
                    else:
                        rows = values[numbers == number]
                        sums, n = rows.sum(axis=0).tolist(), len(rows)
                    number = int(number)
                    count[number] = count.get(number, 0) + n
                    before = total.get(number)
                    total[number] = sums if before is None else [x + y for x, y in zip(before, sums, strict=True)]
        if count:
            texts = [[str(x) for x in total[number]] for number in count]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array(texts, pa.list_(pa.string()))],
                names=["cluster", "n", "sums"],
            )

    def add(key, table):
        total = [0] * length
        for sums in table.column("sums"):
            total = [x + int(y) for x, y in zip(total, sums.as_py(), strict=True)]
        return pa.table(
            {"cluster": pa.array([key[0].as_py()], pa.int32()), "batch": pa.array([0], pa.int32()),
             "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([[str(x) for x in total]], pa.list_(pa.string()))}
        )

    of_tasks = vectors.select("v").mapInArrow(partial, "cluster int, n long, sums array<string>")
    named = of_tasks.select("cluster", (F.spark_partition_id() % GATHERED).alias("batch"), "n", "sums")
    gathered = named.groupBy("cluster", "batch").applyInArrow(add, _SUMS)
    whole = gathered.groupBy("cluster").applyInArrow(add, _SUMS)
    return {r.cluster: (r.n, [int(x) for x in r.sums]) for r in whole.collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2:") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for ``id`` and ``v``.

    ``v`` holds doubles, as many in each row. ``salt`` comes before an id whose hash chooses first centroids.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = _first_centroids(vectors, clusters, salt)
    if not rows:
        rows = [[0]]
    for _ in range(rounds):
        for number, (n, sums) in _cluster_sums(vectors, Centroids(rows)).items():
            rows[number] = [x // n for x in sums]
    centroids = Centroids(rows)

    def assign(batches):
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int32)
            distance = np.zeros(batch.num_rows, np.int64)
            beyond = np.zeros(batch.num_rows, bool)
            for at, _, numbers, found in centroids.search(_whole(batch.column(1), centroids.length)):
                number[at] = numbers
                beyond[at] = [d > MOST for d in found] if isinstance(found, list) else False
                distance[at] = [min(d, MOST) for d in found] if isinstance(found, list) else found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64(), mask=beyond)],
                names=["id", "cluster", "distance"],
            )

    id_type = vectors.schema["id"].dataType.simpleString()
    assigned = handed_over(vectors.select("id", "v").mapInArrow(assign, f"id {id_type}, cluster int, distance long"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    known = F.count("distance") == F.count("*")
    inertia = assigned.groupBy("cluster").agg(F.when(known, exact).alias("inertia")).collect()
    of_cluster = {r.cluster: None if r.inertia is None else int(r.inertia) for r in inertia}
    total = None if None in of_cluster.values() else sum(of_cluster.values())
    long = lambda x: None if x is None or x > MOST else x
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    named = spark.createDataFrame(
        [(n, long(of_cluster.get(n)), long(total), digest) for n, digest in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(named), "cluster").select(  # a row for each cluster
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
