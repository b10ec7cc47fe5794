"""Exact ordered computations that never sort everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
RANGE_ROWS = 500_000  # rows of a range of running totals, about
SAMPLES = 64  # sampled keys for a range, about
SALTS = 64  # slices of a group whose size is not known


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    *,
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add `cum_<v>`: inclusive totals along a numeric column without repeats.

    Rows are cut into value ranges at approximate quantiles, as many as the rows
    need unless `ranges` says so. Range totals give every range its starting
    offset (one row per range), and running sums stay inside a range. Only the
    balance of the ranges is approximate.
    """
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    if ranges is None:
        ranges = 8 + keyed.count() // RANGE_ROWS
    cuts = keyed.approxQuantile("_order", [i / ranges for i in range(1, ranges)], 0.001)
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_order", outputCol="_range").transform(keyed)
    direction = F.desc if descending else F.asc
    before = Window.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(
            "_range",
            *[
                F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_base_{v}")
                for v in values
            ],
        )
    )
    inside = (
        Window.partitionBy("_range")
        .orderBy(direction("_order"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = ranged.join(F.broadcast(offsets), "_range")
    return joined.select(
        *df.columns,
        *[(F.col(f"_base_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values],
    )


def key_bounds(df: DataFrame, keys: Sequence[str], rows: int = RANGE_ROWS) -> list[Row]:
    """Cut points of composite keys, ascending, for ranges of about `rows` rows.

    The keys of some `SAMPLES` rows per range, chosen by a hash of the keys, are sorted on the
    driver, so the same rows have the same cut points. Only the balance depends on the choice.
    """
    chosen = F.pmod(F.xxhash64(*keys), F.lit(max(1, rows // SAMPLES))) == 0
    # One pass takes the sample and counts all rows: those not chosen meet without a key.
    met = df.groupBy(F.when(chosen, F.struct(*keys)).alias("_key")).agg(F.count("*").alias("_n"))
    sample = met.orderBy("_key").collect()
    ranges = 1 + sum(r["_n"] for r in sample) // rows
    if ranges == 1:
        return []
    held = [tuple(r["_key"]) for r in sample if r["_key"] is not None for _ in range(min(r["_n"], SAMPLES))]
    points = dict.fromkeys(held[len(held) * i // ranges] for i in range(1, ranges)) if held else {}
    kind = df.select(*keys).schema
    return [Row(*kind.names)(*point) for point in points]


def range_of(keys: Sequence[str], bounds: list[Row]) -> Column:
    """Number of cut points that are at most a row's keys; null keys are the smallest.

    Two levels, so that a row is compared with about twice the square root of their number.
    """
    if not bounds:
        return F.lit(0)

    def literal(points: list[Row]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, p, strict=True)]) for p in points])

    key = F.struct(*keys)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at = F.size(F.filter(literal([b[0] for b in blocks]), lambda b: b <= key))
    inner = F.element_at(F.array(*map(literal, blocks)), F.greatest(at, F.lit(1)))
    within = F.size(F.filter(inner, lambda b: b <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * width + within).cast("int")


def placed(
    df: DataFrame, keys: Sequence[str], name: str = "place", rows: int = RANGE_ROWS
) -> DataFrame:
    """Every row with its place, from 1, in the ascending order of `keys`, which tell rows apart.

    Rows move once, to the range of their keys, and are numbered inside it; how many come before
    a range is one row per range.
    """
    ranged = df.withColumn("_range", range_of(keys, key_bounds(df, keys, rows)))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).drop(
        "_range", "_inside", "_before"
    )


def continuous_quantiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles of the non-NULL values.

    Values are first reduced to distinct values with counts, then ranked by
    running totals, so the work is spread whatever the value distribution is.
    The distinct values are cached: their number, the ranges and the ranking
    come from one pass over the rows.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count("*").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    ranked = running_totals(counts, value, ["n"])
    total = counts.agg(F.sum("n").alias("total")).scalar()

    def value_at(position: Column) -> Column:
        """Smallest value whose running count passes a zero-based position."""
        return F.min(F.when(F.col("cum_n") > position, F.col(value).cast("double")))

    picks: list[Column] = []
    for name, fraction in fractions.items():
        exact = (total - 1).cast("double") * F.lit(float(fraction))
        low, high = value_at(F.floor(exact)), value_at(F.ceil(exact))
        picks.append((low + (high - low) * F.max(exact - F.floor(exact))).alias(name))
    return ranked.agg(*picks)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    rank: str = "rn",
    *,
    slices: int | Column = SALTS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """First `k` rows of each group, numbered from 1 in `rank`.

    A small fixed `k` relies on the optimizer's group limit before the shuffle.
    A larger or per-group `k` first takes `k` rows from each slice of a group,
    so a hot group is sorted by many tasks and the last one sees `slices * k`
    rows. `spread` names the columns that tell rows apart.
    """
    candidates = df
    if not isinstance(k, int) or k > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        # Content and input partition: a retried task rebuilds the same slices,
        # and equal rows still spread.
        content = F.xxhash64(*[F.col(c) for c in spread or df.columns])
        count = slices if isinstance(slices, Column) else F.lit(slices)
        slice_of = F.pmod(content + F.spark_partition_id(), count)
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        candidates = (
            df.withColumn("_slice", slice_of)
            .withColumn("_slice_rn", F.row_number().over(sliced))
            .where(F.col("_slice_rn") <= k)
            .drop("_slice", "_slice_rn")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)
