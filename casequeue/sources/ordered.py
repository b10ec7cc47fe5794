"""Rows stored in ranges of an order, with a directory of counts, so that a page reads its ranges only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequeue.functions.ranges import RANGE_ROWS, key_bounds, range_of

_RANGE = "_range"
_FOLDER = "_range_folder"
_AT = "_range_at"  # place of a row in its range, from 0
_OWN = (_RANGE, _FOLDER, _AT)
FOLDER_RANGES = 64  # ranges of a folder, about


def write_ordered(
    df: DataFrame, path: str, keys: list[str], *, descending: bool = False, rows: int = RANGE_ROWS
) -> None:
    """Write `df` below `path` in ranges of `rows` rows by `keys`, which tell rows apart.

    Rows move once, to the folder of their keys, and are numbered there; a folder holds about
    `FOLDER_RANGES` ranges, so neither tasks nor folders are as many as ranges. Files are sorted, so that
    a range is a few pages of one. The directory, one row per range, is written last: a table without one
    was not finished, and cannot be read. An existing folder is refused. Null keys are the smallest. An
    empty table has no ranges.
    """
    if taken := [c for c in _OWN if c in df.columns]:
        raise ValueError(f"a column cannot be named {taken[0]}")
    spark = df.sparkSession
    bounds = key_bounds(df, keys, rows * FOLDER_RANGES)
    place = range_of(keys, bounds)
    dealt = df.withColumn(_FOLDER, F.lit(len(bounds)) - place if descending else place).repartition(
        len(bounds) + 1, _FOLDER
    )
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    nth = F.row_number().over(Window.partitionBy(_FOLDER).orderBy(*order)) - 1
    ranged = dealt.withColumn(_AT, nth).withColumns(
        {
            _RANGE: F.shiftleft(F.col(_FOLDER).cast("long"), 32) + F.floor(F.col(_AT) / F.lit(rows)),
            _AT: F.col(_AT) % rows,
        }
    )
    ranged.write.partitionBy(_FOLDER).mode("error").parquet(f"{path}/rows")
    schema = ranged.schema
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    sizes = stored.groupBy(_RANGE).agg(F.count("*").alias("rows"))
    key = F.struct(*keys)
    # Only the ends of ranges are compared: two rows of each.
    ends = stored.join(F.broadcast(sizes), _RANGE).where((F.col(_AT) == 0) | (F.col(_AT) == F.col("rows") - 1))
    each = ends.groupBy(_RANGE, _FOLDER, "rows").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    listed = each.select(_RANGE, _FOLDER, "rows", before, "first", "last")  # one row per range
    spark.createDataFrame([], schema).write.mode("error").parquet(f"{path}/columns")
    listed.coalesce(1).write.mode("error").parquet(f"{path}/directory")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """`_range, _range_folder, rows, before, first, last`: the ranges in order, the folder of each, how many
    rows come before it, and its smallest and largest keys."""
    return spark.read.parquet(f"{path}/directory")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns).parquet(f"{path}/rows")


def _in_ranges(rows: DataFrame, held: list) -> DataFrame:
    """Stored rows of the listed ranges; other folders, and pages of other ranges, are not read."""
    folders = sorted({r[_FOLDER] for r in held})
    return rows.where(F.col(_FOLDER).isin(folders) & F.col(_RANGE).isin([r[_RANGE] for r in held]))


def stored_total(spark: SparkSession, path: str) -> int:
    return directory(spark, path).agg(F.sum("rows")).first()[0] or 0


def read_places(
    spark: SparkSession, path: str, order: list[Column], start: int, size: int
) -> DataFrame:
    """Rows at places `start` to before `start + size` (from 0) of the stored order.

    Only the ranges that hold these places are read and sorted: at most `size + 1` of them.
    """
    rows = _stored(spark, path)
    places = directory(spark, path).where(
        (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
    )
    held = sorted(places.collect(), key=lambda r: r["before"])
    if not held or size < 1:
        return rows.drop(*_OWN).limit(0)
    wanted = _in_ranges(rows, held).drop(*_OWN)
    return wanted.orderBy(*order).offset(start - held[0]["before"]).limit(size)


def read_first_keys(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """Rows whose first key is one of `values`; only ranges that can hold one are read."""
    may = F.lit(False)
    for value in values:
        may = may | F.lit(value).between(F.col(f"first.{key}"), F.col(f"last.{key}"))
    held = directory(spark, path).where(may).select(_RANGE, _FOLDER).collect()
    return _in_ranges(_stored(spark, path), held).where(F.col(key).isin(values)).drop(*_OWN)
