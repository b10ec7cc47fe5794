"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a new one of its own in local mode.

    A session on a cluster has to name a folder that all executors see.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="handover-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def handed_over(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back.

    Cuts lineage: a lost executor costs the tasks that ran on it, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, unless the session has its own bound."""
    if int(spark.conf.get(BATCH_BYTES_CONF, str(2**31 - 1))) == 2**31 - 1:
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))


_CACHES: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """Registers a cache of a worker process, which its tasks share."""
    _CACHES.append(cache)
    return cache


def keep_only(*used: dict) -> None:
    """Empties the caches that other operators left in this worker process."""
    for cache in _CACHES:
        if not any(cache is u for u in used):
            cache.clear()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of ``df``, case aside."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def cut_at(value: Column, bounds: list) -> Column:
    """Number of sorted ``bounds`` that are at most ``value``; -1 for null.

    Two levels, so that a row compares with about twice the square root of their number.
    """
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.lit([b[0] for b in blocks])
    at = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.element_at(F.array(*(F.lit(b) for b in blocks)), F.greatest(at, F.lit(1)))
    within = F.size(F.filter(inner, lambda b: b <= value))
    return (
        F.when(value.isNull(), -1).when(at == 0, 0).otherwise((at - 1) * width + within).cast("int")
    )


def quantile_points(df: DataFrame, column: str, pieces: int) -> list:
    """``pieces - 1`` sorted cut points of a numeric column (none of an empty one).

    A value that fills several pieces comes several times.
    """
    if pieces < 2:
        return []
    points = df.approxQuantile(column, [i / pieces for i in range(1, pieces)], 0.2 / pieces)
    return sorted(int(p) for p in points)


def quantile_bounds(df: DataFrame, column: str, pieces: int) -> list:
    """At most ``pieces - 1`` distinct cut points of a numeric column."""
    return sorted(set(quantile_points(df, column, pieces)))
