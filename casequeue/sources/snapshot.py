"""Snapshot JSON lines and the typed complaints table.

A snapshot is replaced as a whole. Each write makes a generation: a folder of lines in order, and a list of its
files with their place, first and last key, rows and a digest of their lines. One appended entry then makes the
generation the current one, so a write that fails leaves the snapshot before it as it was. Readers take
the current generation, hold its files against the list and refuse lines that were lost, added or changed.
A folder of plain lines, as others write them, is read as it is.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casequeue.functions.hashing import canonical_json
from casequeue.schemas import COMPLAINTS, SNAPSHOT

MONTH = "received_month"

_STORED = StructType(
    [StructField(f.name, COMPLAINTS[f.name].dataType) for f in SNAPSHOT.fields]
)


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """Canonical JSON text of each row: sorted keys, compact, NULL kept."""
    return snapshot.select(canonical_json(snapshot.columns).alias("value"))


FILE_ROWS = 100_000  # lines of a file at most, and so entries of a digest
_FILES = (
    "file string, position int, first_key string, last_key string, rows long, lines_before long, "
    "lines_sha256 string"
)
_ENTRY = "generation string, rows long, files int, written_at timestamp"


class SnapshotError(ValueError):
    """Stored lines are not those that were written."""


def _line_key() -> Column:
    """Order key of a line: received date, then id, as the writer orders them."""
    received = F.coalesce(F.get_json_object("value", "$.date_received"), F.lit(""))
    return F.concat(received, F.lit("|"), F.coalesce(F.get_json_object("value", "$.complaint_id"), F.lit("")))


def _measured(lines: DataFrame) -> DataFrame:
    """Rows, first and last key and a digest of the lines of each file, whatever their order."""
    each = lines.select(
        F.col("_metadata.file_name").alias("file"), _line_key().alias("key"), F.sha2("value", 256).alias("h")
    )
    return each.groupBy("file").agg(
        F.max("key").alias("first_key"),
        F.min("key").alias("last_key"),
        F.count("*").alias("rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("lines_sha256"),
    )


def _lines_of(spark: SparkSession, path: str, generation: str) -> DataFrame:
    return spark.read.text(f"{path}/{generation}/lines")


def write_snapshot(snapshot: DataFrame, path: str) -> str:
    """Canonical lines, newest received date first, replaced as a whole; returns the generation."""
    spark = snapshot.sparkSession
    generation = f"generation-{uuid.uuid4().hex}"
    received = F.coalesce(F.col("date_received").cast("string"), F.lit(""))
    ordered = snapshot.orderBy(F.desc(received), F.desc("complaint_id"))
    lines = snapshot_lines(ordered).write.option("maxRecordsPerFile", FILE_ROWS)
    lines.text(f"{path}/{generation}/lines")
    # File names follow the partitions, which are in order. The list has a row for each file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = _measured(_lines_of(spark, path, generation)).select(
        "file",
        (F.row_number().over(Window.orderBy("file")) - 1).cast("int").alias("position"),
        "first_key",
        "last_key",
        "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("lines_before"),
        "lines_sha256",
    )
    files.write.parquet(f"{path}/{generation}/files")
    stored = spark.read.schema(_FILES).parquet(f"{path}/{generation}/files")
    entry = stored.agg(
        F.lit(generation).alias("generation"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("*").cast("int").alias("files"),
        F.current_timestamp().alias("written_at"),
    )
    entry.coalesce(1).write.mode("append").json(f"{path}/current")
    return generation


def current_generation(spark: SparkSession, path: str) -> str | None:
    """Generation written last; None for a folder of plain lines."""
    try:
        entries = spark.read.schema(_ENTRY).json(f"{path}/current")
    except AnalysisException:  # no such folder
        return None
    return entries.agg(F.max_by("generation", F.struct("written_at", "generation"))).first()[0]


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """The list of files of the current generation, in order."""
    generation = current_generation(spark, path)
    return spark.read.schema(_FILES).parquet(f"{path}/{generation}/files").orderBy("position")


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """`file, reason` of files whose lines are not the listed ones."""
    generation = current_generation(spark, path)
    listed = spark.read.schema(_FILES).parquet(f"{path}/{generation}/files")
    names = ("first_key", "last_key", "rows", "lines_sha256")
    found = _measured(_lines_of(spark, path, generation)).select(
        "file", F.struct(*names).alias("found")
    )
    joined = listed.select("file", F.struct(*names).alias("listed")).join(found, "file", "full")
    reason = (
        F.when(F.col("found").isNull(), "lost")
        .when(F.col("listed").isNull(), "added")
        .when(~F.col("found").eqNullSafe(F.col("listed")), "changed")
    )
    return joined.select("file", reason.alias("reason")).where("reason is not null")


def _checked(spark: SparkSession, path: str) -> str:
    """Folder of the lines to read, after its files were held against the list."""
    generation = current_generation(spark, path)
    if generation is None:
        return path
    broken = broken_files(spark, path).orderBy("file").limit(5).collect()
    if broken:
        raise SnapshotError("; ".join(f"{r['file']} {r['reason']}" for r in broken))
    return f"{path}/{generation}/lines"


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines for the quality gate."""
    return spark.read.text(_checked(spark, path))


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line_number, value` from 0 in the written order.

    A line is ranked within its file only; the list tells how many lines lie before the file.
    """
    lines = spark.read.text(_checked(spark, path)).select(
        F.col("_metadata.file_name").alias("file"), _line_key().alias("key"), "value"
    )
    listed = snapshot_files(spark, path).select("file", "lines_before")
    within = Window.partitionBy("file").orderBy(F.desc("key"), F.desc("value"))
    number = F.col("lines_before") + F.row_number().over(within) - 1
    return lines.join(listed, "file").select(number.alias("line_number"), "value")


def read_snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """Untyped rows, as the gate's fingerprint takes them."""
    return spark.read.schema(SNAPSHOT).json(_checked(spark, path))


def read_snapshot_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a snapshot that passed the gate; a bad line fails the job."""
    return spark.read.schema(_STORED).option("mode", "FAILFAST").json(_checked(spark, path))


def as_complaints(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows in the complaints schema, before any prediction exists."""
    columns = []
    for field in COMPLAINTS.fields:
        if field.name == "prediction_abstained":
            columns.append(F.lit(False).alias(field.name))
        elif field.name in snapshot.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return snapshot.select(*columns)


def write_complaints(complaints: DataFrame, path: str) -> None:
    """Parquet by received month, products together inside a file."""
    dated = complaints.withColumn(MONTH, F.date_format("date_received", "yyyy-MM"))
    # Rebalancing keeps a month together, splits a busy one and needs no sampling
    # pass over rows that may carry model scores.
    (
        dated.hint("rebalance", MONTH)
        .sortWithinPartitions(MONTH, "product", "date_received")
        .write.mode("overwrite")
        .partitionBy(MONTH)
        .parquet(path)
    )


def in_months(complaints: DataFrame, first: Column, last: Column) -> DataFrame:
    """Let a date range prune the month folders of a stored complaints table."""
    if MONTH not in complaints.columns:
        return complaints
    month = F.col(MONTH)
    return complaints.where(
        (month >= F.date_format(first, "yyyy-MM")) & (month <= F.date_format(last, "yyyy-MM"))
    )


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    """Stored complaints; the month folder stays text."""
    schema = StructType([*COMPLAINTS.fields, StructField(MONTH, StringType())])
    return spark.read.schema(schema).parquet(path)
