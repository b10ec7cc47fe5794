"""Append-only logs: decisions, drafts, draft reviews, system events.

A log is a table partitioned by batch, and a ledger beside it. A batch with an id of its own can be
appended again, whole, after any failure: its partition is written anew, so there is one copy of it. The ledger
names a batch and the digest of its rows before they are written, and again when they all are; an id that
comes back with other rows is refused, and a batch that was not finished is not read. Batches without
an id are new each time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casequeue.functions.hashing import rowset_fingerprint
from casequeue.operators.evidence import draft_errors
from casequeue.schemas import ROUTE_REVIEWS, SUMMARY_DRAFTS, SUMMARY_REVIEWS, SYSTEM_EVENTS

# Accepted decisions and field bounds.
ROUTE_DECISIONS = ("approve", "override", "reject")
SUMMARY_DECISIONS = ("approve", "reject")
ACTOR_LENGTH = (2, 100)
MAX_NOTES = 1000
MAX_ROUTE = 250


def _length_in(name: str, low: int, high: int) -> Column:
    return F.coalesce(F.length(name), F.lit(0)).between(low, high)


def _codes(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()])
    )


def _split(batch: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = batch.withColumn("errors", _codes(rules))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def check_route_reviews(batch: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) decisions; approve and override must name a route."""
    # Cases are reduced to the batch's ids before anything is deduplicated.
    asked = batch.select("complaint_id").distinct()
    known = (
        cases.select("complaint_id")
        .join(asked, "complaint_id", "left_semi")
        .distinct()
        .withColumn("known_case", F.lit(True))
    )
    given = F.coalesce(F.col("approved_route"), F.lit("")) != ""
    # Rules on fields come before the join, so that it moves only what the caller selects.
    broken = _codes(
        {
            "decision": F.col("decision").isin(*ROUTE_DECISIONS),
            "reviewer_id": _length_in("reviewer_id", *ACTOR_LENGTH),
            "approved_route_missing": (F.col("decision") == "reject") | given,
            "approved_route_length": _length_in("approved_route", 0, MAX_ROUTE),
            "notes_length": _length_in("notes", 0, MAX_NOTES),
        }
    )
    joined = batch.withColumn("errors", broken).join(known, "complaint_id", "left")
    unknown = _codes({"unknown_case": F.col("known_case")})
    checked = joined.withColumn("errors", F.concat(unknown, "errors")).drop("known_case")
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def check_summary_drafts(
    batch: DataFrame, cases: DataFrame, stored: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) drafts: of a known case, with an id of their own, within bounds.

    `stored` are the drafts that the log already has.
    """
    asked = batch.select("complaint_id").distinct()
    known = (
        cases.select("complaint_id")
        .join(asked, "complaint_id", "left_semi")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    ids = batch.select("summary_id")
    if stored is not None:
        ids = ids.unionByName(stored.select("summary_id"))
    taken = (
        ids.where(F.coalesce(F.col("summary_id"), F.lit("")) != "")
        .groupBy("summary_id")
        .agg((F.count("*") == 1).alias("_single"))
    )
    marked = batch.join(known, "complaint_id", "left").join(taken, "summary_id", "left")
    rules = {
        "unknown_case": F.col("_known"),
        "summary_id": F.col("_single"),
        "requested_by": _length_in("requested_by", *ACTOR_LENGTH),
    }
    errors = F.concat(_codes(rules), F.coalesce(draft_errors(F.col("payload")), F.array(F.lit("payload"))))
    checked = marked.withColumn("errors", errors).drop("_known", "_single")
    return (
        checked.where(F.size("errors") == 0).drop("errors"),
        checked.where(F.size("errors") > 0),
    )


def check_summary_reviews(batch: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) draft reviews; the case comes from the draft."""
    of_draft = drafts.select("summary_id", F.col("complaint_id").alias("_case"))
    joined = batch.drop("complaint_id").join(of_draft, "summary_id", "left")
    return _split(
        joined.withColumnRenamed("_case", "complaint_id"),
        {
            "unknown_draft": F.col("complaint_id").isNotNull(),
            "decision": F.col("decision").isin(*SUMMARY_DECISIONS),
            "reviewer_id": _length_in("reviewer_id", *ACTOR_LENGTH),
            "notes_length": _length_in("notes", 0, MAX_NOTES),
        },
    )


BATCH = "batch_id"
_LEDGER = "batch_id string, rows long, rowset_sha256 string, state string, noted_at timestamp"


class BatchConflictError(ValueError):
    """A batch id came back with other rows."""


def _ledger_path(path: str) -> str:
    return f"{path.rstrip('/')}_ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: its rows, digest and whether it was finished."""
    try:
        entries = spark.read.schema(_LEDGER).json(_ledger_path(path))
    except AnalysisException:  # no batch yet
        entries = spark.createDataFrame([], _LEDGER)
    return entries.groupBy(BATCH).agg(
        F.max("rows").alias("rows"),
        F.max("rowset_sha256").alias("rowset_sha256"),
        F.bool_or(F.col("state") == "done").alias("done"),
    )


def _note(spark: SparkSession, path: str, batch_id: str, rows: int, digest: str, state: str) -> None:
    entry = spark.range(1).select(
        F.lit(batch_id).alias(BATCH),
        F.lit(rows).cast("long").alias("rows"),
        F.lit(digest).alias("rowset_sha256"),
        F.lit(state).alias("state"),
        F.current_timestamp().alias("noted_at"),
    )
    entry.coalesce(1).write.mode("append").json(_ledger_path(path))


def _write_batch(batch: DataFrame, path: str, batch_id: str) -> None:
    (
        batch.withColumn(BATCH, F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH)
        .parquet(path)
    )


def _append(
    batch: DataFrame,
    accepted: DataFrame,
    schema: StructType,
    path: str,
    batch_id: str | None = None,
    rejected: tuple[DataFrame, str] | None = None,
) -> str:
    """Write the accepted rows of a batch to its partition; returns its id.

    The digest is of the batch as given. Repeating a finished batch changes nothing.
    """
    spark = batch.sparkSession
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    if batch_id is None:
        batch_id, count, digest = uuid.uuid4().hex, 0, ""
    else:
        count, digest = rowset_fingerprint(batch).first()
        known = read_ledger(spark, path).where(F.col(BATCH) == batch_id).first()
        if known and known["rowset_sha256"] != digest:
            raise BatchConflictError(f"batch {batch_id} was appended with other rows")
        if known and known["done"]:
            return batch_id
    _note(spark, path, batch_id, count, digest, "begun")
    _write_batch(accepted.select(*fields), path, batch_id)
    if rejected is not None:
        _write_batch(rejected[0], rejected[1], batch_id)
    _note(spark, path, batch_id, count, digest, "done")
    return batch_id


def append_route_reviews(
    batch: DataFrame, cases: DataFrame, path: str, reject_path: str, batch_id: str | None = None
) -> str:
    accepted, rejected = check_route_reviews(batch, cases)
    return _append(batch, accepted, ROUTE_REVIEWS, path, batch_id, (rejected, reject_path))


def append_summary_reviews(
    batch: DataFrame, drafts: DataFrame, path: str, reject_path: str, batch_id: str | None = None
) -> str:
    accepted, rejected = check_summary_reviews(batch, drafts)
    return _append(batch, accepted, SUMMARY_REVIEWS, path, batch_id, (rejected, reject_path))


def append_summary_drafts(
    batch: DataFrame,
    cases: DataFrame,
    path: str,
    reject_path: str,
    stored: DataFrame | None = None,
    batch_id: str | None = None,
) -> str:
    """Drafts whose ids neither the log at `path` nor `stored` has, the batch itself left aside."""
    spark = batch.sparkSession
    logged = _batches(spark, SUMMARY_DRAFTS, path)
    if logged is not None:
        others = logged.where(F.col(BATCH) != F.lit(batch_id or "")).select("summary_id")
        stored = others if stored is None else others.union(stored.select("summary_id")).distinct()
    accepted, rejected = check_summary_drafts(batch, cases, stored)
    return _append(batch, accepted, SUMMARY_DRAFTS, path, batch_id, (rejected, reject_path))


def append_events(batch: DataFrame, path: str, batch_id: str | None = None) -> str:
    return _append(batch, batch, SYSTEM_EVENTS, path, batch_id)


def _batches(spark: SparkSession, schema: StructType, path: str) -> DataFrame | None:
    """Rows of finished batches with their batch; None before the first one."""
    finished = read_ledger(spark, path).where("done").select(BATCH)
    try:
        stored = StructType([*schema.fields, StructField(BATCH, StringType())])
        return spark.read.schema(stored).parquet(path).join(finished, BATCH, "left_semi")
    except AnalysisException:  # no such folder
        return None


def read_log(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """Rows of all finished batches."""
    parts = [_batches(spark, schema, p) for p in paths]
    empty = spark.createDataFrame([], schema)
    found = [empty if p is None else p.select(*schema.names) for p in parts]
    return reduce(DataFrame.unionByName, found)
