"""Manifests: source windows, frozen samples and draft bindings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casequeue.functions.hashing import row_sha256
from casequeue.schemas import DRAFT_MANIFEST, FROZEN_SAMPLE, SNAPSHOT_MANIFEST

# States and schema versions a manifest must declare.
FROZEN_STATUS = "frozen_unreviewed"
DRAFTS_STATUS = "private_generated_drafts"
DRAFTS_SCHEMA = "summary-draft-manifest-v1"


class ManifestError(ValueError):
    """A manifest header does not meet its contract."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row; a missing or unreadable file gives NULL fields, which the gate refuses."""
    try:
        return spark.read.schema(SNAPSHOT_MANIFEST).option("multiLine", True).json(path)
    except AnalysisException:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in SNAPSHOT_MANIFEST.fields]
        return spark.range(1).select(*empty)


def source_windows(manifest: DataFrame) -> DataFrame:
    """Rows of `windows[]`: relation defaults to `eq`, retained rows to 0."""
    window = manifest.select(F.explode("windows").alias("w")).select("w.*")
    return window.select(
        F.col("name").alias("window_name"),
        F.col("date_received_min").cast("date").alias("date_received_min"),
        F.col("date_received_max_exclusive").cast("date").alias("date_received_max_exclusive"),
        "complete_month",
        F.col("source_total").cast("bigint").alias("source_total"),
        F.coalesce("source_total_relation", F.lit("eq")).alias("source_total_relation"),
        F.coalesce(F.col("retained_after_global_deduplication"), F.lit(0))
        .cast("bigint")
        .alias("selected_sample_rows"),
    )


def read_source_windows(spark: SparkSession, path: str) -> DataFrame:
    return source_windows(read_manifest(spark, path))


def write_source_windows(windows: DataFrame, path: str) -> None:
    """Replace the window totals as a whole."""
    windows.coalesce(1).write.mode("overwrite").parquet(path)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _require(header: DataFrame, conditions: dict[str, Column]) -> None:
    """Check a one-row header; the first condition that does not hold is raised."""
    row = header.select(
        *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    ).first()
    for i, message in enumerate(conditions):
        if row is None or not row[f"c{i}"]:
            raise ManifestError(message)


def frozen_sample(
    sample: DataFrame, parent_sha256: str | None, rubric_version: str
) -> DataFrame:
    """One row: the manifest of a frozen sample, named by the hash of all its other fields.

    The sample's size is chosen by the caller; its items are one list in sample order.
    """
    item = F.struct("complaint_id", "month", "product")
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"]
    )
    body = sample.agg(listed.alias("items")).select(
        F.lit(FROZEN_STATUS).alias("status"),
        F.lit(rubric_version).alias("rubric_version"),
        F.lit(parent_sha256).cast("string").alias("parent_snapshot_sha256"),
        "items",
    )
    return body.withColumn("sample_manifest_sha256", row_sha256(body.columns))


def drafts_manifest(items: DataFrame, sample_sha256: str) -> DataFrame:
    """One row: the manifest of clean draft items of one sample, in the order of their cases."""
    item = F.struct("complaint_id", "draft_sha256", "model", "summary_id")
    body = items.agg(F.sort_array(F.collect_list(item)).alias("items")).select(
        F.lit(DRAFTS_SCHEMA).alias("schema_version"),
        F.lit(DRAFTS_STATUS).alias("status"),
        F.lit(sample_sha256).alias("source_sample_manifest_sha256"),
        "items",
    )
    return body.withColumn("manifest_sha256", row_sha256(body.columns))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A one-row manifest as one JSON object, replaced as a whole."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_frozen_sample(spark: SparkSession, path: str) -> DataFrame:
    """Items of a frozen, unreviewed sample with their manifest hash and position."""
    sample = spark.read.schema(FROZEN_SAMPLE).option("multiLine", True).json(path)
    ids = F.transform("items", lambda i: F.trim(i["complaint_id"]))
    _require(
        sample,
        {
            "the sample is not frozen and unreviewed": F.col("status") == FROZEN_STATUS,
            "the sample has no item list": F.col("items").isNotNull(),
            "sample items need an id and stratum": ~F.exists(
                "items",
                lambda i: _blank(i["complaint_id"]) | _blank(i["month"]) | _blank(i["product"]),
            ),
            "sample ids must be unique": F.size(F.array_distinct(ids)) == F.size(ids),
        },
    )
    return sample.select(
        "sample_manifest_sha256",
        "parent_snapshot_sha256",
        F.posexplode("items").alias("position", "item"),
    ).select("sample_manifest_sha256", "parent_snapshot_sha256", "position", "item.*")


def read_draft_manifest(spark: SparkSession, path: str, sample_sha256: str) -> DataFrame:
    """Draft bindings of the sample named by `sample_sha256`."""
    manifest = spark.read.schema(DRAFT_MANIFEST).option("multiLine", True).json(path)
    ids = F.transform("items", lambda i: F.trim(i["complaint_id"]))
    _require(
        manifest,
        {
            "draft manifest schema is not supported": F.col("schema_version") == DRAFTS_SCHEMA,
            "draft manifest has another status": F.col("status") == DRAFTS_STATUS,
            "draft manifest belongs to another sample": F.col("source_sample_manifest_sha256")
            == sample_sha256,
            "draft manifest has no item list": F.col("items").isNotNull(),
            "draft items need ids, model and hash": ~F.exists(
                "items",
                lambda i: _blank(i["complaint_id"])
                | _blank(i["summary_id"])
                | _blank(i["model"])
                | (F.coalesce(F.length(F.trim(i["draft_sha256"])), F.lit(0)) != 64),
            ),
            "draft ids must be unique": F.size(F.array_distinct(ids)) == F.size(ids),
        },
    )
    return manifest.select(
        F.col("manifest_sha256").alias("review_manifest_sha256"), F.explode("items").alias("item")
    ).select("review_manifest_sha256", "item.*")
