"""From source responses to gated tables, a scored queue and anomalies.

Every run writes below a new version folder; `current` names a version only
after its tables are complete. Stages hand over by written tables, so a lost
executor or a failed stage costs that stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequeue.functions.hashing import rowset_fingerprint
from casequeue.functions.text import iso_date
from casequeue.operators import lineage, quality, router, sampling, views, volume
from casequeue.schemas import SNAPSHOT
from casequeue.sources import manifests, models, search_pages, snapshot

SNAPSHOT_COLUMNS = SNAPSHOT.fieldNames()


@dataclass(frozen=True)
class BuildPaths:
    root: str
    version: str

    def of(self, name: str) -> str:
        return f"{self.root}/{self.version}/{name}"

    @property
    def current(self) -> str:
        return f"{self.root}/current"


def stage_source(spark: SparkSession, pages_path: str, paths: BuildPaths) -> DataFrame:
    """Normalized source rows as parquet, with the received date typed."""
    records = search_pages.read_search_pages(spark, pages_path)
    rows = search_pages.normalize_source(records)
    rows.withColumn("received", iso_date(F.col("date_received"))).write.mode("overwrite").parquet(
        paths.of("source")
    )
    return spark.read.parquet(paths.of("source"))


def select_snapshot(
    spark: SparkSession, source: DataFrame, plan: sampling.SelectionPlan, paths: BuildPaths
) -> None:
    """Draw the sample, write it as lines and rows, and record its lineage."""
    taken, caps, totals = sampling.draw_sample(spark, source, plan, received="received")
    sampling.sampling_report(caps, taken, totals).write.mode("overwrite").parquet(
        paths.of("sampling_report")
    )
    sampling.dedup_global(taken, created="received").write.mode("overwrite").parquet(
        paths.of("selected")
    )
    selected = spark.read.parquet(paths.of("selected"))
    rows = sampling.final_cap(selected, plan.max_records).select(*SNAPSHOT_COLUMNS)
    snapshot.write_snapshot(rows, paths.of("snapshot"))
    frame = lineage.lineage_frame(
        sampling.selection_windows(spark, plan),
        totals,
        sampling.retained_per_window(selected),
        rowset_fingerprint(rows),
    )
    lineage.write_lineage(frame, paths.of("lineage"))


def check_snapshot(
    spark: SparkSession,
    pages_path: str,
    plan: sampling.SelectionPlan,
    paths: BuildPaths,
) -> DataFrame:
    """Run the gate over the written lines; stops when it does not pass."""
    lines = snapshot.read_snapshot_lines(spark, paths.of("snapshot"))
    quality.parse_lines(lines).write.mode("overwrite").parquet(paths.of("parsed"))
    parsed = spark.read.parquet(paths.of("parsed"))
    meta = lineage.reported_source_meta(search_pages.read_pages(spark, pages_path))
    written = lineage.snapshot_manifest(spark.read.parquet(paths.of("lineage")), meta)
    rows = snapshot.read_snapshot_rows(spark, paths.of("snapshot"))
    quality.quality_counters(parsed, plan.as_of).write.mode("overwrite").parquet(
        paths.of("quality_counters")
    )
    counters = spark.read.parquet(paths.of("quality_counters"))
    report = quality.quality_report(
        counters,
        row_cap=plan.max_records,
        manifest=written,
        fingerprint=rowset_fingerprint(rows),
    )
    report.write.mode("overwrite").parquet(paths.of("quality"))
    quality.column_profile(parsed).write.mode("overwrite").parquet(
        paths.of("profile")
    )
    quality.routing_support(counters).write.mode("overwrite").parquet(paths.of("routing_support"))
    stored = spark.read.parquet(paths.of("quality"))
    quality.gate(stored)
    manifests.write_source_windows(
        manifests.source_windows(written), paths.of("source_windows")
    )
    return stored


def load_complaints(spark: SparkSession, paths: BuildPaths) -> DataFrame:
    rows = snapshot.as_complaints(snapshot.read_snapshot_jsonl(spark, paths.of("snapshot")))
    snapshot.write_complaints(rows, paths.of("complaints"))
    return snapshot.read_complaints(spark, paths.of("complaints"))


def route_complaints(
    spark: SparkSession,
    complaints: DataFrame,
    plan: sampling.SelectionPlan,
    paths: BuildPaths,
    test_months: int = 1,
) -> DataFrame:
    """Train on eligible narratives, save the model, write scored complaints."""
    trained = router.train_router(
        views.eligible_narratives(complaints),
        as_of=plan.as_of,
        test_months=test_months,
        workspace=paths.of("router_work"),
    )
    models.save_model(trained.model, paths.of("router"))
    for name, report in trained.reports.items():
        report.write.mode("overwrite").parquet(paths.of(f"router_reports/{name}"))
    snapshot.write_complaints(
        trained.model.score(complaints).drop(snapshot.MONTH), paths.of("scored_complaints")
    )
    return snapshot.read_complaints(spark, paths.of("scored_complaints"))


def switch_version(spark: SparkSession, paths: BuildPaths) -> None:
    """Make a complete version the current one: one appended row, the last step of a build.

    Earlier rows stay, so a switch that fails leaves the version before it in place.
    """
    now = F.current_timestamp().alias("switched_at")
    row = spark.range(1).select(F.lit(paths.version).alias("version"), now).coalesce(1)
    row.write.mode("append").json(paths.current)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version of the latest switch; None before the first."""
    rows = spark.read.schema("version string, switched_at timestamp").json(f"{root}/current")
    return rows.agg(F.max_by("version", F.struct("switched_at", "version"))).first()[0]


def build_all(
    spark: SparkSession,
    pages_path: str,
    root: str,
    version: str,
    plan: sampling.SelectionPlan,
    *,
    test_months: int = 1,
    train: bool = True,
) -> DataFrame:
    """The whole run; returns the operational cases of the new version."""
    paths = BuildPaths(root, version)
    source = stage_source(spark, pages_path, paths)
    select_snapshot(spark, source, plan, paths)
    check_snapshot(spark, pages_path, plan, paths)
    complaints = load_complaints(spark, paths)
    if train:
        complaints = route_complaints(spark, complaints, plan, paths, test_months)
    volume.anomaly_report(complaints, as_of=plan.as_of).write.mode("overwrite").parquet(
        paths.of("anomalies")
    )
    switch_version(spark, paths)
    return views.operational_cases(complaints)
