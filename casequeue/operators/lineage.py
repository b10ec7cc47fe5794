"""Lineage rows: what was selected, from what, under which hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.functions.hashing import row_sha256
from casequeue.sources.handover import written


def lineage_frame(
    windows: DataFrame,
    totals: DataFrame,
    retained: DataFrame,
    fingerprint: DataFrame,
    parent_sha256: str | None = None,
) -> DataFrame:
    """One row per window with the row-set hash, the parent's and its own.

    The row's own hash covers every other column.
    """
    row_set = fingerprint.select(F.struct("row_count", "rowset_sha256").alias("f")).scalar()
    rows = (
        windows.join(totals, "window_name", "left")
        .join(retained, "window_name", "left")
        .select(
            "window_name",
            F.col("window_start").alias("date_received_min"),
            F.col("window_end").alias("date_received_max_exclusive"),
            "complete_month",
            "selection_cap",
            F.coalesce("window_total", F.lit(0)).cast("bigint").alias("source_total"),
            F.coalesce("window_relation", F.lit("eq")).alias("source_total_relation"),
            F.coalesce("selected_sample_rows", F.lit(0)).cast("bigint").alias(
                "selected_sample_rows"
            ),
            row_set.getField("row_count").alias("rowset_rows"),
            row_set.getField("rowset_sha256").alias("rowset_sha256"),
            F.lit(parent_sha256).cast("string").alias("parent_sha256"),
        )
    )
    return rows.withColumn("lineage_sha256", row_sha256(rows.columns))


def verify_lineage(lineage: DataFrame) -> DataFrame:
    """Lineage rows whose own hash no longer matches their content."""
    body = [c for c in lineage.columns if c != "lineage_sha256"]
    return lineage.where(row_sha256(body) != F.col("lineage_sha256"))


def write_lineage(lineage: DataFrame, path: str) -> None:
    """The lineage of one version, replaced as a whole when its build is run again."""
    lineage.write.mode("overwrite").parquet(path)


def snapshot_manifest(lineage: DataFrame, source_meta: DataFrame | None = None) -> DataFrame:
    """One manifest row from a build's lineage, as the quality gate reads it.

    Windows are calendar months, so the list is short. `source_meta` has one
    row with `is_data_stale, has_data_issue` as the source reported them.
    """
    empty = "named_struct('is_data_stale', cast(null as boolean), 'has_data_issue', cast(null as boolean))"
    meta = (
        source_meta.select(F.struct("is_data_stale", "has_data_issue").alias("m")).scalar()
        if source_meta is not None
        else F.expr(empty)
    )
    window = F.struct(
        F.col("window_name").alias("name"),
        F.col("date_received_min").cast("string").alias("date_received_min"),
        F.col("date_received_max_exclusive").cast("string").alias("date_received_max_exclusive"),
        "complete_month",
        "source_total",
        "source_total_relation",
        F.col("selected_sample_rows").alias("retained_after_global_deduplication"),
        F.col("_meta").alias("source_meta"),
    )
    return lineage.withColumn("_meta", meta).agg(
        F.max("rowset_sha256").alias("snapshot_sha256"),
        F.sort_array(F.collect_list(window)).alias("windows"),
    )


def reported_source_meta(pages: DataFrame) -> DataFrame:
    """One row: whether any response reported stale data or a data issue."""
    return pages.agg(
        F.bool_or("source_meta.is_data_stale").alias("is_data_stale"),
        F.bool_or("source_meta.has_data_issue").alias("has_data_issue"),
    )


def entry_sha256(kind: Column, name: Column, content: Column, parent: Column) -> Column:
    """Self hash of a lineage entry, taken before it is added."""
    return F.sha2(F.concat_ws("|", kind, name, content, F.coalesce(parent, F.lit(""))), 256)


def lineage_entries(artifacts: DataFrame) -> DataFrame:
    """`kind, name, content_sha256, parent_sha256` with `entry_sha256`.

    An artifact is a window, a snapshot, a frozen sample, a draft manifest or a review; `parent_sha256`
    is the entry hash of what it was made from, NULL for a source.
    """
    columns = ("kind", "name", "content_sha256", "parent_sha256")
    return artifacts.select(
        *columns, entry_sha256(*(F.col(c) for c in columns)).alias("entry_sha256")
    )


def broken_links(entries: DataFrame) -> DataFrame:
    """For each entry the first broken link on the way to its source: `kind, name, steps,
    broken_kind, broken_name, reason`; the last three are NULL where the chain is whole.

    An entry is `changed` when its content no longer has its hash, and its parent is `lost` when no
    entry has the hash that it names. A step joins all open entries with their parents at once.
    """
    columns = [F.col(c) for c in ("kind", "name", "content_sha256", "parent_sha256")]
    stored = entries.select(
        "kind", "name", "parent_sha256", "entry_sha256",
        F.coalesce(entry_sha256(*columns) != F.col("entry_sha256"), F.lit(True)).alias("changed"),
    )
    # An entry that was stored twice is one parent; a changed copy of it counts.
    parents = stored.groupBy(F.col("entry_sha256").alias("wanted")).agg(
        F.max(F.struct("changed", "kind", "name", "parent_sha256")).alias("p")
    )
    parents = written(parents)
    changed = F.col("changed")
    reached = written(
        stored.select(
            "kind",
            "name",
            F.lit(0).alias("steps"),
            F.when(changed, F.col("kind")).alias("broken_kind"),
            F.when(changed, F.col("name")).alias("broken_name"),
            F.when(changed, F.lit("changed")).alias("reason"),
            F.col("kind").alias("at_kind"),
            F.col("name").alias("at_name"),
            F.when(~changed, F.col("parent_sha256")).alias("wanted"),
        )
    )
    done = []
    while True:
        done.append(reached.where("wanted is null"))
        waiting = reached.where("wanted is not null")
        if waiting.isEmpty():
            break
        joined = waiting.join(parents, "wanted", "left")
        lost, bad = F.col("p").isNull(), F.coalesce(F.col("p.changed"), F.lit(False))
        reached = written(
            joined.select(
                "kind",
                "name",
                (F.col("steps") + 1).alias("steps"),
                F.when(lost, F.col("at_kind")).when(bad, F.col("p.kind")).alias("broken_kind"),
                F.when(lost, F.col("at_name")).when(bad, F.col("p.name")).alias("broken_name"),
                F.when(lost, F.lit("lost")).when(bad, F.lit("changed")).alias("reason"),
                F.col("p.kind").alias("at_kind"),
                F.col("p.name").alias("at_name"),
                F.when(~lost & ~bad, F.col("p.parent_sha256")).alias("wanted"),
            )
        )
    whole = reduce(DataFrame.unionByName, done)
    return whole.drop("at_kind", "at_name", "wanted")
