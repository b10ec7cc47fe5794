"""The quality gate over snapshot lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.functions.text import iso_date, strip

# Fixed values of the contract.
REQUIRED_COLUMNS = ("complaint_id", "date_received", "product", "issue")
PROFILE_COLUMNS = (
    "complaint_id",
    "date_received",
    "product",
    "issue",
    "company",
    "state",
    "submitted_via",
    "timely",
    "narrative",
    "has_narrative",
)
ROW_CAP = 100_000
RATE_LIMIT = 0.001
MINIMUM_NARRATIVE_ROWS = 500
MINIMUM_NARRATIVE_CHARS = 20


class QualityGateError(RuntimeError):
    """A critical or high check failed."""


# Text fields keep the JSON spelling of other types; two keep their JSON type.
_LINE = ", ".join(
    [
        *[f"{c} string" for c in PROFILE_COLUMNS if c not in ("narrative", "has_narrative")],
        "date_sent_to_company string",
        "narrative variant",
        "has_narrative variant",
        "_corrupt_record string",
    ]
)


# Whole strings, and all else but braces: what a scan for braces outside of strings leaves out.
_NO_BRACES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^{}"]++|"'


def _braces(line: Column) -> Column:
    return F.regexp_replace(line, _NO_BRACES, "")


def _one_object(braces: Column) -> Column:
    """Whether braces outside of strings close for the first time at the end of a line.

    A JSON parser stops after the first object; what follows it must not pass.
    """

    def step(at: Column, brace: Column) -> Column:
        depth = at["depth"] + F.when(brace == "{", 1).otherwise(-1)
        closed = at["closed"] + F.when(depth <= 0, 1).otherwise(0)
        return F.struct(depth.alias("depth"), closed.alias("closed"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    nested = F.aggregate(F.split(braces, ""), start, step)["closed"] == 1
    return F.when(braces == "{}", True).when(braces == "", False).otherwise(nested)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Snapshot lines (`value`) as text columns with what JSON alone can tell.

    `is_object` is false for a line that is not one JSON object, which makes it
    no row, and NULL for a blank line, which counts as nothing. A later stage
    can read the result many times, so large jobs write it as parquet first.
    """
    # Each step is named before its next use: a line is stripped, scanned for braces and parsed once.
    bare = lines.select("value", strip(F.col("value")).alias("bare"))
    scanned = bare.select("value", "bare", _braces(F.col("bare")).alias("braces"))
    ends = F.startswith("bare", F.lit("{")) & F.endswith("bare", F.lit("}"))
    checked = scanned.select(
        "value", (ends & _one_object(F.col("braces"))).alias("shaped"), (F.col("bare") == "").alias("blank")
    )
    record = F.from_json(F.when(F.col("shaped"), F.col("value")), _LINE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = checked.select("value", "shaped", "blank", record.alias("r"))
    is_object = F.when(
        ~F.col("blank"), F.col("shaped") & F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    )
    required = [F.lit(name) for name in REQUIRED_COLUMNS]
    filled = F.lit(True)
    for name in REQUIRED_COLUMNS:
        filled = filled & F.col(f"r.{name}").isNotNull()
    # Only rows with a NULL need a second look for whether the key itself exists.
    keyed = F.size(F.array_except(F.array(*required), F.json_object_keys("value"))) == 0

    def text(name: str) -> Column:
        return F.try_variant_get(f"r.{name}", "$", "string")

    flag_kind, flag_text = F.schema_of_variant("r.has_narrative"), text("has_narrative")
    truthy = (
        F.when(flag_kind == "BOOLEAN", flag_text == "true")
        .when(flag_kind == "STRING", flag_text != "")
        .otherwise(flag_text.isNotNull() & (flag_text.try_cast("double") != 0))
    )
    narrative_kind = F.schema_of_variant("r.narrative")
    return parsed.select(
        is_object.alias("is_object"),
        F.when(filled, F.lit(True)).otherwise(keyed).alias("has_required_keys"),
        *[
            (text(name) if name in ("narrative", "has_narrative") else F.col(f"r.{name}")).alias(name)
            for name in PROFILE_COLUMNS
        ],
        F.col("r.date_sent_to_company").alias("date_sent_to_company"),
        F.coalesce(narrative_kind == "STRING", F.lit(False)).alias("narrative_is_text"),
        F.coalesce(truthy, F.lit(False)).alias("claims_narrative"),
    )


def snapshot_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_object")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def quality_counters(parsed: DataFrame, as_of: date) -> DataFrame:
    """One row of counts. Lines are parsed once: flags are summed by id, then over ids.

    Sums combine on the map side, so a repeated id is no heavier than another.
    """
    # Named first, so that dates are read and narratives stripped once for all flags.
    parsed = parsed.withColumns(
        {
            "_received": iso_date(F.col("date_received")),
            "_sent_day": iso_date(F.col("date_sent_to_company")),
            "_narrative": strip(F.col("narrative")),
        }
    )
    row = F.col("is_object")
    received, sent = F.col("_received"), F.col("date_sent_to_company")
    sent_day, narrative = F.col("_sent_day"), F.col("_narrative")
    has_text = F.col("narrative_is_text") & ~_blank(narrative)
    no_product = _blank(F.col("product"))
    long_enough = F.length(narrative) >= MINIMUM_NARRATIVE_CHARS
    conditions = {
        "row_count": row,
        "invalid_lines": ~row,
        "missing_required_columns": row & ~F.col("has_required_keys"),
        "missing_ids": row & _blank(strip(F.col("complaint_id"))),
        "invalid_dates": row & received.isNull(),
        "future_dates": row & (received > F.lit(as_of)),
        "sent_before_received": row
        & received.isNotNull()
        & ~_blank(sent)
        & (sent_day.isNull() | (sent_day < received)),
        "missing_labels": row & (no_product | _blank(F.col("issue"))),
        "narrative_mismatch": row & (F.col("claims_narrative") != has_text),
        "narrative_eligible": row & has_text & long_enough & ~no_product,
    }
    flags = [F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in conditions.items()]
    identity = F.when(row, strip(F.col("complaint_id"))).alias("id")
    per_id = (
        parsed.select(identity, *flags)
        .groupBy("id")
        .agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in conditions])
    )
    repeats = F.when(F.coalesce("id", F.lit("")) != "", F.col("n") - 1)
    return per_id.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in conditions],
        F.coalesce(F.sum(repeats), F.lit(0)).alias("duplicate_rows"),
    )


def _check(
    name: str, severity: str, observed: Column, threshold: str, passed: Column, detail: str
) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.lit(severity).alias("severity"),
        observed.cast("double").alias("observed"),
        F.lit(threshold).alias("threshold"),
        F.lit(detail).alias("detail"),
    )


def quality_report(
    counters: DataFrame,
    *,
    row_cap: int = ROW_CAP,
    manifest: DataFrame | None = None,
    fingerprint: DataFrame | None = None,
) -> DataFrame:
    """One row per check, in contract order.

    With a manifest (one row) the gate also requires its row-set hash to equal
    `fingerprint` and its source windows to report neither issues nor staleness.
    """

    def zero(name: str, severity: str, counter: str, detail: str) -> Column:
        return _check(name, severity, F.col(counter), "0", F.col(counter) == 0, detail)

    def rare(name: str, severity: str, counter: str, detail: str) -> Column:
        rate = F.col(counter).cast("double") / F.greatest(F.col("row_count"), F.lit(1))
        shown = F.round(rate, 6)
        return _check(name, severity, shown, f"<={RATE_LIMIT}", rate <= RATE_LIMIT, detail)

    rows, eligible = F.col("row_count"), F.col("narrative_eligible")
    checks = [
        zero("parseable_json_lines", "critical", "invalid_lines", "Lines must be JSON objects."),
        _check(
            "row_count_within_snapshot_contract",
            "critical",
            rows,
            f"1..{row_cap}",
            rows.between(1, row_cap),
            "The snapshot is capped.",
        ),
        zero(
            "required_columns_present",
            "critical",
            "missing_required_columns",
            "Rows carry the required keys.",
        ),
        zero("complaint_id_present", "critical", "missing_ids", "Rows need an id."),
        zero("complaint_id_unique", "critical", "duplicate_rows", "Ids are the row grain."),
        zero("date_received_valid", "high", "invalid_dates", "Received dates must parse."),
        zero("date_received_not_future", "high", "future_dates", "No date after the as-of date."),
        zero(
            "date_sent_not_before_received",
            "high",
            "sent_before_received",
            "Cases are received before they are sent on.",
        ),
        rare("routing_labels_present", "high", "missing_labels", "Product and issue are needed."),
        rare(
            "narrative_flag_consistent",
            "medium",
            "narrative_mismatch",
            "The flag agrees with the text.",
        ),
        _check(
            "narrative_support_for_routing_evaluation",
            "medium",
            eligible,
            str(MINIMUM_NARRATIVE_ROWS),
            eligible >= MINIMUM_NARRATIVE_ROWS,
            "Routing needs enough narratives.",
        ),
    ]
    if manifest is not None:
        checks += _manifest_checks(manifest, fingerprint)
    return counters.select(F.inline(F.array(*checks)))


def _manifest_checks(manifest: DataFrame, fingerprint: DataFrame | None) -> list[Column]:

    def flagged(name: str) -> Column:
        hit = F.exists("windows", lambda w: w["source_meta"][name].eqNullSafe(True))
        return F.coalesce(hit, F.lit(False)).alias(name)

    header = manifest.select(
        F.struct(
            "snapshot_sha256",
            (F.coalesce(F.array_size("windows"), F.lit(0)) > 0).alias("reported"),
            flagged("has_data_issue"),
            flagged("is_data_stale"),
        ).alias("m")
    ).scalar()
    expected, reported = header.getField("snapshot_sha256"), header.getField("reported")
    actual = (
        fingerprint.select("rowset_sha256").scalar() if fingerprint is not None else F.lit(None)
    )
    same = expected == actual
    return [
        _check(
            "manifest_snapshot_sha256_matches",
            "critical",
            F.when(same, 0).otherwise(1),
            "0",
            same,
            "The row set must be the one the manifest names.",
        ),
        *[
            _check(
                name,
                "high",
                header.getField(field).cast("int"),
                "0",
                reported & ~header.getField(field),
                detail,
            )
            for name, field, detail in (
                ("source_reports_no_data_issue", "has_data_issue", "No reported data issue."),
                ("source_reports_fresh", "is_data_stale", "No reported staleness."),
            )
        ],
    ]


def overall(report: DataFrame) -> DataFrame:
    """One row: whether every critical and high check passed."""
    gating = F.col("severity").isin("critical", "high")
    return report.agg(F.coalesce(F.every(~gating | F.col("passed")), F.lit(False)).alias("passed"))


def failed_checks(report: DataFrame) -> DataFrame:
    """`name` of each critical or high check that did not pass; what was not decided did not."""
    passed = F.coalesce(F.col("passed"), F.lit(False))
    return report.where(F.col("severity").isin("critical", "high") & ~passed).select("name")


def gate(report: DataFrame) -> None:
    """Stop the job unless every critical and high check passed."""
    names = [r["name"] for r in failed_checks(report).collect()]
    if names:
        raise QualityGateError("failed checks: " + ", ".join(names))


def routing_support(counters: DataFrame) -> DataFrame:
    """One row of the profile: narratives that can be routed, and how many an evaluation needs."""
    return counters.select(
        F.col("narrative_eligible").cast("long").alias("narrative_eligible_count"),
        F.lit(MINIMUM_NARRATIVE_ROWS).cast("long").alias("minimum_narrative_eligible_count"),
    )


def column_profile(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """Null counts and distinct counts of each column, in one pass over the lines.

    Without `cap` counts are exact and whole: only digests of values move, once for each value and
    map task. With it they are exact below it and shown up to it (at most 2**26): a task keeps the
    smallest hashes of a column, of which `cap` or more are enough, and only those move.
    """
    if cap is not None:
        return _capped_profile(parsed, cap)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.md5(F.nullif(F.col(c), F.lit(""))).alias("digest"))
            for c in PROFILE_COLUMNS
        ]
    )
    # A line that is no row has no pairs; a filter would parse every line twice.
    digests = parsed.select(F.inline(F.when(F.col("is_object"), pairs)))
    per_value = digests.groupBy("column", "digest").agg(F.count("*").alias("n"))
    counted = per_value.groupBy("column").agg(
        F.sum("n").alias("_rows"),
        F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias(
            "null_count"
        ),
        F.count("digest").alias("_distinct"),
    )
    return counted.select(
        "column",
        "null_count",
        F.round(F.col("null_count") / F.col("_rows"), 6).alias("null_rate"),
        F.col("_distinct").alias("distinct_count_observed"),
        F.lit(False).alias("distinct_count_capped"),
    )


def _capped_profile(parsed: DataFrame, cap: int) -> DataFrame:
    """The profile from theta sketches, which are exact up to their nominal size of at least `cap`."""
    size = min(26, max(4, (cap - 1).bit_length()))
    rows = F.count_if("is_object")

    def column(name: str) -> Column:
        value = F.when(F.col("is_object"), F.nullif(F.col(name), F.lit("")))
        nulls = rows - F.count(value)
        found = F.theta_sketch_estimate(F.theta_sketch_agg(value, size))
        return F.struct(
            F.lit(name).alias("column"),
            nulls.alias("null_count"),
            F.round(F.try_divide(nulls, rows), 6).alias("null_rate"),
            F.least(found, F.lit(cap)).cast("bigint").alias("distinct_count_observed"),
            (found >= cap).alias("distinct_count_capped"),
        )

    counted = parsed.agg(rows.alias("_rows"), F.array(*[column(c) for c in PROFILE_COLUMNS]).alias("_all"))
    # As without a cap, a table without rows has no profile.
    return counted.where("_rows > 0").select(F.inline("_all"))
