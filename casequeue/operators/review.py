"""Human-review sampling, draft bindings, worksheets and factuality metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.functions.hashing import canonical_json, hash_rank
from casequeue.functions.ranges import top_per_group
from casequeue.functions.text import strip
from casequeue.operators.queue import latest_review
from casequeue.operators.views import count_where, ratio
from casequeue.schemas import WORKSHEET_COLUMNS

# Fixed values of the review contract.
SAMPLE_SIZE = 50
SEED = 42
SCORES = range(1, 6)
ID_LENGTH = 200
MONTH_LENGTH = 20
REVIEWER_LENGTH = (2, 100)
SHA256_LENGTH = 64
BINDING = ("complaint_id", "model", "draft_sha256", "review_manifest_sha256")
STATUS_NONE = "unavailable_until_frozen_sample_reviewed"
STATUS_PARTIAL = "partially_reviewed"
STATUS_DONE = "reviewed"


def current_draft_status(drafts: DataFrame, reviews: DataFrame, tie: str = "reviewer_id") -> DataFrame:
    """Drafts whose status follows their newest review."""
    newest = latest_review(reviews, "summary_id", tie).select("summary_id", "decision")
    reviewed = F.when(F.col("decision") == "approve", "approved").when(
        F.col("decision") == "reject", "rejected"
    )
    return (
        drafts.join(newest, "summary_id", "left")
        .withColumn("status", F.coalesce(reviewed, F.col("status")))
        .drop("decision")
    )


def freeze_sample(complaints: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """Round-robin over (month, product) strata, hash-ranked inside a stratum.

    Rows come with their 1-based `position`. A stratum gives at most `n` rows,
    so the final ordering sees at most `n` rows per stratum.
    """
    if n < 1:
        raise ValueError("sample size must be positive")
    eligible = complaints.where(F.col("has_narrative") & F.col("narrative").isNotNull()).select(
        "complaint_id", F.date_format("date_received", "yyyy-MM").alias("month"), "product"
    )
    ranked = top_per_group(
        eligible.withColumn("_rank", hash_rank(seed, F.col("complaint_id"))),
        ["month", "product"],
        [F.asc("_rank"), F.asc("complaint_id")],
        n,
        rank="round",
    )
    chosen = ranked.orderBy("round", "month", "product").limit(n)
    place = F.row_number().over(Window.orderBy("round", "month", "product"))
    return chosen.select("complaint_id", "month", "product", place.alias("position"))


def review_template(sample: DataFrame) -> DataFrame:
    """ID-only worksheet rows with blank rubric columns, in sample order."""
    number = F.lpad(F.col("position").cast("string"), 4, "0")
    # Positions beyond four digits keep all of them.
    number = F.when(F.col("position") > 9999, F.col("position").cast("string")).otherwise(number)
    filled = {
        "review_row_id": F.concat(F.lit("summary-review-"), number),
        "complaint_id": F.col("complaint_id"),
        "month": F.col("month"),
        "product": F.col("product"),
    }
    return sample.select(
        *[filled.get(name, F.lit("")).alias(name) for name in WORKSHEET_COLUMNS]
    )


_TWICE = {"summary_id": "_twice_summary", "complaint_id": "_twice_case"}


def _spread_key(rows: DataFrame, key: str, place: int = 0) -> Column:
    """`place:key`; blank keys, of which there may be any number, are spread and match nothing."""
    filled = F.coalesce(F.col(key), F.lit("")) != ""
    nowhere = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))
    return F.when(filled, F.concat(F.lit(f"{place}:"), F.col(key))).otherwise(nowhere)


def _with_repeats(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Adds for each key whether it occurs more than once in the rows; blank keys are no ids.

    One aggregate counts all keys, and every join takes its result, so rows are read twice.
    """
    named = F.array(*[_spread_key(rows, key, i) for i, key in enumerate(flags)])
    keys = rows.select(F.explode(named).alias("_key")).where("_key not like '-%'")
    repeated = keys.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    marked = rows
    for i, (key, flag) in enumerate(flags.items()):
        twice = repeated.select("_key", F.lit(True).alias(flag))
        marked = marked.withColumn("_key", _spread_key(rows, key, i)).join(twice, "_key", "left")
    return marked.drop("_key")


def draft_manifest(drafts: DataFrame, draft_columns: list[str]) -> DataFrame:
    """`complaint_id, summary_id, model, draft_sha256` with `errors` per draft.

    Blank ids or models and repeated ids are errors; `draft_sha256` is the hash
    of the draft's canonical JSON.
    """
    items = drafts.select(
        *[strip(F.col(c).cast("string")).alias(c) for c in ("complaint_id", "summary_id", "model")],
        F.sha2(canonical_json(draft_columns), 256).alias("draft_sha256"),
    )
    marked = _with_repeats(items, _TWICE)
    blank = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(c), F.lit("")) == "" for c in ("complaint_id", "summary_id", "model")],
    )
    repeated = F.col("_twice_case").isNotNull() | F.col("_twice_summary").isNotNull()
    return marked.withColumn(
        "errors",
        F.array_compact(
            F.array(F.when(blank, F.lit("blank_field")), F.when(repeated, F.lit("repeated_id")))
        ),
    ).select("complaint_id", "summary_id", "model", "draft_sha256", "errors")


def require_clean(rows: DataFrame) -> DataFrame:
    """The rows without `errors`; the job fails on the first row that has some."""
    failure = F.raise_error(F.concat_ws(", ", F.lit("rejected row"), "errors")).cast("boolean")
    return rows.where(F.when(F.size("errors") > 0, failure).otherwise(F.lit(True))).drop("errors")


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _filled(name: str, longest: int) -> Column:
    """Non-blank, short enough and free of control characters."""
    value = _text(name)
    return (value != "") & (F.length(value) <= longest) & ~value.rlike(r"[\x00-\x1f]")


def _flag(name: str) -> Column:
    return F.lower(_text(name))


def validate_review_rows(
    worksheet: DataFrame, sample: DataFrame, manifest: DataFrame
) -> DataFrame:
    """Worksheet rows with `errors`: the names of the rules each row breaks.

    `sample` has `complaint_id, month, product`; `manifest` has the draft
    bindings. Accepted values come typed under the review table's names.
    """
    rows = worksheet.withColumns({c: _text(c) for c in WORKSHEET_COLUMNS})
    frozen = sample.select(
        "complaint_id", F.col("month").alias("_month"), F.col("product").alias("_product")
    )
    bound = manifest.select(
        "complaint_id",
        F.col("summary_id").alias("_summary_id"),
        "model",
        "draft_sha256",
        "review_manifest_sha256",
    )
    marked = _with_repeats(rows, _TWICE).withColumn("_key", _spread_key(rows, "complaint_id"))
    known = frozen.join(bound, "complaint_id", "full")
    known = known.withColumn("_key", F.concat(F.lit("0:"), "complaint_id")).drop("complaint_id")
    joined = marked.join(known, "_key", "left")
    score = F.col("factuality_score_1_to_5")
    flags = ("all_claims_supported", "quotes_exact", "included_in_review_sample")
    rules = {
        "complaint_id": _filled("complaint_id", ID_LENGTH),
        "not_in_sample": F.col("_month").isNotNull(),
        "repeated_complaint_id": F.col("_twice_case").isNull(),
        "month": _filled("month", MONTH_LENGTH),
        "product": _filled("product", ID_LENGTH),
        "stratum_mismatch": (F.col("month") == F.col("_month"))
        & (F.col("product") == F.col("_product")),
        "summary_id": _filled("summary_id", ID_LENGTH),
        "summary_not_bound": F.col("summary_id") == F.col("_summary_id"),
        "repeated_summary_id": F.col("_twice_summary").isNull(),
        "reviewer_id": _filled("reviewer_id", REVIEWER_LENGTH[1])
        & (F.length(_text("reviewer_id")) >= REVIEWER_LENGTH[0]),
        "factuality_score": score.isin(*[str(s) for s in SCORES]),
        **{name: _flag(name).isin("true", "false") for name in flags},
    }
    errors = F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]
        )
    )
    return joined.withColumn("errors", errors).select(
        "summary_id",
        "reviewer_id",
        score.try_cast("int").alias("factuality_score"),
        *[(_flag(name) == "true").alias(name) for name in flags],
        *BINDING,
        "errors",
    )


def merge_reviews(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every stored and incoming review once, with an `action` per row.

    `kept` rows are untouched, `bound` rows had no lineage yet and receive it,
    `inserted` rows are new, `already_reviewed` and `conflict` rows stop a load.
    """
    fields = [c for c in stored.columns if c != "summary_id"]
    old = stored.select("summary_id", F.struct(*fields).alias("old"))
    new = incoming.select(
        "summary_id", F.struct(*[F.col(c) for c in incoming.columns if c != "summary_id"]).alias("new")
    )
    both = old.join(new, "summary_id", "full_outer")
    clash = reduce(
        lambda a, b: a | b,
        [
            F.col(f"old.{c}").isNotNull() & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
            for c in BINDING
        ],
    )
    action = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(F.col("old.review_manifest_sha256").isNotNull(), "already_reviewed")
        .when(clash, "conflict")
        .otherwise("bound")
    )
    given = set(incoming.columns)

    def value(name: str) -> Column:
        kind = stored.schema[name].dataType
        fresh = F.col(f"new.{name}").cast(kind) if name in given else F.lit(None).cast(kind)
        if name in BINDING:
            # Lineage comes from the incoming row unless the stored row is left alone.
            replace = F.col("action").isin("inserted", "bound")
        else:
            replace = F.col("action") == "inserted"
        return F.when(replace, fresh).otherwise(F.col(f"old.{name}")).alias(name)

    return both.withColumn("action", action).select(
        "summary_id", *[value(name) for name in fields], "action"
    )


def require_mergeable(merged: DataFrame) -> DataFrame:
    """The next version of the review table; a refused row fails the job."""
    refused = F.col("action").isin("already_reviewed", "conflict")
    failure = F.raise_error(
        F.concat_ws(" ", F.lit("review refused:"), F.col("action"), F.col("summary_id"))
    ).cast("boolean")
    return merged.where(F.when(refused, failure).otherwise(F.lit(True))).drop("action")


def factuality_metrics(reviews: DataFrame, expected: int | None = None) -> DataFrame:
    """One row over the included reviews, with the review status."""
    included = reviews.where(F.col("included_in_review_sample"))
    bound = F.col("review_manifest_sha256").isNotNull()
    # Models are few: they deduplicate on the map side.
    models = included.select("model").where(F.col("model").isNotNull()).distinct()
    row = included.agg(
        F.count("*").alias("reviewed_sample_count"),
        F.avg(F.col("factuality_score").cast("double")).alias("mean_factuality_score"),
        F.avg(F.col("all_claims_supported").cast("double")).alias("all_claims_supported_rate"),
        F.avg(F.col("quotes_exact").cast("double")).alias("exact_quote_rate"),
        count_where(bound).alias("lineage_bound_review_count"),
        F.min("review_manifest_sha256").alias("review_manifest_sha256"),
    )
    count = F.col("reviewed_sample_count")
    status = F.when(count == 0, STATUS_NONE)
    if expected is not None:
        status = status.when(count < expected, STATUS_PARTIAL)
    return row.withColumn(
        "distinct_reviewed_models", models.agg(F.count("*").alias("n")).scalar()
    ).withColumn("status", status.otherwise(STATUS_DONE))


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Included reviews per score 1 to 5, zeros included."""
    counts = (
        reviews.where(F.col("included_in_review_sample"))
        .groupBy(F.col("factuality_score").alias("score"))
        .agg(F.count("*").alias("n"))
    )
    scores = reviews.sparkSession.range(SCORES.start, SCORES.stop).select(
        F.col("id").cast("int").alias("score")
    )
    return scores.join(counts, "score", "left").select(
        "score", F.coalesce("n", F.lit(0)).alias("count")
    )


def reconcile_scores(distribution: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: whether the distribution and the metrics agree with each other."""
    sums = distribution.agg(
        F.sum("count").alias("n"), F.sum(F.col("score") * F.col("count")).alias("weighted")
    )
    m = metrics.select(
        F.struct(
            "reviewed_sample_count",
            "lineage_bound_review_count",
            "mean_factuality_score",
            "all_claims_supported_rate",
            "exact_quote_rate",
        )
    ).scalar()
    mean = m.getField("mean_factuality_score")
    expected = ratio(F.col("weighted"), F.col("n"))
    slack = F.greatest(F.lit(1e-9), F.lit(1e-9) * F.greatest(F.abs(mean), F.abs(expected)))
    reviewed = m.getField("reviewed_sample_count")

    def rate(name: str) -> Column:
        return m.getField(name).between(0.0, 1.0)

    checks = {
        "has_reviews": reviewed >= 1,
        "counts_add_up": F.col("n") == reviewed,
        "all_bound": m.getField("lineage_bound_review_count") == reviewed,
        "mean_matches": (F.abs(mean - expected) <= slack) & mean.between(1.0, 5.0),
        "rates_in_range": rate("all_claims_supported_rate") & rate("exact_quote_rate"),
    }
    return sums.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
