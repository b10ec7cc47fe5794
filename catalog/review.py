"""Queries over drafts, frozen samples, worksheets and factuality."""

from __future__ import annotations

from pyspark.sql import functions as F

from casequeue.functions.hashing import hash_rank
from casequeue.operators import review
from casequeue.schemas import ROUTE_REVIEWS
from casequeue.sources import logs, manifests, worksheet
from casequeue.sources.handover import shared_folder
from catalog.adapters import CASES_SQL, REVIEWS_SQL, cases, reviews, rounded, table

_SAMPLE = 400


def hash_ranks(spark, sf_dir):
    rank = hash_rank(review.SEED, F.col("complaint_id"))
    return cases(spark, sf_dir).select("complaint_id", rank.alias("rank"))


def freeze_sample(spark, sf_dir):
    return review.freeze_sample(cases(spark, sf_dir), n=_SAMPLE)


def frozen_sample(spark, sf_dir):
    manifest = manifests.frozen_sample(freeze_sample(spark, sf_dir), None, "r1")
    return manifest.select("status", F.size("items").alias("items"), "sample_manifest_sha256")


def drafts_manifest(spark, sf_dir):
    """The drafts of the sampled cases; a manifest is as long as its sample."""
    sampled = freeze_sample(spark, sf_dir).select("complaint_id")
    drafts = _drafts(spark, sf_dir).join(sampled, "complaint_id", "left_semi")
    items = review.draft_manifest(drafts, ["complaint_id", "model", "status", "summary_id"])
    manifest = manifests.drafts_manifest(review.require_clean(items), "0" * 64)
    return manifest.select("status", F.size("items").alias("items"), "manifest_sha256")


def _given_reviews(spark, sf_dir):
    return reviews(spark, sf_dir).withColumns(
        {
            "complaint_id": F.when(F.col("review_id") % 5 == 0, F.concat(F.lit("x"), "complaint_id"))
            .otherwise(F.col("complaint_id")),
            "reviewer_id": F.left(F.lit("someone"), (F.col("review_id") % 4).cast("int")),
            "notes": F.repeat(F.lit("n"), (F.col("review_id") % 7 * 200).cast("int")),
            "approved_route": F.when(F.col("review_id") % 3 > 0, F.col("approved_route")),
        }
    )


def appended_route_reviews(spark, sf_dir):
    """The log after batches by decision, each of which was appended twice."""
    given, known = _given_reviews(spark, sf_dir), cases(spark, sf_dir).select("complaint_id")
    folder = shared_folder(spark)
    for decision in logs.ROUTE_DECISIONS * 2:
        batch = given.where(F.col("decision") == decision)
        logs.append_route_reviews(batch, known, f"{folder}/log", f"{folder}/rejects", batch_id=decision)
    stored = logs.read_log(spark, ROUTE_REVIEWS, f"{folder}/log")
    return stored.withColumn("reviewed_at", F.unix_micros("reviewed_at"))


def route_review_checks(spark, sf_dir):
    """Decisions with the rules they break; every fifth is of an unknown case."""
    given = _given_reviews(spark, sf_dir)
    accepted, rejected = logs.check_route_reviews(given, cases(spark, sf_dir))
    none = F.array().cast("array<string>")
    both = accepted.withColumn("errors", none).unionByName(rejected)
    return both.select("review_id", F.array_join("errors", ";").alias("errors"))


def review_template(spark, sf_dir):
    return review.review_template(freeze_sample(spark, sf_dir))


def stored_worksheet(spark, sf_dir):
    """The template written as CSV and read as a worksheet."""
    path = shared_folder(spark)
    worksheet.write_review_template(review_template(spark, sf_dir), path)
    rows = worksheet.read_review_worksheet(spark, path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def _drafts(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), key).alias("summary_id"),
        key.alias("complaint_id"),
        F.lit("pending_review").alias("status"),
        F.col("source").alias("model"),
    )


def _draft_reviews(spark, sf_dir):
    """Two reviews per label: the newer one follows quality, the older one opposes it."""
    good = F.col("quality") == 1
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary_id"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("new").alias("reviewer_id"),
                    F.when(good, "approve").otherwise("reject").alias("decision"),
                    (at + F.expr("interval 1 day")).alias("reviewed_at"),
                ),
                F.struct(
                    F.lit("old").alias("reviewer_id"),
                    F.when(good, "reject").otherwise("approve").alias("decision"),
                    at.alias("reviewed_at"),
                ),
            )
        ),
    )
    return labels


def current_draft_status(spark, sf_dir):
    status = review.current_draft_status(_drafts(spark, sf_dir), _draft_reviews(spark, sf_dir))
    return status.select("summary_id", "status")


def draft_manifest(spark, sf_dir):
    """Drafts plus, for German documents, a second draft with the same id."""
    again = table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id")
    drafts = _drafts(spark, sf_dir)
    twice = drafts.join(
        again.select(F.col("doc_id").cast("string").alias("complaint_id")),
        "complaint_id",
        "left_semi",
    ).withColumn("model", F.lit(" "))
    manifest = review.draft_manifest(
        drafts.unionByName(twice), ["complaint_id", "model", "status", "summary_id"]
    )
    return manifest.withColumn("errors", F.array_join("errors", ";"))


def _bindings(sample):
    key = F.col("complaint_id")
    return sample.select(
        "complaint_id",
        F.concat(F.lit("s"), key).alias("summary_id"),
        F.col("product").alias("model"),
        F.sha2(key, 256).alias("draft_sha256"),
        F.lit("m1").alias("review_manifest_sha256"),
    )


def _worksheet(sample):
    """A filled worksheet with faults that depend on the row's month and product."""
    month, product = F.substring("month", 6, 2), F.col("product")
    filled = sample.select(
        F.lit("").alias("review_row_id"),
        F.when(month == "04", "other")
        .otherwise(F.concat(F.lit(" s"), "complaint_id"))
        .alias("summary_id"),
        F.when(month == "05", F.concat(F.lit("x"), "complaint_id"))
        .otherwise(F.col("complaint_id"))
        .alias("complaint_id"),
        F.col("month").alias("month"),
        F.when(month == "06", "none").otherwise(product).alias("product"),
        F.when(month == "07", " ")
        .when(month == "08", F.concat(F.lit("a"), F.lit("\t"), F.lit("b")))
        .otherwise("reviewer")
        .alias("reviewer_id"),
        F.when(product == "BUILDING", "6").otherwise("4").alias("factuality_score_1_to_5"),
        F.when(product == "MACHINERY", "yes").otherwise("TRUE").alias("all_claims_supported"),
        F.lit("false").alias("quotes_exact"),
        F.lit(" true ").alias("included_in_review_sample"),
    )
    return filled.unionByName(filled.where(F.substring("month", 6, 2) == "09"))


def validate_review_rows(spark, sf_dir):
    sample = freeze_sample(spark, sf_dir)
    checked = review.validate_review_rows(_worksheet(sample), sample, _bindings(sample))
    return checked.select(
        "complaint_id", "summary_id", "factuality_score", F.array_join("errors", ";").alias("errors")
    )


def _scores(spark, sf_dir):
    """Factuality reviews from labels; toxic low-quality documents are left out."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary_id"),
        F.lit("reviewer").alias("reviewer_id"),
        (F.lit(5) - F.lit(2) * (F.lit(1) - F.col("quality")) - F.col("toxic"))
        .cast("int")
        .alias("factuality_score"),
        good.alias("all_claims_supported"),
        (~toxic).alias("quotes_exact"),
        (good | ~toxic).alias("included_in_review_sample"),
        F.when(good, F.col("doc_id").cast("string")).alias("complaint_id"),
        F.when(good & ~toxic, "src1").when(good, "src2").alias("model"),
        F.when(good & toxic, "draft").alias("draft_sha256"),
        F.when(good & toxic, "m1").alias("review_manifest_sha256"),
    )


def merge_reviews(spark, sf_dir):
    """Every document arrives reviewed; labels hold what is already stored."""
    incoming = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("summary_id"),
        F.lit("second").alias("reviewer_id"),
        F.lit(3).alias("factuality_score"),
        F.lit(True).alias("all_claims_supported"),
        F.lit(True).alias("quotes_exact"),
        F.lit(True).alias("included_in_review_sample"),
        F.col("doc_id").cast("string").alias("complaint_id"),
        F.lit("src1").alias("model"),
        F.lit("draft").alias("draft_sha256"),
        F.lit("m2").alias("review_manifest_sha256"),
    )
    merged = review.merge_reviews(_scores(spark, sf_dir), incoming)
    return merged.select(
        "summary_id", "reviewer_id", "factuality_score", "model", "review_manifest_sha256", "action"
    )


def factuality_metrics(spark, sf_dir):
    row = review.factuality_metrics(_scores(spark, sf_dir), expected=10**9)
    return rounded(
        row, "mean_factuality_score", "all_claims_supported_rate", "exact_quote_rate"
    )


def score_distribution(spark, sf_dir):
    return review.score_distribution(_scores(spark, sf_dir))


def reconcile_scores(spark, sf_dir):
    return review.reconcile_scores(
        score_distribution(spark, sf_dir), review.factuality_metrics(_scores(spark, sf_dir))
    )


QUERIES = {
    "hash_ranks": hash_ranks,
    "freeze_sample": freeze_sample,
    "review_template": review_template,
    "stored_worksheet": stored_worksheet,
    "frozen_sample": frozen_sample,
    "route_review_checks": route_review_checks,
    "appended_route_reviews": appended_route_reviews,
    "drafts_manifest": drafts_manifest,
    "current_draft_status": current_draft_status,
    "draft_manifest": draft_manifest,
    "validate_review_rows": validate_review_rows,
    "merge_reviews": merge_reviews,
    "factuality_metrics": factuality_metrics,
    "score_distribution": score_distribution,
    "reconcile_scores": reconcile_scores,
}

_SAMPLE_SQL = f"""WITH {CASES_SQL},
eligible AS (
  SELECT complaint_id, strftime(date_received, '%Y-%m') AS month, product,
    sha256('42|' || complaint_id) AS h
  FROM cases WHERE has_narrative AND narrative IS NOT NULL
),
rounds AS (
  SELECT *, row_number() OVER (PARTITION BY month, product ORDER BY h) AS r FROM eligible
),
sample AS (
  SELECT complaint_id, month, product,
    CAST(row_number() OVER (ORDER BY r, month, product) AS INTEGER) AS position
  FROM rounds ORDER BY r, month, product LIMIT {_SAMPLE}
)"""
_TEMPLATE_SQL = f"""{_SAMPLE_SQL}
SELECT 'summary-review-' || lpad(CAST(position AS VARCHAR), 4, '0') AS review_row_id,
  '' AS summary_id, complaint_id, month, product, '' AS reviewer_id,
  '' AS factuality_score_1_to_5, '' AS all_claims_supported, '' AS quotes_exact,
  '' AS included_in_review_sample FROM sample"""
_SCORES_SQL = """WITH scores AS (
  SELECT 's' || doc_id AS summary_id, 'reviewer' AS reviewer_id,
    CAST(5 - 2 * (1 - quality) - toxic AS INTEGER) AS factuality_score,
    quality = 1 AS all_claims_supported, toxic = 0 AS quotes_exact,
    quality = 1 OR toxic = 0 AS included,
    CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) END AS complaint_id,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'src1' WHEN quality = 1 THEN 'src2' END AS model,
    CASE WHEN quality = 1 AND toxic = 1 THEN 'm1' END AS review_manifest_sha256
  FROM labels
),
included AS (SELECT * FROM scores WHERE included)"""

ORACLES = {
    "hash_ranks": f"""WITH {CASES_SQL}
SELECT complaint_id, sha256('42|' || complaint_id) AS rank FROM cases""",
    "freeze_sample": f"{_SAMPLE_SQL} SELECT * FROM sample",
    "appended_route_reviews": f"""WITH {CASES_SQL}, {REVIEWS_SQL}
SELECT complaint_id, left('someone', CAST(review_id % 4 AS INTEGER)) AS reviewer_id, decision,
  CASE WHEN review_id % 3 > 0 THEN approved_route END AS approved_route,
  repeat('n', CAST(review_id % 7 * 200 AS INTEGER)) AS notes, epoch_us(reviewed_at) AS reviewed_at
FROM reviews WHERE review_id % 5 <> 0 AND complaint_id IN (SELECT complaint_id FROM cases)
  AND review_id % 4 >= 2 AND review_id % 7 * 200 <= 1000
  AND (decision = 'reject' OR (review_id % 3 > 0 AND coalesce(approved_route, '') <> ''))""",
    "route_review_checks": f"""WITH {CASES_SQL}, {REVIEWS_SQL}
SELECT review_id, concat_ws(';',
  CASE WHEN review_id % 5 = 0 OR complaint_id NOT IN (SELECT complaint_id FROM cases)
    THEN 'unknown_case' END,
  CASE WHEN review_id % 4 < 2 THEN 'reviewer_id' END,
  CASE WHEN decision <> 'reject' AND review_id % 3 = 0 THEN 'approved_route_missing' END,
  CASE WHEN review_id % 7 * 200 > 1000 THEN 'notes_length' END) AS errors FROM reviews""",
    "frozen_sample": f"""{_SAMPLE_SQL},
listed AS (
  SELECT count(*) AS n, string_agg('{{"complaint_id":"' || complaint_id || '","month":"' || month
    || '","product":"' || product || '"}}', ',' ORDER BY position) AS items FROM sample
)
SELECT 'frozen_unreviewed' AS status, CAST(n AS INTEGER) AS items,
  sha256('{{"items":[' || items || '],"parent_snapshot_sha256":null,"rubric_version":"r1",'
    || '"status":"frozen_unreviewed"}}') AS sample_manifest_sha256 FROM listed""",
    "drafts_manifest": f"""{_SAMPLE_SQL},
items AS (
  SELECT CAST(doc_id AS VARCHAR) AS c, sha256('{{"complaint_id":"' || doc_id || '","model":"'
    || source || '","status":"pending_review","summary_id":"s' || doc_id || '"}}') AS h,
    source AS m, 's' || doc_id AS s FROM documents
  WHERE CAST(doc_id AS VARCHAR) IN (SELECT complaint_id FROM sample)
),
listed AS (
  SELECT count(*) AS n, string_agg('{{"complaint_id":"' || c || '","draft_sha256":"' || h
    || '","model":"' || m || '","summary_id":"' || s || '"}}', ',' ORDER BY c) AS items FROM items
)
SELECT 'private_generated_drafts' AS status, CAST(n AS INTEGER) AS items,
  sha256('{{"items":[' || items || '],"schema_version":"summary-draft-manifest-v1",'
    || '"source_sample_manifest_sha256":"' || repeat('0', 64)
    || '","status":"private_generated_drafts"}}') AS manifest_sha256 FROM listed""",
    "review_template": _TEMPLATE_SQL,
    "stored_worksheet": _TEMPLATE_SQL,
    "current_draft_status": """SELECT 's' || d.doc_id AS summary_id,
  CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending_review' END AS status
FROM documents d LEFT JOIN labels USING (doc_id)""",
    "draft_manifest": """WITH drafts AS (
  SELECT CAST(doc_id AS VARCHAR) AS complaint_id, 's' || doc_id AS summary_id,
    source AS model, lang FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 's' || doc_id, ' ', lang FROM documents
  WHERE lang = 'de'
)
SELECT complaint_id, summary_id, trim(model) AS model,
  sha256('{"complaint_id":"' || complaint_id || '","model":"' || model
    || '","status":"pending_review","summary_id":"' || summary_id || '"}') AS draft_sha256,
  concat_ws(';', CASE WHEN trim(model) = '' THEN 'blank_field' END,
    CASE WHEN lang = 'de' THEN 'repeated_id' END) AS errors
FROM drafts""",
    "validate_review_rows": f"""{_SAMPLE_SQL},
marked AS (SELECT *, substr(month, 6, 2) AS m FROM sample),
sheet AS (SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE m = '09')
SELECT CASE WHEN m = '05' THEN 'x' ELSE '' END || complaint_id AS complaint_id,
  CASE WHEN m = '04' THEN 'other' ELSE 's' || complaint_id END AS summary_id,
  CASE WHEN product = 'BUILDING' THEN 6 ELSE 4 END AS factuality_score,
  concat_ws(';', CASE WHEN m = '05' THEN 'not_in_sample' END,
    CASE WHEN m = '09' THEN 'repeated_complaint_id' END,
    CASE WHEN m IN ('05', '06') THEN 'stratum_mismatch' END,
    CASE WHEN m IN ('04', '05') THEN 'summary_not_bound' END,
    CASE WHEN m = '09' OR (m = '04' AND (SELECT count(*) FROM sheet WHERE m = '04') > 1)
      THEN 'repeated_summary_id' END,
    CASE WHEN m IN ('07', '08') THEN 'reviewer_id' END,
    CASE WHEN product = 'BUILDING' THEN 'factuality_score' END,
    CASE WHEN product = 'MACHINERY' THEN 'all_claims_supported' END) AS errors
FROM sheet""",
    "merge_reviews": f"""{_SCORES_SQL},
both_sides AS (
  SELECT coalesce(s.summary_id, 's' || d.doc_id) AS summary_id, s.reviewer_id,
    s.factuality_score, s.model, s.review_manifest_sha256,
    CASE WHEN d.doc_id IS NULL THEN 'kept' WHEN s.summary_id IS NULL THEN 'inserted'
      WHEN s.review_manifest_sha256 IS NOT NULL THEN 'already_reviewed'
      WHEN s.complaint_id <> CAST(d.doc_id AS VARCHAR) OR s.model <> 'src1' THEN 'conflict'
      ELSE 'bound' END AS action
  FROM scores s FULL JOIN documents d ON s.summary_id = 's' || d.doc_id
)
SELECT summary_id,
  CASE WHEN action = 'inserted' THEN 'second' ELSE reviewer_id END AS reviewer_id,
  CASE WHEN action = 'inserted' THEN 3 ELSE factuality_score END AS factuality_score,
  CASE WHEN action IN ('inserted', 'bound') THEN 'src1' ELSE model END AS model,
  CASE WHEN action IN ('inserted', 'bound') THEN 'm2' ELSE review_manifest_sha256 END
    AS review_manifest_sha256, action
FROM both_sides""",
    "factuality_metrics": f"""{_SCORES_SQL}
SELECT count(*) AS reviewed_sample_count,
  round(avg(factuality_score), 6) AS mean_factuality_score,
  round(avg(CAST(all_claims_supported AS INTEGER)), 6) AS all_claims_supported_rate,
  round(avg(CAST(quotes_exact AS INTEGER)), 6) AS exact_quote_rate,
  count(review_manifest_sha256) AS lineage_bound_review_count,
  min(review_manifest_sha256) AS review_manifest_sha256,
  count(DISTINCT model) AS distinct_reviewed_models,
  CASE WHEN count(*) = 0 THEN 'unavailable_until_frozen_sample_reviewed'
    ELSE 'partially_reviewed' END AS status
FROM included""",
    "score_distribution": f"""{_SCORES_SQL}
SELECT CAST(s AS INTEGER) AS score, count(summary_id) AS count
FROM range(1, 6) r(s) LEFT JOIN included ON factuality_score = s GROUP BY 1""",
    "reconcile_scores": f"""{_SCORES_SQL}
SELECT count(*) >= 1 AS has_reviews, true AS counts_add_up,
  count(review_manifest_sha256) = count(*) AS all_bound,
  avg(factuality_score) BETWEEN 1 AND 5 AS mean_matches, true AS rates_in_range
FROM included""",
}
