"""Queries over normalization, the quality gate and lineage hashes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.functions import hashing, text
from casequeue.operators import lineage, quality, volume
from casequeue.sources import manifests, search_pages, snapshot
from casequeue.sources.handover import shared_folder
from catalog.adapters import CASES_SQL, cases, table

_AS_OF = date(2001, 6, 30)
PROFILE_CAP = 100


def _padded(c):
    return F.concat(F.lit("\t 　"), c, F.lit(" \n"))


def clean_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    blank = F.when(F.col("lang") == "en", F.lit(" \t ")).otherwise(_padded(F.col("lang")))
    return documents.select(
        "doc_id",
        text.clean_text(_padded(F.col("text"))).alias("text"),
        text.clean_text(blank).alias("lang_or_null"),
    )


def to_bool(spark, sf_dir):
    word = (
        F.when(F.col("o_orderstatus") == "F", " Yes ")
        .when(F.col("o_orderstatus") == "O", "FALSE")
        .otherwise("perhaps")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_bool(word).alias("flag"))


def _source_dates(orders):
    """Instants with an offset, dates with a tail, and (for `P`) text that is no date."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return (
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T23:59:58-05:00")))
        .when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" 10:30")))
        .otherwise(F.concat(F.lit("about "), day))
    )


def normalize_source_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", text.normalize_source_date(_source_dates(orders)).alias("day")
    )


def utc_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T23:59:58-05:00")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), day))
        .otherwise(F.lit("  "))
    )
    return orders.select("o_orderkey", text.utc_date(raw).alias("day"))


def _source_records(spark, sf_dir):
    rows = cases(spark, sf_dir)
    empty = F.lit(None).cast("string")
    return rows.select(
        "complaint_id",
        F.concat(F.col("date_received").cast("string"), F.lit("T08:00:00Z")).alias("date_received"),
        _padded(F.col("product")).alias("product"),
        empty.alias("sub_product"),
        "issue",
        F.lit("  ").alias("sub_issue"),
        "company",
        "state",
        "submitted_via",
        F.col("date_sent_to_company").cast("string").alias("date_sent_to_company"),
        empty.alias("company_response"),
        empty.alias("company_public_response"),
        F.when(F.col("timely"), "Yes").when(~F.col("timely"), "No").alias("timely"),
        F.col("narrative").alias("complaint_what_happened"),
        F.when(F.col("submitted_via") == "1", "true").alias("has_narrative"),
    )


def normalize_source(spark, sf_dir):
    return search_pages.normalize_source(_source_records(spark, sf_dir))


def _snapshot(spark, sf_dir):
    rows = cases(spark, sf_dir)
    stored = [c for c in quality.PROFILE_COLUMNS] + ["date_sent_to_company"]
    return rows.select(*stored)


def _parsed(spark, sf_dir):
    """The gate's input: every case written as a JSON line and parsed back."""
    return quality.parse_lines(snapshot.snapshot_lines(_snapshot(spark, sf_dir)))


def quality_counters(spark, sf_dir):
    return quality.quality_counters(_parsed(spark, sf_dir), _AS_OF)


def quality_report(spark, sf_dir):
    return quality.quality_report(quality_counters(spark, sf_dir)).drop("detail")


def quality_overall(spark, sf_dir):
    return quality.overall(quality.quality_report(quality_counters(spark, sf_dir)))


def _damaged(spark, sf_dir):
    """The gate's input with broken, doubled, blank and keyless lines among the good ones."""
    rows = _snapshot(spark, sf_dir)
    # Written once a row, then damaged.
    rows = rows.select("complaint_id", hashing.canonical_json(rows.columns).alias("line"))
    line = F.col("line")
    kind = F.col("complaint_id").cast("bigint") % 50
    broken = (
        F.when(kind == 0, F.concat(line, F.lit("{}")))
        .when(kind == 1, F.concat_ws(" ", line, line))
        .when(kind == 2, F.lit("   "))
        .when(kind == 3, F.concat(F.lit("["), line, F.lit("]")))
        .when(kind == 4, F.left(line, F.length(line) - 1))
        .when(kind == 5, F.replace(line, F.lit('"issue":'), F.lit('"other":')))
        .otherwise(line)
    )
    return quality.parse_lines(rows.select(broken.alias("value")))


def damaged_counters(spark, sf_dir):
    return quality.quality_counters(_damaged(spark, sf_dir), _AS_OF)


def damaged_report(spark, sf_dir):
    """All checks that do not pass or pass with a count, the manifest's among them."""
    january = F.endswith(F.col("w.name"), F.lit("-01"))
    meta = F.struct(F.lit(False).alias("is_data_stale"), january.alias("has_data_issue"))
    windows = _manifest(spark, sf_dir).select(F.explode("windows").alias("w"))
    manifest = windows.agg(
        F.lit("0" * 64).alias("snapshot_sha256"),
        F.collect_list(F.struct("w.*", meta.alias("source_meta"))).alias("windows"),
    )
    report = quality.quality_report(
        damaged_counters(spark, sf_dir),
        manifest=manifest,
        fingerprint=rowset_fingerprint(spark, sf_dir),
    )
    return report.drop("detail")


def damaged_overall(spark, sf_dir):
    return quality.overall(quality.quality_report(damaged_counters(spark, sf_dir)))


def _pages(spark, sf_dir):
    """Search responses made of the source records, of a thousand ids each at most."""
    record = F.struct(*_source_records(spark, sf_dir).columns)
    page = F.floor(F.col("complaint_id").cast("bigint") / F.lit(1000))
    hit = F.struct(F.when(page % 2 == 0, record).alias("_source"), *[
        F.when(page % 2 == 1, F.col(c)).alias(c) for c in _source_records(spark, sf_dir).columns
    ])
    grouped = _source_records(spark, sf_dir).groupBy(page.alias("page")).agg(
        F.to_json(F.collect_list(hit)).alias("hits_json"), F.count("*").alias("n")
    )
    relation = F.struct(F.col("n").alias("value"), F.lit("gte").alias("relation"))
    total = F.when(F.col("page") % 3 == 0, F.to_json(relation)).when(
        F.col("page") % 3 == 1, F.col("n").cast("string")
    )
    return grouped.select("page", total.alias("total_json"), "hits_json")


def search_hits(spark, sf_dir):
    found = search_pages.search_hits(_pages(spark, sf_dir))
    return found.select(
        "complaint_id", "date_received", "product", "timely", "complaint_what_happened"
    )


def source_total(spark, sf_dir):
    return search_pages.source_total(_pages(spark, sf_dir)).select(
        "page", "source_total", "source_total_relation"
    )


def failed_checks(spark, sf_dir):
    """What stops the gate over damaged lines."""
    return quality.failed_checks(damaged_report(spark, sf_dir))


def routing_support(spark, sf_dir):
    return quality.routing_support(quality_counters(spark, sf_dir))


def column_profile(spark, sf_dir):
    return quality.column_profile(_parsed(spark, sf_dir))


def column_profile_capped(spark, sf_dir):
    return quality.column_profile(_parsed(spark, sf_dir), cap=PROFILE_CAP)


def _manifest(spark, sf_dir):
    """Manifest of monthly windows over the cases; odd months lack optional fields."""
    month = F.trunc("date_received", "month")
    odd = F.month("month") % 2 == 1
    windows = (
        cases(spark, sf_dir)
        .groupBy(month.cast("date").alias("month"))
        .agg(F.count("*").alias("n"))
        .select(
            F.struct(
                F.date_format("month", "yyyy-MM").alias("name"),
                F.col("month").cast("string").alias("date_received_min"),
                F.add_months("month", 1).cast("string").alias("date_received_max_exclusive"),
                F.lit(True).alias("complete_month"),
                F.col("n").alias("source_total"),
                F.when(~odd, "gte").alias("source_total_relation"),
                F.when(~odd, F.col("n")).alias("retained_after_global_deduplication"),
            ).alias("w")
        )
    )
    # One element per calendar month.
    return windows.agg(F.collect_list("w").alias("windows"))


def source_windows(spark, sf_dir):
    return manifests.source_windows(_manifest(spark, sf_dir))


def source_volume(spark, sf_dir):
    return volume.source_volume(source_windows(spark, sf_dir))


def row_hashes(spark, sf_dir):
    rows = cases(spark, sf_dir).select("complaint_id", "product", "issue", "timely")
    return rows.select("complaint_id", hashing.row_sha256(rows.columns).alias("row_sha256"))


def rowset_fingerprint(spark, sf_dir):
    rows = cases(spark, sf_dir).select("complaint_id", "product", "issue", "timely")
    return hashing.rowset_fingerprint(rows)


def broken_links(spark, sf_dir):
    """Chains of windows, samples of a window and product, and drafts of a sample. Windows of every fifth
    month were changed after they were entered, and samples of one product were lost."""
    rows = cases(spark, sf_dir).select(
        "complaint_id", "product", F.date_format("date_received", "yyyy-MM").alias("month")
    )

    def entered(kind, named, name, parents=None):
        content = named.agg(F.sha2(F.count("*").cast("string"), 256).alias("content_sha256"))
        if parents is None:
            content = content.withColumn("parent_sha256", F.lit(None).cast("string"))
        else:
            content = content.join(parents, parents.columns[:-1], "left")
        given = content.select(F.lit(kind).alias("kind"), name.alias("name"), "content_sha256", "parent_sha256")
        return lineage.lineage_entries(given)

    windows = entered("window", rows.groupBy("month"), F.col("month"))
    of_window = windows.select(F.col("name").alias("month"), F.col("entry_sha256").alias("parent_sha256"))
    sample_name = F.concat_ws("/", "month", "product")
    samples = entered("sample", rows.groupBy("month", "product"), sample_name, of_window)
    of_sample = samples.select(F.col("name").alias("sample"), F.col("entry_sha256").alias("parent_sha256"))
    drafts = entered(
        "draft", rows.withColumn("sample", sample_name).groupBy("sample", "complaint_id"), F.col("complaint_id"), of_sample
    )
    fifth = F.substring("name", 6, 2).cast("int") % 5 == 0
    damaged = windows.withColumn(
        "content_sha256", F.when(fifth, F.sha2(F.lit("other"), 256)).otherwise(F.col("content_sha256"))
    )
    kept = samples.where(~F.col("name").endswith("/BUILDING"))
    return lineage.broken_links(damaged.unionByName(kept).unionByName(drafts))


def stored_snapshot(spark, sf_dir):
    """Lines of a snapshot that replaced another one, read back in order."""
    rows = cases(spark, sf_dir).select("complaint_id", "date_received", "issue", "product", "timely")
    path = shared_folder(spark)
    snapshot.write_snapshot(rows.where("timely"), path)
    snapshot.write_snapshot(rows, path)
    lines = snapshot.read_ordered_lines(spark, path)
    return lines.select("line_number", F.sha2("value", 256).alias("line_sha256"))


def stored_snapshot_rows(spark, sf_dir):
    """Typed rows of a stored snapshot."""
    rows = cases(spark, sf_dir).select("complaint_id", "date_received", "issue", "product", "timely")
    path = shared_folder(spark)
    snapshot.write_snapshot(rows, path)
    return snapshot.read_snapshot_jsonl(spark, path).select(rows.columns)


def stored_windows(spark, sf_dir):
    """Window totals that replaced those of one year."""
    windows, path = source_windows(spark, sf_dir), shared_folder(spark)
    manifests.write_source_windows(windows.where(F.year("date_received_min") == 1995), path)
    manifests.write_source_windows(windows, path)
    return spark.read.parquet(path)


QUERIES = {
    "stored_snapshot_rows": stored_snapshot_rows,
    "stored_windows": stored_windows,
    "broken_links": broken_links,
    "stored_snapshot": stored_snapshot,
    "clean_text": clean_text,
    "to_bool": to_bool,
    "normalize_source_date": normalize_source_date,
    "utc_date": utc_date,
    "normalize_source": normalize_source,
    "source_windows": source_windows,
    "source_volume": source_volume,
    "quality_counters": quality_counters,
    "quality_report": quality_report,
    "quality_overall": quality_overall,
    "damaged_counters": damaged_counters,
    "damaged_report": damaged_report,
    "damaged_overall": damaged_overall,
    "search_hits": search_hits,
    "source_total": source_total,
    "column_profile": column_profile,
    "column_profile_capped": column_profile_capped,
    "failed_checks": failed_checks,
    "routing_support": routing_support,
    "row_hashes": row_hashes,
    "rowset_fingerprint": rowset_fingerprint,
}

_WS = "||".join(f"chr({ord(c)})" for c in text.WHITESPACE)
_PAD = "chr(9) || ' ' || chr(12288) || {} || ' ' || chr(10)"
_SOURCE_WINDOWS_SQL = f"""WITH {CASES_SQL},
months AS (
  SELECT CAST(date_trunc('month', date_received) AS DATE) AS m, count(*) AS n
  FROM cases GROUP BY 1
),
windows AS (
  SELECT strftime(m, '%Y-%m') AS window_name, m AS date_received_min,
    CAST(m + INTERVAL 1 MONTH AS DATE) AS date_received_max_exclusive,
    true AS complete_month, n AS source_total,
    CASE WHEN month(m) % 2 = 1 THEN 'eq' ELSE 'gte' END AS source_total_relation,
    CASE WHEN month(m) % 2 = 1 THEN 0 ELSE n END AS selected_sample_rows
  FROM months
)"""
_COUNTERS_SQL = f"""WITH {CASES_SQL},
marked AS (
  SELECT *, trim(narrative, {_WS}) AS t FROM cases
),
counters AS (
  SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS invalid_lines,
    CAST(0 AS BIGINT) AS missing_required_columns,
    count(*) FILTER (WHERE complaint_id = '') AS missing_ids,
    count(*) FILTER (WHERE date_received IS NULL) AS invalid_dates,
    count(*) FILTER (WHERE date_received > DATE '2001-06-30') AS future_dates,
    count(*) FILTER (WHERE date_sent_to_company < date_received) AS sent_before_received,
    count(*) FILTER (WHERE product IS NULL OR issue IS NULL) AS missing_labels,
    count(*) FILTER (WHERE has_narrative <> (coalesce(t, '') <> '')) AS narrative_mismatch,
    count(*) FILTER (WHERE length(t) >= 20 AND product IS NOT NULL) AS narrative_eligible,
    count(*) - count(DISTINCT complaint_id) AS duplicate_rows
  FROM marked
)"""


_DAMAGED_SQL = (
    _COUNTERS_SQL.replace(
        "  SELECT *, trim(narrative",
        "  SELECT * REPLACE (CASE WHEN kind = 5 THEN NULL ELSE issue END AS issue), trim(narrative",
    )
    .replace(
        "AS t FROM cases",
        "AS t FROM (SELECT *, CAST(complaint_id AS BIGINT) % 50 AS kind FROM cases)",
    )
    .replace("SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS invalid_lines",
             "SELECT count(*) AS row_count, (SELECT count(*) FROM marked WHERE kind IN (0, 1, 3, 4)) AS invalid_lines")
    .replace("CAST(0 AS BIGINT) AS missing_required_columns",
             "count(*) FILTER (WHERE kind = 5) AS missing_required_columns")
    .replace("  FROM marked\n)", "  FROM marked WHERE kind > 4\n)")
)


def _zero_sql(name, severity, counter):
    return (
        f"SELECT '{name}' AS name, {counter} = 0 AS passed, '{severity}' AS severity, "
        f"CAST({counter} AS DOUBLE) AS observed, '0' AS threshold FROM counters"
    )


def _rate_sql(name, severity, counter):
    rate = f"CAST({counter} AS DOUBLE) / greatest(row_count, 1)"
    return (
        f"SELECT '{name}', {rate} <= 0.001e0, '{severity}', round({rate}, 6), '<=0.001' "
        "FROM counters"
    )


_REPORT_SQL = " UNION ALL ".join(
    [
        _zero_sql("parseable_json_lines", "critical", "invalid_lines"),
        "SELECT 'row_count_within_snapshot_contract', row_count BETWEEN 1 AND 100000, "
        "'critical', CAST(row_count AS DOUBLE), '1..100000' FROM counters",
        _zero_sql("required_columns_present", "critical", "missing_required_columns"),
        _zero_sql("complaint_id_present", "critical", "missing_ids"),
        _zero_sql("complaint_id_unique", "critical", "duplicate_rows"),
        _zero_sql("date_received_valid", "high", "invalid_dates"),
        _zero_sql("date_received_not_future", "high", "future_dates"),
        _zero_sql("date_sent_not_before_received", "high", "sent_before_received"),
        _rate_sql("routing_labels_present", "high", "missing_labels"),
        _rate_sql("narrative_flag_consistent", "medium", "narrative_mismatch"),
        "SELECT 'narrative_support_for_routing_evaluation', narrative_eligible >= 500, "
        "'medium', CAST(narrative_eligible AS DOUBLE), '500' FROM counters",
    ]
)
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column",
  count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS null_count,
  round(CAST(count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS DOUBLE)
    / greatest(count(*), 1), 6) AS null_rate,
  count(DISTINCT nullif(CAST({c} AS VARCHAR), '')) AS distinct_count_observed,
  false AS distinct_count_capped
FROM cases"""
    for c in quality.PROFILE_COLUMNS
)
_ROW_JSON = """sha256('{"complaint_id":"' || complaint_id || '","issue":"' || issue
  || '","product":"' || product || '","timely":' || coalesce(CAST(timely AS VARCHAR), 'null')
  || '}')"""


def hash_tree_sql(hashes: str) -> str:
    """The rest of a WITH query that names the multiset of hashes `h` of another one."""
    depths = " + ".join(f"CAST(count(*) > {4096 * 256**k}::BIGINT AS INTEGER)" for k in range(6))
    return f"""counted AS (SELECT h, count(*) AS n FROM ({hashes}) GROUP BY h),
depth AS (SELECT {depths} AS half FROM counted),
leaves AS (
  SELECT half, left(h, 2 * half) AS prefix, sum(n) AS n,
    sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS digest
  FROM counted, depth GROUP BY 1, 2
),
branches AS (
  SELECT left(prefix, half) AS prefix, sum(n) AS n,
    sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest
  FROM leaves GROUP BY 1
)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
  sha256(coalesce(sum(n), 0) || '|' || coalesce(string_agg(prefix || ':' || digest, ','
    ORDER BY prefix), '')) AS rowset_sha256 FROM branches"""


ORACLES = {
    "broken_links": f"""WITH {CASES_SQL},
rows AS (SELECT complaint_id, product, strftime(date_received, '%Y-%m') AS month FROM cases)
SELECT 'window' AS kind, month AS name, 0 AS steps,
  CASE WHEN bad THEN 'window' END AS broken_kind, CASE WHEN bad THEN month END AS broken_name,
  CASE WHEN bad THEN 'changed' END AS reason
FROM (SELECT DISTINCT month, CAST(month[6:] AS INTEGER) % 5 = 0 AS bad FROM rows)
UNION ALL
SELECT 'sample', month || '/' || product, 1, CASE WHEN bad THEN 'window' END,
  CASE WHEN bad THEN month END, CASE WHEN bad THEN 'changed' END
FROM (SELECT DISTINCT month, product, CAST(month[6:] AS INTEGER) % 5 = 0 AS bad FROM rows)
WHERE product <> 'BUILDING'
UNION ALL
SELECT 'draft', complaint_id, CASE WHEN product = 'BUILDING' THEN 1 ELSE 2 END,
  CASE WHEN product = 'BUILDING' THEN 'draft' WHEN bad THEN 'window' END,
  CASE WHEN product = 'BUILDING' THEN complaint_id WHEN bad THEN month END,
  CASE WHEN product = 'BUILDING' THEN 'lost' WHEN bad THEN 'changed' END
FROM (SELECT *, CAST(month[6:] AS INTEGER) % 5 = 0 AS bad FROM rows)""",
    "stored_snapshot": f"""WITH {CASES_SQL}
SELECT row_number() OVER (ORDER BY date_received DESC, complaint_id DESC) - 1 AS line_number,
  sha256('{{"complaint_id":"' || complaint_id || '","date_received":"' || date_received
    || '","issue":"' || issue || '","product":"' || product || '","timely":'
    || coalesce(CAST(timely AS VARCHAR), 'null') || '}}') AS line_sha256 FROM cases""",
    "clean_text": f"""SELECT doc_id,
  nullif(trim({_PAD.format('text')}, {_WS}), '') AS text,
  CASE WHEN lang <> 'en' THEN lang END AS lang_or_null FROM documents""",
    "to_bool": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true
  WHEN 'O' THEN false END AS flag FROM orders""",
    "normalize_source_date": """SELECT o_orderkey, CASE o_orderstatus
  WHEN 'F' THEN strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d')
  WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
  ELSE 'about ' || strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
    "utc_date": """SELECT o_orderkey, CASE o_orderstatus
  WHEN 'F' THEN CAST(o_orderdate AS DATE) + 1
  WHEN 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "normalize_source": f"""WITH {CASES_SQL}
SELECT complaint_id, strftime(date_received, '%Y-%m-%d') AS date_received, product,
  CAST(NULL AS VARCHAR) AS sub_product, issue, CAST(NULL AS VARCHAR) AS sub_issue, company,
  state, submitted_via, strftime(date_sent_to_company, '%Y-%m-%d') AS date_sent_to_company,
  CAST(NULL AS VARCHAR) AS company_response, CAST(NULL AS VARCHAR) AS company_public_response,
  timely, nullif(trim(narrative, {_WS}), '') AS narrative,
  submitted_via = '1' OR nullif(trim(narrative, {_WS}), '') IS NOT NULL AS has_narrative
FROM cases""",
    "source_windows": f"{_SOURCE_WINDOWS_SQL} SELECT * FROM windows",
    "stored_windows": f"{_SOURCE_WINDOWS_SQL} SELECT * FROM windows",
    "stored_snapshot_rows": f"""WITH {CASES_SQL}
SELECT complaint_id, date_received, issue, product, timely FROM cases""",
    "source_volume": f"""{_SOURCE_WINDOWS_SQL}
SELECT *, (SELECT bool_and(source_total_relation = 'eq') FROM windows)
  AS exact_population_volume FROM windows""",
    "quality_counters": f"{_COUNTERS_SQL} SELECT * FROM counters",
    "quality_report": f"{_COUNTERS_SQL} {_REPORT_SQL}",
    "quality_overall": f"""{_COUNTERS_SQL}
SELECT bool_and(severity = 'medium' OR passed) AS passed FROM ({_REPORT_SQL})""",
    "damaged_counters": f"{_DAMAGED_SQL} SELECT * FROM counters",
    "damaged_report": f"""{_DAMAGED_SQL} {_REPORT_SQL}
UNION ALL SELECT 'manifest_snapshot_sha256_matches', false, 'critical', 1e0, '0'
UNION ALL SELECT 'source_reports_no_data_issue', false, 'high', 1e0, '0'
UNION ALL SELECT 'source_reports_fresh', true, 'high', 0e0, '0'""",
    "failed_checks": f"""{_DAMAGED_SQL}
SELECT name FROM ({_REPORT_SQL}) WHERE severity IN ('critical', 'high') AND NOT passed
UNION ALL SELECT 'manifest_snapshot_sha256_matches'
UNION ALL SELECT 'source_reports_no_data_issue'""",
    "routing_support": f"""{_COUNTERS_SQL}
SELECT CAST(narrative_eligible AS BIGINT) AS narrative_eligible_count,
  CAST(500 AS BIGINT) AS minimum_narrative_eligible_count FROM counters""",
    "damaged_overall": f"""{_DAMAGED_SQL}
SELECT bool_and(severity = 'medium' OR passed) AS passed FROM ({_REPORT_SQL})""",
    "search_hits": f"""WITH {CASES_SQL}
SELECT complaint_id, strftime(date_received, '%Y-%m-%d') || 'T08:00:00Z' AS date_received,
  chr(9) || ' ' || chr(12288) || product || ' ' || chr(10) AS product,
  CASE WHEN timely THEN 'Yes' WHEN NOT timely THEN 'No' END AS timely,
  narrative AS complaint_what_happened FROM cases""",
    "source_total": f"""WITH {CASES_SQL},
pages AS (SELECT CAST(complaint_id AS BIGINT) // 1000 AS page, count(*) AS n FROM cases GROUP BY 1)
SELECT page, CASE WHEN page % 3 < 2 THEN n ELSE 0 END AS source_total,
  CASE WHEN page % 3 = 0 THEN 'gte' ELSE 'eq' END AS source_total_relation FROM pages""",
    "column_profile": f"WITH {CASES_SQL} {_PROFILE_SQL}",
    "column_profile_capped": f"""WITH {CASES_SQL}
SELECT "column", null_count, null_rate,
  least(distinct_count_observed, {PROFILE_CAP}) AS distinct_count_observed,
  distinct_count_observed >= {PROFILE_CAP} AS distinct_count_capped
FROM ({_PROFILE_SQL})""",
    "row_hashes": f"""WITH {CASES_SQL}
SELECT complaint_id, {_ROW_JSON} AS row_sha256 FROM cases""",
    "rowset_fingerprint": f"""WITH {CASES_SQL},
{hash_tree_sql(f"SELECT {_ROW_JSON} AS h FROM cases")}""",
}
