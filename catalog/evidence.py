"""Queries over text evidence, draft checks and token cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from casequeue.functions.text import narrative_group
from casequeue.operators import evidence
from catalog.adapters import CASES_SQL, cases, table


def _passages(spark, sf_dir):
    """Every document, and every conversation turn as a transcript line."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("passage_id"), F.col("source").alias("origin"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("passage_id"),
        F.col("role").alias("origin"),
        F.concat("role", F.lit(": "), "text").alias("text"),
    )
    return documents.unionByName(turns)


def injection_flags(spark, sf_dir):
    return _passages(spark, sf_dir).select(
        "passage_id", evidence.injection_flag(F.col("text")).alias("flagged")
    )


def risk_flags(spark, sf_dir):
    given = F.when(F.length("text") > 500, F.array(F.lit("long_text"), F.lit(evidence.INJECTION_FLAG)))
    flags = evidence.add_risk_flag(
        given.otherwise(F.array(F.col("origin"))), evidence.injection_flag(F.col("text"))
    )
    return _passages(spark, sf_dir).select("passage_id", F.array_join(flags, ";").alias("flags"))


def quote_positions(spark, sf_dir):
    """Occurrences of a two-character excerpt of each whole document."""
    excerpt = F.substr(F.col("text"), F.lit(1) + F.col("n_chars") % 7, F.lit(2))
    documents = table(spark, sf_dir, "documents").withColumn("quote", excerpt)
    positions = evidence.quote_positions(F.col("text"), F.col("quote"))
    return documents.select("doc_id", "quote", F.array_join(positions, ";").alias("positions"))


def _drafts(spark, sf_dir):
    """Two quotes per document: a long one and a short, mostly repeated one.

    Offsets are right, one off, or reversed, by the length of the source name
    and the language.
    """
    begin = (F.col("n_chars") % 20).cast("int")
    shift = F.when(F.col("lang").isin("fr", "de"), 1).otherwise(0)

    def quote(width: int):
        text = F.substr(F.col("text"), begin + 1, F.lit(width))
        end = begin + F.length(text)
        return F.struct(
            text.alias("text"),
            F.when(F.col("lang") == "es", end).otherwise(begin + shift).alias("start"),
            F.when(F.col("lang") == "es", begin).otherwise(end + shift).alias("end"),
        )

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("narrative"),
        F.array(quote(12), quote(2)).alias("quotes"),
        "lang",
        "source",
        "n_chars",
    )


def _spans(quotes):
    return F.array_join(
        F.transform(
            quotes,
            lambda q: F.when(q.isNull(), "none").otherwise(
                F.concat_ws("-", q["start"].cast("string"), q["end"].cast("string"))
            ),
        ),
        ";",
    )


def ground_quotes(spark, sf_dir):
    grounded = evidence.ground_quotes(_drafts(spark, sf_dir))
    return grounded.select("doc_id", "grounded", _spans(F.col("quotes")).alias("spans"))


def accepted_drafts(spark, sf_dir):
    accepted, rejected = evidence.split_grounded(evidence.ground_quotes(_drafts(spark, sf_dir)))
    return accepted.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("outcome"))
    )


def quotes_valid(spark, sf_dir):
    valid = evidence.quotes_valid(F.col("narrative"), F.col("quotes"))
    return _drafts(spark, sf_dir).select("doc_id", valid.alias("valid"))


def draft_eligible(spark, sf_dir):
    return evidence.draft_eligible(cases(spark, sf_dir)).select(
        "complaint_id", F.length("draft_input").alias("input_chars")
    )


def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", evidence.first_sentence(F.col("text")).alias("extract")
    )


def draft_errors(spark, sf_dir):
    """Drafts whose parts are the document's own lines and first sentence."""
    lines = F.split("narrative", "\n")
    payload = F.struct(
        evidence.first_sentence(F.col("narrative")).alias("headline"),
        F.col("narrative").alias("summary"),
        lines.alias("key_points"),
        F.col("quotes").alias("evidence_quotes"),
        F.array().cast("array<string>").alias("missing_information"),
        F.split("source", "").alias("risk_flags"),
        F.when(F.col("lang") != "de", lines).alias("recommended_human_actions"),
    )
    return _drafts(spark, sf_dir).select(
        "doc_id", F.array_join(evidence.draft_errors(payload), ";").alias("errors")
    )


def token_cost(spark, sf_dir):
    usage = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("gpt-5.6-luna").alias("model"),
        F.col("n_chars").alias("input_tokens"),
        F.when(F.col("lang") == "en", F.lit(500)).otherwise(F.lit(0)).alias("cached_input_tokens"),
        F.length("source").alias("output_tokens"),
    )
    return evidence.token_cost(usage).select("doc_id", "cost_usd")


def narrative_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", narrative_group(F.col("text")).alias("narrative_group")
    )


QUERIES = {
    "injection_flags": injection_flags,
    "risk_flags": risk_flags,
    "quote_positions": quote_positions,
    "ground_quotes": ground_quotes,
    "accepted_drafts": accepted_drafts,
    "quotes_valid": quotes_valid,
    "draft_eligible": draft_eligible,
    "first_sentence": first_sentence,
    "draft_errors": draft_errors,
    "token_cost": token_cost,
    "narrative_groups": narrative_groups,
}

_PASSAGES_SQL = """WITH passages AS (
  SELECT 'd' || doc_id AS passage_id, source AS origin, text FROM documents
  UNION ALL
  SELECT 'c' || conv_id || '-' || turn, role, role || ': ' || text FROM conversations
)"""
_PATTERN_SQL = "(" + "|".join(evidence.INJECTION_PATTERNS) + ")"
_HIT_SQL = f"regexp_matches(text, '{_PATTERN_SQL}', 'i')"


def _quote_sql(width: int) -> str:
    text = f"substr(text, b + 1, {width})"
    end = f"b + length({text})"
    return f"""struct_pack(q := {text},
    s := CASE WHEN lang = 'es' THEN {end} WHEN lang IN ('fr', 'de') THEN b + 1 ELSE b END,
    e := CASE WHEN lang = 'es' THEN b WHEN lang IN ('fr', 'de') THEN {end} + 1
         ELSE {end} END)"""


_DRAFTS_SQL = f"""WITH base AS (SELECT *, n_chars % 20 AS b FROM documents),
drafts AS (SELECT *, [{_quote_sql(12)}, {_quote_sql(2)}] AS quotes FROM base)"""
_GROUNDED_SQL = f"""{_DRAFTS_SQL},
each_quote AS (
  SELECT doc_id, i, text, quotes[i].q AS q, quotes[i].s AS s, quotes[i].e AS e,
    instr(text, quotes[i].q) AS pos
  FROM drafts, range(1, 3) r(i)
),
fixed AS (
  SELECT doc_id, i, CASE
      WHEN pos = 0 THEN NULL
      WHEN instr(substr(text, pos + 1), q) = 0
        THEN (pos - 1) || '-' || (pos - 1 + length(q))
      WHEN e > s AND e <= length(text) AND substr(text, s + 1, e - s) = q
        THEN s || '-' || e END AS span
  FROM each_quote
),
grounded AS (
  SELECT doc_id, count(span) = 2 AS grounded,
    string_agg(coalesce(span, 'none'), ';' ORDER BY i) AS spans
  FROM fixed GROUP BY 1
)"""
_SENTENCE_SQL = """left(text, coalesce(least(nullif(instr(text, '.'), 0),
  nullif(instr(text, '!'), 0), nullif(instr(text, '?'), 0)), 240))"""

ORACLES = {
    "injection_flags": f"{_PASSAGES_SQL} SELECT passage_id, {_HIT_SQL} AS flagged FROM passages",
    "risk_flags": f"""{_PASSAGES_SQL}
SELECT passage_id, CASE
  WHEN length(text) > 500 THEN 'long_text;{evidence.INJECTION_FLAG}'
  WHEN {_HIT_SQL} THEN origin || ';{evidence.INJECTION_FLAG}' ELSE origin END AS flags
FROM passages""",
    "quote_positions": """WITH quoted AS (
  SELECT doc_id, substr(text, CAST(1 + n_chars % 7 AS BIGINT), 2) AS quote,
    string_split(text, '') AS c FROM documents
)
SELECT doc_id, quote, array_to_string(
  list_filter(range(len(c) - length(quote) + 1), lambda i:
    CASE WHEN length(quote) = 2 THEN c[i + 1] || c[i + 2] ELSE c[i + 1] END = quote), ';')
  AS positions FROM quoted""",
    "ground_quotes": f"{_GROUNDED_SQL} SELECT doc_id, grounded, spans FROM grounded",
    "accepted_drafts": f"""{_GROUNDED_SQL}
SELECT doc_id, CASE WHEN grounded THEN 'accepted' ELSE 'rejected' END AS outcome
FROM grounded""",
    "quotes_valid": f"""{_DRAFTS_SQL}
SELECT doc_id, list_bool_and(list_transform(quotes, lambda q: q.e <= length(text)
  AND substr(text, q.s + 1, greatest(q.e - q.s, 0)) = q.q)) AS valid FROM drafts""",
    "draft_eligible": f"""WITH {CASES_SQL}
SELECT complaint_id, CAST(length(narrative) AS INTEGER) AS input_chars FROM cases
WHERE has_narrative AND length(trim(narrative, chr(10) || ' ')) >= 20""",
    "first_sentence": f"SELECT doc_id, {_SENTENCE_SQL} AS extract FROM documents",
    "draft_errors": f"""{_DRAFTS_SQL}
SELECT doc_id, concat_ws(';',
  CASE WHEN length({_SENTENCE_SQL}) NOT BETWEEN 1 AND 180 THEN 'headline' END,
  CASE WHEN length(text) NOT BETWEEN 1 AND 1200 THEN 'summary' END,
  CASE WHEN len(string_split(text, chr(10))) NOT BETWEEN 1 AND 6 THEN 'key_points' END,
  CASE WHEN length(source) > 6 THEN 'risk_flags' END,
  CASE WHEN lang <> 'de' AND len(string_split(text, chr(10))) > 5
    THEN 'recommended_human_actions' END,
  CASE WHEN len(list_filter(quotes, lambda q: length(q.q) < 1 OR q.e <= 0)) > 0
    THEN 'quote_bounds' END) AS errors
FROM drafts""",
    "token_cost": """SELECT doc_id, round((greatest(n_chars - c, 0) * 0.2e0 + c * 0.02e0
  + length(source) * 1.2e0) / 1e6, 8) AS cost_usd
FROM (SELECT *, CASE WHEN lang = 'en' THEN 500 ELSE 0 END AS c FROM documents)""",
    "narrative_groups": r"""SELECT doc_id, sha256(trim(regexp_replace(
  replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS narrative_group FROM documents""",
}
