"""Queries over the operators built from DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from casequeue.llm import fingerprints, mixing, personal_data, url_rules
from casequeue.llm.common import table


def op10_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).drop("url")


def op4_personal_data(spark, sf_dir):
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    "op4_personal_data": op4_personal_data,
    "op3_url_filter": op3_url_filter,
    "op2_mixing": op2_mixing,
    "op10_fingerprints": op10_fingerprints,
}

def _leaves(text: str) -> str:
    pieces = f"regexp_extract_all({text}, '{fingerprints.LEAF}')"
    return f"list_transform({pieces}, lambda p: md5(p))"


def _sections(leaves: str) -> str:
    joined = f"coalesce(array_to_string({leaves}, ''), '')"
    found = f"regexp_extract_all({joined}, '{fingerprints.SECTION}')"
    return f"list_transform({found}, lambda s: md5(s))"


def _tree(sections: str, leaves: str) -> str:
    whole = f"coalesce(array_to_string({sections}, ''), '')"
    shown = f"coalesce(array_to_string(list_transform({sections}, lambda s: left(s, 16)), ''), '')"
    short = f"coalesce(array_to_string(list_transform({leaves}, lambda p: left(p, 8)), ''), '')"
    return f"md5({whole}) || ':' || {shown} || ':' || {short}"


def _near(x: str, y: str) -> str:
    return (
        f"CASE WHEN left({x}_tree, 32) = left({y}_tree, 32) THEN 1e0 "
        f"WHEN len({x}) + len({y}) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect({x}, {y})) / "
        f"(len(list_distinct({x})) + len(list_distinct({y}))) END"
    )


ORACLES = {
    "op3_url_filter": f"""WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
),
split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, any_value(s.host) AS host, any_value(s.path) AS path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM split s LEFT JOIN rules r ON starts_with(s.path, r.path)
  AND (s.host = r.host OR ends_with(s.host, '.' || r.host))
GROUP BY page_id""",
    "op10_fingerprints": f"""WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
),
led AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC),
    first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM base
),
edits AS (
  SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM led
),
leaves AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_leaves("text")} AS a,
    {_leaves("edited")} AS b, {_leaves("next_text")} AS c FROM edits
),
sections AS (
  SELECT *, {_sections("a")} AS a_s, {_sections("b")} AS b_s, {_sections("c")} AS c_s FROM leaves
),
trees AS (
  SELECT *, {_tree("a_s", "a")} AS a_tree, {_tree("b_s", "b")} AS b_tree,
    {_tree("c_s", "c")} AS c_tree FROM sections
)
SELECT doc_id, n AS n_chars, edited_sha256, a_tree AS fingerprint, b_tree AS edited_fingerprint,
  {_near("a", "b")} AS near_edited, {_near("a", "c")} AS near_next FROM trees""",
}
