"""Queries over raw web pages."""

from __future__ import annotations

from casequeue.llm import main_text
from casequeue.llm.common import table


def op11_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract_text(pages).drop("html")


QUERIES = {"op11_main_text": op11_main_text}

# The tables' pages mark their main part as an article with a heading and paragraphs, some of which
# never close or are cut off; so plain patterns give what the operator has to find by its ratios.
ORACLES = {
    "op11_main_text": r"""WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS a
  FROM pages
),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'),
    lambda b: regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*(>|\z)', '', 'g')) AS raw
  FROM article
),
decoded AS (
  SELECT page_id, url, list_transform(raw, lambda b: trim(regexp_replace(regexp_replace(
    replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))) AS b FROM blocks
),
texts AS (
  SELECT page_id, url,
    coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text
  FROM decoded
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts""",
}
