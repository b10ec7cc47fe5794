"""Queries over repeated strings and near copies."""

from __future__ import annotations

from casequeue.llm import near_copies, suffix_dedup
from casequeue.llm.common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_near_copies(spark, sf_dir):
    return near_copies.near_copies(table(spark, sf_dir, "documents"), words=4)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op8_near_copies": op8_near_copies}
ORACLES = {
    "op8_near_copies": r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4
    THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words
),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id,
  doc_id = component_id AS kept FROM shingles JOIN components USING (doc_id)""",
}
