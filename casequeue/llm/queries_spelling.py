"""Query over spelling variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casequeue.llm import spelling
from casequeue.llm.common import table


def one_letter_less(doc_id: Column, word: Column) -> Column:
    """The dealt misspelling: of one word in 31 a letter is left out, both chosen by a checksum."""
    h = F.crc32(F.concat_ws(":", doc_id, word))
    at = (h % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % 31 == 0, shorter).otherwise(word)


def op12_spelling_variants(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents"), misspell=one_letter_less)
    return spelling.group_variants(words)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

# crc32 bit by bit over UTF-8: all letters beyond ASCII here are two bytes, 195 and the code less 64.
ORACLES = {
    "op12_spelling_variants": r"""WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
),
distinct_runs AS (
  SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL
),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
  FROM distinct_runs
),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(b,
    lambda x: [CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e:
    xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))) AS h FROM bytes
),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT))
    || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, sum(times) AS n
  FROM hashed GROUP BY 1 HAVING sum(times) >= 2 AND length(word) >= 7
),
shorter AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other,
    max(other_n) AS other_n FROM near GROUP BY word
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
chains AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
),
roots AS (
  SELECT c.word, c.root FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near,
  CAST(form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON r.word = f.word""",
}
