"""Queries over router inputs, vocabulary and scoring."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.operators import router, solver, views
from casequeue.operators.features import narrative_terms, tfidf_weights
from casequeue.sources import models
from casequeue.sources.handover import shared_folder, written
from catalog.adapters import CASES_SQL, cases, table

_AS_OF = date(2001, 8, 1)


def _eligible(spark, sf_dir):
    return views.eligible_narratives(cases(spark, sf_dir))


def dedup_narratives(spark, sf_dir):
    return router.dedup_narratives(_eligible(spark, sf_dir)).select(
        "complaint_id", "date_received", "product"
    )


def tfidf_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir, router.DEFAULT_FEATURES)


def tfidf_vocabulary_whole(spark, sf_dir):
    """Every term that is neither rare nor everywhere."""
    return _vocabulary(spark, sf_dir, None)


def _vocabulary(spark, sf_dir, features):
    documents = table(spark, sf_dir, "documents")
    terms = narrative_terms(documents, "text", pairs=False)
    rows = documents.count()  # reads no column
    kept = router.vocabulary(
        terms, rows, minimum_documents=router.usual_minimum(rows), features=features, pairs=True
    )
    return kept.withColumn("idf", F.round("idf", 6))


def _scores(spark, sf_dir):
    good = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        F.when(good, "plain").otherwise("unclear").alias("predicted_product"),
        F.when(good, 0.75).otherwise(0.25).alias("prediction_confidence"),
        (F.col("toxic") == 1).alias("prediction_abstained"),
    )


def apply_scores(spark, sf_dir):
    scored = router.apply_scores(cases(spark, sf_dir), _scores(spark, sf_dir))
    return scored.select(
        "complaint_id", "predicted_product", "prediction_confidence", "prediction_abstained"
    )


def router_scores(spark, sf_dir):
    """Train on every eligible narrative, routing by language, and score every case.

    Weights depend on the solver; what is compared is determined whatever they are.
    """
    language = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("complaint_id"), F.col("lang").alias("product")
    )
    rows = _eligible(spark, sf_dir).drop("product").join(language, "complaint_id")
    trained = router.train_router(rows, as_of=_AS_OF, test_months=12)
    scored = trained.model.score(cases(spark, sf_dir))
    score, label = F.col("prediction_confidence"), F.col("predicted_product")
    certain = score >= F.lit(trained.model.threshold)
    return scored.select(
        "complaint_id",
        label.isNull().alias("no_class"),
        F.coalesce(label.isin(*trained.model.classes), F.lit(True)).alias("class_known"),
        F.coalesce((score > 0) & (score <= 1), F.lit(True)).alias("confidence_in_range"),
        (F.col("prediction_abstained") == ~F.coalesce(certain, F.lit(False))).alias("abstains_by_rule"),
    )


def tfidf_vectors(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = written(router.fit_terms(documents, documents.count(), "text"))
    weights = tfidf_weights(documents, terms, router.DEFAULT_FEATURES, "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


_STEPS, _RATE, _TEMPERATURE, _THRESHOLD = 3, 8.0, 0.5, 0.4


def _stepped_model(spark, sf_dir):
    """Languages of documents, after a fixed number of full-batch steps of one length."""
    train = table(spark, sf_dir, "documents").where("lang is not null")
    train = train.select("doc_id", "text", F.col("lang").alias("label"))
    sizes = router.class_sizes(train)
    terms = written(router.fit_terms(train, sum(sizes.values()), "text"))
    features = terms.count()
    blocks = written(router.labelled_blocks(train, terms, features, list(sizes), "doc_id", "text"))
    objective = solver.Objective(blocks, features, solver.Balance.of(sizes), router.ALPHA)
    weights = solver.descend(objective, _STEPS, _RATE)
    model_terms = written(router.with_coefficients(terms, weights))
    intercepts = weights[-1].tolist()
    return router.RouterModel(
        model_terms, list(sizes), intercepts, features, _TEMPERATURE, _THRESHOLD, "doc_id", "text"
    )


def router_coefficients(spark, sf_dir):
    """Coefficients of each term and class, and the intercepts with no term."""
    model = _stepped_model(spark, sf_dir)
    intercepts = spark.createDataFrame([(None, model.intercepts)], "term string, coefficients array<double>")
    each = model.terms.select("term", "coefficients").union(intercepts)
    return each.select("term", F.posexplode("coefficients").alias("class_number", "coefficient")).withColumn(
        "coefficient", F.round("coefficient", 6)
    )


def router_logits(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    margins = _stepped_model(spark, sf_dir).logits(documents)
    return margins.select("doc_id", F.posexplode("logits").alias("class_number", "logit")).withColumn(
        "logit", F.round("logit", 6)
    )


def reloaded_scores(spark, sf_dir):
    """Scores of all documents by a model that was written and read again."""
    folder = shared_folder(spark)
    model = models.load_model(spark, folder, models.save_model(_stepped_model(spark, sf_dir), folder))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = model.score(documents).drop("text")
    return scored.withColumn("prediction_confidence", F.round("prediction_confidence", 6))


QUERIES = {
    "tfidf_vectors": tfidf_vectors,
    "router_coefficients": router_coefficients,
    "router_logits": router_logits,
    "reloaded_scores": reloaded_scores,
    "dedup_narratives": dedup_narratives,
    "dedup_report": lambda s, d: router.dedup_report(_eligible(s, d)),
    "tfidf_vocabulary": tfidf_vocabulary,
    "tfidf_vocabulary_whole": tfidf_vocabulary_whole,
    "apply_scores": apply_scores,
    "score_counts": lambda s, d: router.score_counts(cases(s, d)),
    "router_scores": router_scores,
}

_ELIGIBLE_SQL = rf"""WITH {CASES_SQL},
eligible AS (
  SELECT *, trim(regexp_replace(replace(lower(narrative), 'ß', 'ss'), '\s+', ' ', 'g')) AS g
  FROM cases WHERE has_narrative AND length(trim(narrative)) >= 20 AND product IS NOT NULL
)"""

_VOCABULARY_CTE = r"""tokens AS (
  SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w
  FROM source
),
terms AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tokens
),
counts AS (
  SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS document_count
  FROM terms GROUP BY 1
),
n AS (SELECT count(*) AS rows FROM source),
vocabulary AS (
  SELECT term, term_count, document_count,
    ln((1e0 + rows) / (1e0 + document_count)) + 1e0 AS idf FROM counts, n
  WHERE document_count >= CASE WHEN rows >= 1000 THEN 2 ELSE 1 END
    AND document_count <= 0.995e0 * rows
)"""
_VOCABULARY_SQL = f"""WITH source AS (SELECT doc_id, text FROM documents),
{_VOCABULARY_CTE}
SELECT term, term_count, document_count, round(idf, 6) AS idf FROM vocabulary"""

# Weights of known terms of the documents `of`, by terms fitted on `source`.
_FEATURES_CTE = r"""kept AS (
  SELECT term, idf FROM vocabulary ORDER BY term_count DESC, term LIMIT 40000
),
of_tokens AS (
  SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w
  FROM documents
),
of_terms AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM of_tokens
),
raw AS (
  SELECT doc_id, term, (1e0 + ln(count(*))) * any_value(idf) AS w
  FROM of_terms JOIN kept USING (term) GROUP BY doc_id, term
),
features AS MATERIALIZED (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM raw
)"""


def _stepped_sql() -> str:
    """Steps of the solver as joins: margins, slopes, then weights by term and class."""
    steps = ["""labelled AS (SELECT doc_id, lang AS label FROM documents WHERE lang IS NOT NULL),
classes AS (
  SELECT label AS class, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_number,
    count(*) AS size, sum(count(*)) OVER () AS total, count(*) OVER () AS k
  FROM labelled GROUP BY label
),
sides AS (
  SELECT doc_id, class_number, label = class AS own,
    CASE WHEN label = class THEN total / (k * CAST(size AS DOUBLE)) ELSE 1e0 END AS weight,
    CAST(total AS DOUBLE) AS total
  FROM labelled CROSS JOIN classes
),
c0 AS (SELECT term, class_number, 0e0 AS c FROM kept CROSS JOIN classes),
b0 AS (SELECT class_number, 0e0 AS b FROM classes)"""]
    for step in range(_STEPS):
        steps.append(f"""m{step} AS (
  SELECT doc_id, class_number, sum(v * c) AS m FROM features JOIN c{step} USING (term) GROUP BY ALL
),
s{step} AS MATERIALIZED (
  SELECT s.doc_id, s.class_number, total,
    weight * (1e0 / (1e0 + exp(-(b + coalesce(m, 0e0)))) - CAST(own AS INTEGER)) AS slope
  FROM sides s JOIN b{step} USING (class_number) LEFT JOIN m{step} m
    ON m.doc_id = s.doc_id AND m.class_number = s.class_number
),
g{step} AS (
  SELECT term, class_number, sum(v * slope / total) AS g
  FROM features JOIN s{step} USING (doc_id) GROUP BY ALL
),
c{step + 1} AS MATERIALIZED (
  SELECT term, class_number, c - {_RATE} * (coalesce(g, 0e0) + {router.ALPHA} * c) AS c
  FROM c{step} LEFT JOIN g{step} USING (term, class_number)
),
b{step + 1} AS (
  SELECT class_number, b - {_RATE} * (SELECT sum(slope / total) FROM s{step} s
    WHERE s.class_number = b{step}.class_number) AS b FROM b{step}
)""")
    steps.append(f"""logits AS MATERIALIZED (
  SELECT d.doc_id, class_number, b + coalesce(m, 0e0) AS logit
  FROM (SELECT doc_id, class_number, b FROM documents CROSS JOIN b{_STEPS}) d LEFT JOIN (
    SELECT doc_id, class_number, sum(v * c) AS m FROM features JOIN c{_STEPS} USING (term) GROUP BY ALL
  ) p USING (doc_id, class_number)
)""")
    source = "SELECT doc_id, text FROM documents WHERE lang IS NOT NULL"
    return f"WITH source AS ({source}),\n{_VOCABULARY_CTE},\n{_FEATURES_CTE},\n" + ",\n".join(steps)


_STEPPED_SQL = _stepped_sql()

ORACLES = {
    "tfidf_vectors": f"""WITH source AS (SELECT doc_id, text FROM documents),
{_VOCABULARY_CTE},
{_FEATURES_CTE}
SELECT doc_id, term, round(v, 6) AS weight FROM features""",
    "router_coefficients": f"""{_STEPPED_SQL}
SELECT term, class_number, round(c, 6) AS coefficient FROM c{_STEPS}
UNION ALL SELECT NULL, class_number, round(b, 6) FROM b{_STEPS}""",
    "router_logits": f"""{_STEPPED_SQL}
SELECT doc_id, class_number, round(logit, 6) AS logit FROM logits""",
    "reloaded_scores": f"""{_STEPPED_SQL},
shifted AS (
  SELECT doc_id, class_number,
    exp((logit - max(logit) OVER (PARTITION BY doc_id)) / {_TEMPERATURE}) AS e FROM logits
),
best AS (
  SELECT doc_id, arg_max(class, e / mass ORDER BY class_number) AS class, max(e / mass) AS p
  FROM (SELECT *, sum(e) OVER (PARTITION BY doc_id) AS mass FROM shifted)
  JOIN classes USING (class_number) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN readable THEN class END AS predicted_product,
  CASE WHEN readable THEN round(p, 6) END AS prediction_confidence,
  NOT readable OR p < {_THRESHOLD} AS prediction_abstained
FROM best JOIN (SELECT doc_id, trim(coalesce(text, '')) <> '' AS readable FROM documents) USING (doc_id)""",
    "dedup_narratives": f"""{_ELIGIBLE_SQL}
SELECT complaint_id, date_received, product FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY date_received, complaint_id) AS rn
  FROM eligible) WHERE rn = 1""",
    "dedup_report": f"""{_ELIGIBLE_SQL}
SELECT count(*) AS input_rows, count(DISTINCT g) AS unique_narrative_groups,
  count(*) - count(DISTINCT g) AS excluded_duplicate_rows FROM eligible""",
    "tfidf_vocabulary": f"{_VOCABULARY_SQL} ORDER BY term_count DESC, term LIMIT 40000",
    "tfidf_vocabulary_whole": _VOCABULARY_SQL,
    "router_scores": f"""WITH {CASES_SQL}
SELECT complaint_id, coalesce(trim(narrative), '') = '' AS no_class, true AS class_known,
  true AS confidence_in_range, true AS abstains_by_rule FROM cases""",
    "apply_scores": f"""WITH {CASES_SQL}
SELECT c.complaint_id,
  CASE WHEN has_narrative THEN CASE quality WHEN 1 THEN 'plain' WHEN 0 THEN 'unclear' END END
    AS predicted_product,
  CASE WHEN has_narrative THEN CASE quality WHEN 1 THEN 0.75e0 WHEN 0 THEN 0.25e0 END END
    AS prediction_confidence,
  NOT has_narrative OR coalesce(toxic = 1, true) AS prediction_abstained
FROM cases c LEFT JOIN labels ON c.complaint_id = CAST(doc_id AS VARCHAR)""",
    "score_counts": f"""WITH {CASES_SQL}
SELECT count(*) FILTER (WHERE has_narrative) AS scored_count,
  count(*) FILTER (WHERE NOT has_narrative) AS no_narrative_abstained_count FROM cases""",
}
