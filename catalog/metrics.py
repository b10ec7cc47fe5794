"""Queries over router evaluation, on softmax scores of the embeddings table.

The logit of class k is twice the sum of the embedding values whose place is k
modulo the number of classes. Labels 8 and 9 are left out of the class list, so
unseen labels occur.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casequeue.functions.probability import softmax
from casequeue.operators import metrics
from catalog.adapters import rounded, table

_CLASSES = [str(k) for k in range(8)]
_THRESHOLD = 0.4
_AS_OF = date(2024, 7, 15)


def _logits(spark, sf_dir):
    width = len(_CLASSES)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("label"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("vec_id") % 210).cast("int")).alias("received"),
        F.array(*[_folded(k, width) for k in range(width)]).alias("logits"),
    )


def _folded(k, width):
    mine = F.filter("embedding", lambda x, i: i % width == k)
    total = F.aggregate(mine, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return total * F.lit(2.0)


def _scored(spark, sf_dir):
    return _logits(spark, sf_dir).withColumn("probabilities", softmax(F.col("logits"), 1.0))


def _decided(spark, sf_dir):
    return metrics.decide(_scored(spark, sf_dir), _CLASSES)


def _cells(spark, sf_dir):
    return metrics.evaluation_cells(_scored(spark, sf_dir), _CLASSES, _THRESHOLD)


def softmax_scores(spark, sf_dir):
    scores = softmax(F.col("logits"), 0.5)
    return (
        _logits(spark, sf_dir)
        .select("row_id", F.posexplode(scores).alias("class_index", "probability"))
        .withColumn("probability", F.round("probability", 6))
    )


def decisions(spark, sf_dir):
    return rounded(
        _decided(spark, sf_dir).select("row_id", "label", "predicted", "confidence"), "confidence"
    )


def accuracy_summary(spark, sf_dir):
    row = metrics.accuracy_summary(_cells(spark, sf_dir))
    return rounded(
        row, "accuracy", "coverage", "abstention_rate", "selective_accuracy", "brier"
    )


def macro_f1(spark, sf_dir):
    row = metrics.macro_f1(metrics.class_counts(_cells(spark, sf_dir)))
    return rounded(row, "macro_f1", "selective_macro_f1")


def reliability_bins(spark, sf_dir):
    bins = metrics.reliability_bins(_cells(spark, sf_dir))
    return rounded(bins, "lower", "upper", "mean_confidence", "accuracy")


def evaluate_router(spark, sf_dir):
    return rounded(metrics.evaluate_router(_cells(spark, sf_dir), _CLASSES), "value")


def evaluation_below_gate(spark, sf_dir):
    """The same evaluation when more rows are required than there are."""
    result = metrics.evaluate_router(_cells(spark, sf_dir), _CLASSES, minimum_rows=10**9)
    return rounded(result, "value")


def fit_temperature(spark, sf_dir):
    row = metrics.fit_temperature(_logits(spark, sf_dir), _CLASSES)
    return rounded(row, "temperature", "negative_log_likelihood")


def choose_threshold(spark, sf_dir):
    return rounded(
        metrics.choose_threshold(_decided(spark, sf_dir)), "threshold", "coverage", "accuracy"
    )


def choose_threshold_feasible(spark, sf_dir):
    """Lower targets, so that the feasible branch decides."""
    row = metrics.choose_threshold(
        _decided(spark, sf_dir), target_accuracy=0.12, minimum_coverage=0.05
    )
    return rounded(row, "threshold", "coverage", "accuracy")


def _split(spark, sf_dir):
    return metrics.chronological_split(
        _decided(spark, sf_dir), as_of=_AS_OF, test_months=2, received="received"
    )


def chronological_split(spark, sf_dir):
    return _split(spark, sf_dir).select("row_id", "month", "role")


def split_report(spark, sf_dir):
    return metrics.split_report(_split(spark, sf_dir)).withColumn(
        "months", F.array_join("months", ";")
    )


def _drift(spark, sf_dir):
    split = _split(spark, sf_dir)
    return metrics.distribution_drift(split, split.where("role = 'train'"))


_DRIFT_DOUBLES = (
    "train_share",
    "actual_share",
    "predicted_share",
    "absolute_actual_share_shift",
    "psi_component",
    "actual_vs_train_psi",
)


def distribution_drift(spark, sf_dir):
    return rounded(_drift(spark, sf_dir), *_DRIFT_DOUBLES)


def flatten_drift(spark, sf_dir):
    nested = metrics.drift_by_month(distribution_drift(spark, sf_dir))
    return metrics.flatten_drift(nested)


QUERIES = {
    "softmax_scores": softmax_scores,
    "router_decisions": decisions,
    "accuracy_summary": accuracy_summary,
    "macro_f1": macro_f1,
    "expected_calibration_error": lambda s, d: rounded(
        metrics.expected_calibration_error(_cells(s, d)), "ece"
    ),
    "reliability_bins": reliability_bins,
    "multiclass_brier": lambda s, d: rounded(
        metrics.accuracy_summary(_cells(s, d)).select("brier"), "brier"
    ),
    "false_routes": lambda s, d: metrics.false_routes(_decided(s, d)),
    "unseen_labels": lambda s, d: rounded(metrics.unseen_labels(_cells(s, d), _CLASSES), "rate"),
    "support_gate": lambda s, d: metrics.support_gate(_cells(s, d)),
    "evaluate_router": evaluate_router,
    "evaluation_below_gate": evaluation_below_gate,
    "fit_temperature": fit_temperature,
    "choose_threshold": choose_threshold,
    "choose_threshold_feasible": choose_threshold_feasible,
    "chronological_split": chronological_split,
    "split_report": split_report,
    "distribution_drift": distribution_drift,
    "flatten_drift": flatten_drift,
}


def _softmax_sql(temperature: str) -> str:
    """Probabilities `p` per row from `logits`."""
    return f"""list_transform(logits, lambda x:
    exp((x - list_max(logits)) / {temperature})
    / list_sum(list_transform(logits, lambda y: exp((y - list_max(logits)) / {temperature}))))"""


_SCORED_SQL = f"""WITH logit AS (
  SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label,
    DATE '2024-01-01' + CAST(vec_id % 210 AS INTEGER) AS received,
    list_transform(range(0, 8), lambda k: 2e0 * list_sum(list_transform(
      list_filter(embedding, lambda x, i: (i - 1) % 8 = k), lambda x: CAST(x AS DOUBLE)))) AS logits
  FROM embeddings
),
scored AS (SELECT *, {_softmax_sql('1e0')} AS p FROM logit),
decided AS (
  SELECT *, CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS predicted,
    list_max(p) AS confidence, list_max(p) >= 0.4e0 AS accepted,
    label = CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS hit,
    list_sum(list_transform(p, lambda x, i:
      power(x - CASE WHEN CAST(i - 1 AS VARCHAR) = label THEN 1e0 ELSE 0e0 END, 2)))
      + CASE WHEN label IN ('8', '9') THEN 1e0 ELSE 0e0 END AS brier
  FROM scored
)"""
_EDGES = metrics.linear_grid(0.0, 1.0, 11)
_EDGE_LIST = "[" + ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in _EDGES) + "]"
_BIN_SQL = " + ".join(
    f"CASE WHEN confidence >= CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in _EDGES[1:-1]
)
_BINS_SQL = f"""bins AS (
  SELECT {_BIN_SQL} AS bin, count(*) AS n, avg(CAST(hit AS DOUBLE)) AS acc,
    avg(confidence) AS conf FROM decided GROUP BY 1
)"""


def _f1_sql(source: str) -> str:
    return f"""(SELECT avg(2e0 * hits / (support + guesses)) FROM (
  SELECT c, sum(s) AS support, sum(g) AS guesses, sum(h) AS hits FROM (
    SELECT label AS c, 1 AS s, 0 AS g, CASE WHEN hit THEN 1 ELSE 0 END AS h FROM {source}
    UNION ALL SELECT predicted, 0, 1, 0 FROM {source}) GROUP BY c))"""


_ACCEPTED = "(SELECT * FROM decided WHERE accepted)"
_METRICS_SQL = f"""{_SCORED_SQL}, {_BINS_SQL},
gate AS (
  SELECT sum(n) >= 50 AND min(n) >= 2 AS passed
  FROM (SELECT label, count(*) AS n FROM decided GROUP BY 1)
),
row AS (
  SELECT avg(CAST(hit AS DOUBLE)) AS accuracy, avg(CAST(accepted AS DOUBLE)) AS coverage,
    1e0 - avg(CAST(accepted AS DOUBLE)) AS abstention_rate,
    avg(CAST(hit AS DOUBLE)) FILTER (WHERE accepted) AS selective_accuracy,
    avg(brier) AS brier,
    {_f1_sql('decided')} AS macro_f1, {_f1_sql(_ACCEPTED)} AS selective_macro_f1,
    (SELECT sum(n * abs(acc - conf)) / sum(n) FROM bins) AS ece,
    CAST(count(*) AS DOUBLE) AS test_rows,
    CAST(count(*) FILTER (WHERE accepted) AS DOUBLE) AS accepted_rows,
    CAST(count(*) FILTER (WHERE label IN ('8', '9')) AS DOUBLE) AS unseen_rows,
    avg(CASE WHEN label IN ('8', '9') THEN 1e0 ELSE 0e0 END) AS unseen_rate,
    (SELECT CAST(passed AS DOUBLE) FROM gate) AS support_gate_passed
  FROM decided
)"""
_GATED = ", ".join(metrics.GATED_METRICS)
_FREE = ("test_rows", "accepted_rows", "unseen_rows", "unseen_rate")


def _metric_rows(names, value="round({n}, 6)") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {value.format(n=n)} AS value FROM row" for n in names
    )


_TEMPS = ", ".join(
    f"CAST('{t!r}' AS DOUBLE)" for t in metrics.geometric_grid(*metrics.TEMPERATURE_GRID)
)
_GRID = ", ".join(
    f"CAST('{t!r}' AS DOUBLE)" for t in metrics.linear_grid(*metrics.THRESHOLD_GRID)
)


def _threshold_sql(target: str, minimum: str) -> str:
    return f"""{_SCORED_SQL},
candidates AS (
  SELECT unnest([{_GRID}]) AS t UNION SELECT confidence FROM decided
),
levels AS (
  SELECT confidence AS c, count(*) AS n, count(*) FILTER (WHERE hit) AS h
  FROM decided GROUP BY 1
),
sweep AS (
  SELECT t, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM decided) AS coverage,
    CAST(sum(h) AS DOUBLE) / sum(n) AS accuracy
  FROM candidates JOIN levels ON c >= t GROUP BY 1
  UNION ALL SELECT t, 0e0, 0e0 FROM candidates
  WHERE t > (SELECT max(confidence) FROM decided)
),
ranked AS (
  SELECT *, coverage >= {minimum} AND accuracy >= {target} AS feasible FROM sweep
)
SELECT round(t, 6) AS threshold, round(coverage, 6) AS coverage,
  round(accuracy, 6) AS accuracy, feasible FROM ranked
ORDER BY feasible DESC, CASE WHEN feasible THEN coverage ELSE accuracy * coverage END DESC,
  CASE WHEN feasible THEN accuracy ELSE coverage END DESC, t LIMIT 1"""


_SPLIT_SQL = f"""{_SCORED_SQL},
eligible AS (
  SELECT *, strftime(received, '%Y-%m') AS month FROM decided
  WHERE received < DATE '2024-07-01'
),
roles AS (
  SELECT month, CASE WHEN r <= 2 THEN 'test' WHEN r = 3 THEN 'threshold'
      WHEN r = 4 THEN 'calibration' ELSE 'train' END AS role
  FROM (SELECT month, row_number() OVER (ORDER BY month DESC) AS r
        FROM (SELECT DISTINCT month FROM eligible))
),
split AS (SELECT * FROM eligible JOIN roles USING (month))"""
_DRIFT_SQL = f"""{_SPLIT_SQL},
train AS (SELECT label AS product, count(*) AS n FROM split WHERE role = 'train' GROUP BY 1),
seen AS (
  SELECT month, label AS product, 1 AS a, 0 AS g FROM split
  UNION ALL SELECT month, predicted, 0, 1 FROM split
  UNION ALL SELECT DISTINCT s.month, t.product, 0, 0 FROM split s, train t
),
counts AS (SELECT month, product, sum(a) AS a, sum(g) AS g FROM seen GROUP BY 1, 2),
shares AS (
  SELECT month, product, sum(a) OVER (PARTITION BY month) AS size,
    coalesce(n, 0) / CAST((SELECT sum(n) FROM train) AS DOUBLE) AS ts,
    CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY month) AS s,
    CAST(g AS DOUBLE) / sum(a) OVER (PARTITION BY month) AS gs
  FROM counts LEFT JOIN train USING (product)
),
terms AS (SELECT *, (s - ts) * ln((s + 1e-6) / (ts + 1e-6)) AS psi FROM shares)
SELECT {{month}}, product, CAST(size AS BIGINT) AS sample_size, round(ts, 6) AS train_share,
  round(s, 6) AS actual_share, round(gs, 6) AS predicted_share,
  round(abs(s - ts), 6) AS absolute_actual_share_shift, round(psi, 6) AS psi_component,
  round(sum(psi) OVER (PARTITION BY month), 6) AS actual_vs_train_psi FROM terms"""

ORACLES = {
    "softmax_scores": f"""{_SCORED_SQL},
half AS (SELECT row_id, {_softmax_sql('0.5e0')} AS p FROM logit)
SELECT row_id, CAST(i AS INTEGER) AS class_index, round(p[i + 1], 6) AS probability
FROM half, range(8) r(i)""",
    "router_decisions": f"""{_SCORED_SQL}
SELECT row_id, label, predicted, round(confidence, 6) AS confidence FROM decided""",
    "accuracy_summary": f"""{_METRICS_SQL}
SELECT CAST(test_rows AS BIGINT) AS test_rows, CAST(accepted_rows AS BIGINT) AS accepted_rows,
  round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage,
  round(abstention_rate, 6) AS abstention_rate,
  round(selective_accuracy, 6) AS selective_accuracy, round(brier, 6) AS brier FROM row""",
    "macro_f1": f"""{_METRICS_SQL}
SELECT round(macro_f1, 6) AS macro_f1, round(selective_macro_f1, 6) AS selective_macro_f1
FROM row""",
    "expected_calibration_error": f"{_METRICS_SQL} SELECT round(ece, 6) AS ece FROM row",
    "reliability_bins": f"""{_SCORED_SQL}, {_BINS_SQL}
SELECT bin, round({_EDGE_LIST}[bin + 1], 6) AS lower, round({_EDGE_LIST}[bin + 2], 6) AS upper,
  round(conf, 6) AS mean_confidence, round(acc, 6) AS accuracy, n AS count FROM bins""",
    "multiclass_brier": f"{_METRICS_SQL} SELECT round(brier, 6) AS brier FROM row",
    "false_routes": f"""{_SCORED_SQL}
SELECT label AS actual, predicted, count(*) AS count FROM decided WHERE NOT hit
GROUP BY 1, 2 ORDER BY count DESC, min(struct_pack(a := received, b := row_id)) LIMIT 20""",
    "unseen_labels": f"""{_SCORED_SQL}
SELECT label, count(*) AS row_count,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM decided), 6) AS rate
FROM decided WHERE label IN ('8', '9') GROUP BY 1""",
    "support_gate": f"""{_SCORED_SQL}
SELECT CAST(sum(n) AS BIGINT) AS observed_rows, min(n) AS smallest_class,
  sum(n) >= 50 AND min(n) >= 2 AS passed
FROM (SELECT label, count(*) AS n FROM decided GROUP BY 1)""",
    "evaluate_router": f"""{_METRICS_SQL}
{_metric_rows(metrics.GATED_METRICS, 'CASE WHEN support_gate_passed = 1 THEN round({n}, 6) END')}
UNION ALL {_metric_rows((*_FREE, 'support_gate_passed'))}""",
    "evaluation_below_gate": f"""{_METRICS_SQL}
{_metric_rows(metrics.GATED_METRICS, 'CAST(NULL AS DOUBLE)')}
UNION ALL {_metric_rows(_FREE)}
UNION ALL SELECT 'support_gate_passed', 0e0""",
    "fit_temperature": f"""{_SCORED_SQL},
heated AS (
  SELECT t, logits[CAST(label AS INTEGER) + 1] AS own, list_max(logits) AS top,
    list_sum(list_transform(logits, lambda y: exp((y - list_max(logits)) / t))) AS total
  FROM logit, (SELECT unnest([{_TEMPS}]) AS t) WHERE label NOT IN ('8', '9')
),
losses AS (
  SELECT t, avg(-ln(least(greatest(exp((own - top) / t) / total, 1e-12), 1e0))) AS nll,
    count(*) AS n FROM heated GROUP BY 1
)
SELECT round(t, 6) AS temperature, round(nll, 6) AS negative_log_likelihood,
  n AS known_label_rows, (SELECT count(*) FROM logit) - n AS unseen_label_rows
FROM losses ORDER BY nll, t LIMIT 1""",
    "choose_threshold": _threshold_sql("0.8e0", "0.5e0"),
    "choose_threshold_feasible": _threshold_sql("0.12e0", "0.05e0"),
    "chronological_split": f"{_SPLIT_SQL} SELECT row_id, month, role FROM split",
    "split_report": f"""{_SPLIT_SQL}
SELECT role, string_agg(DISTINCT month, ';' ORDER BY month) AS months, count(*) AS rows
FROM split GROUP BY 1""",
    "distribution_drift": _DRIFT_SQL.format(month="month"),
    "flatten_drift": _DRIFT_SQL.format(month="month AS period"),
}
