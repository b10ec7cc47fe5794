from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casequeue.operators import features, metrics, router, solver
from casequeue.session import BATCH_BYTES_CONF
from casequeue.sources import models
from casequeue.sources.handover import written

AS_OF = date(2031, 4, 9)
SHAPE = "complaint_id string, date_received date, narrative string, product string"
TOPICS = {
    "Garden": ("soil seeds spade compost", "roses hedge watering frost"),
    "Kitchen": ("oven kettle plates recipe", "butter flour whisk pastry"),
}
MONTHS = [(2030, m) for m in (8, 9, 10, 11, 12)] + [(2031, m) for m in (1, 2, 3)]
PER_MONTH = 9


@pytest.fixture(scope="module")
def rows(spark):
    """Eight whole months of two topics; the last has a third one; three rows are too new."""
    data = []
    for n, (year, month) in enumerate(MONTHS):
        for topic, phrases in TOPICS.items():
            for day in range(1, PER_MONTH + 1):
                text = f"{phrases[day % 2]} page {n * 31 + day} über {topic[0].lower()}{day}x{n}"
                data.append((f"{topic}-{n}-{day}", date(year, month, 2 * day), text, topic))
    data += [(f"late-{k}", date(2031, 3, 25), f"telescope lens orbit {k} planets", "Sky") for k in range(3)]
    data += [(f"fresh-{k}", date(2031, 4, 1 + k), f"soil seeds spade today {k}", "Garden") for k in range(3)]
    return spark.createDataFrame(data, SHAPE)


def test_copies_keep_the_earliest(spark):
    data = [
        ("late", date(2026, 2, 1), " SAME   complaint text ", "a"),
        ("early", date(2026, 1, 1), "same complaint text", "a"),
        ("other", date(2026, 1, 1), "another", "a"),
    ]
    df = spark.createDataFrame(data, SHAPE)
    assert {r["complaint_id"] for r in router.dedup_narratives(df).collect()} == {"early", "other"}
    report = router.dedup_report(df).first()
    assert tuple(report) == (3, 2, 1)


def test_split_roles(spark, rows):
    split = metrics.chronological_split(rows, as_of=AS_OF)
    months = {r["role"]: (r["months"], r["rows"]) for r in metrics.split_report(split).collect()}
    assert months["test"] == (["2031-03"], 2 * PER_MONTH + 3)
    assert months["threshold"][0] == ["2031-02"] and months["calibration"][0] == ["2031-01"]
    assert months["train"][0] == ["2030-08", "2030-09", "2030-10", "2030-11", "2030-12"]
    with pytest.raises(Exception, match="months are required"):
        metrics.chronological_split(rows, as_of=date(2030, 11, 2)).collect()
    with pytest.raises(ValueError):
        metrics.chronological_split(rows, as_of=AS_OF, test_months=0)


def terms_of(text):
    plain = unicodedata.normalize("NFKD", text.lower())
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    tokens = re.findall(r"\b\w\w+\b", plain)
    return tokens + [" ".join(pair) for pair in zip(tokens, tokens[1:])]


def test_features_match_the_formula(spark, rows):
    texts = [r["narrative"] for r in rows.collect()]
    documents = [Counter(terms_of(t)) for t in texts]
    frequency = Counter(term for d in documents for term in d)
    n = len(texts)
    kept = {t for t, df in frequency.items() if df <= 0.995 * n}
    terms = router.fit_terms(rows, n)
    assert {r["term"] for r in terms.collect()} == kept
    assert [r["index"] for r in terms.orderBy("index").collect()] == list(range(len(kept)))
    order = {r["index"]: r["term"] for r in terms.collect()}
    got = features.tfidf_vectors(rows, terms, len(kept)).join(rows.select("complaint_id", "narrative"), "complaint_id")
    long = {}
    for r in features.tfidf_weights(rows, terms, len(kept)).collect():
        long.setdefault(r["complaint_id"], {})[r["term"]] = r["weight"]
    for r in got.collect():
        counts = Counter(terms_of(r["narrative"]))
        weights = {
            t: (1 + math.log(c)) * (math.log((1 + n) / (1 + frequency[t])) + 1)
            for t, c in counts.items()
            if t in kept
        }
        norm = math.sqrt(sum(w * w for w in weights.values()))
        wanted = pytest.approx({t: w / norm for t, w in weights.items()})
        assert r["indices"] == sorted(r["indices"])
        assert {order[i]: v for i, v in zip(r["indices"], r["values"], strict=True)} == wanted
        assert long[r["complaint_id"]] == wanted


def test_terms_are_counted_a_task_at_a_time(spark, monkeypatch):
    """F8, F9: a common term is a row for each of a task's counts, not for each occurrence."""
    texts = ["aa bb aa bb", "aa aa aa", None, "", "cc", "bb aa", "aa bb", "aa bb cc"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    cut = features.narrative_terms(df, "t", "w", pairs=False)
    found = features.counted_terms(cut, "w", pairs=True).cache()
    n, documents = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        n.update(terms)
        documents.update(set(terms))
    expected = {t: (n[t], documents[t]) for t in n}
    assert found.count() <= 2 * len(n)
    for limit in (features.COUNTED_WORDS, 1, 100):
        monkeypatch.setattr(features, "COUNTED_WORDS", limit)
        # The session cuts batches of few rows, so counts of several batches add up.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            kept = router.vocabulary(cut, 1000, minimum_documents=1, column="w", pairs=True)
            assert {r["term"]: (r["term_count"], r["document_count"]) for r in kept.collect()} == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = features.narrative_terms(df, "t")
    kept = router.vocabulary(whole, 1000, minimum_documents=1)
    assert {r["term"]: (r["term_count"], r["document_count"]) for r in kept.collect()} == expected
    assert features.counted_terms(whole.limit(0)).count() == 0


def test_term_frequencies_and_texts_without_terms(spark):
    data = [("a", "b b a a b"), ("n", None), ("e", ""), ("u", "zz zz")]
    df = spark.createDataFrame(data, "k string, t string")
    cut = df.select("k", features.term_frequencies(F.split("t", " ")).alias("f"))
    found = {r["k"]: r["f"] and [tuple(x) for x in r["f"]] for r in cut.collect()}
    assert found == {"a": [("a", 2), ("b", 3)], "n": None, "e": [("", 1)], "u": [("zz", 2)]}
    terms = spark.createDataFrame([("aa", 1.0, 0, [2.0, 4.0])], "term string, idf double, index int, coefficients array<double>")
    texts = spark.createDataFrame([("a", "aa aa qq"), ("n", None), ("e", ""), ("u", "zz zz")], "k string, t string")
    got = {r["k"]: r["products"] for r in features.products(texts, terms, 1, 2, "k", "t").collect()}
    assert got == {"a": [2.0, 4.0], "n": [0.0, 0.0], "e": [0.0, 0.0], "u": [0.0, 0.0]}
    vectors = {r["k"]: (r["indices"], r["values"]) for r in features.tfidf_vectors(texts, terms, 1, "k", "t").collect()}
    assert vectors == {"a": ([0], [1.0]), "n": ([], []), "e": ([], []), "u": ([], [])}


def test_shuffled_and_copied_products_agree(spark, rows, monkeypatch):
    terms = written(router.fit_terms(rows, rows.count()))
    n = terms.count()
    weights = np.random.default_rng(3).normal(size=(n + 1, 3))
    known = written(router.with_coefficients(terms, weights))
    copied = features.products(rows, known, n, 3)
    got = sorted(map(tuple, copied.collect()))
    monkeypatch.setattr(features, "COPIED_CELLS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = features.products(rows, known, n, 3)
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
        again = sorted(map(tuple, shuffled.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [k for k, _ in got] == [k for k, _ in again]
    assert [p for _, p in got] == [pytest.approx(p) for _, p in again]


def dense_problem(seed, n=60, v=7, k=3):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, v)) < 0.4, r.normal(size=(n, v)), 0.0)
    labels = r.integers(0, k, n)
    labels[:k] = range(k)
    return x, labels, {str(i): int((labels == i).sum()) for i in range(k)}


def blocks_of(spark, x, labels):
    rows = []
    for row, label in zip(x, labels, strict=True):
        at = np.flatnonzero(row)
        rows.append((int(label), at.tolist(), row[at].tolist()))
    shape = "label_index int, indices array<int>, values array<double>"
    return solver.pack_rows(spark.createDataFrame(rows, shape).repartition(3))


@pytest.mark.parametrize("classes", [2, 3])
def test_loss_and_gradient_match_dense_sums(spark, classes, monkeypatch):
    monkeypatch.setattr(solver, "PACKED_ROWS", 16)
    monkeypatch.setattr(solver, "GRADIENT_BLOCK", 3)
    x, labels, sizes = dense_problem(1, k=classes)
    balance = solver.Balance.of(sizes)
    objective = solver.Objective(blocks_of(spark, x, labels), x.shape[1], balance, 0.01)
    weights = np.random.default_rng(2).normal(size=objective.shape)
    loss, gradient = objective(weights)
    assert len(loss) == (1 if classes == 2 else 3)
    for k, target in enumerate(balance.targets):
        def total(w, target=target, k=k):
            margin = x @ w[:-1] + w[-1]
            own = labels == target
            even = len(labels) / (classes * (labels == target).sum())
            other = len(labels) / (classes * (labels != target).sum()) if classes == 2 else 1.0
            part = np.where(own, even, other) * np.log1p(np.exp(np.where(own, -margin, margin)))
            return part.mean() + 0.005 * (w[:-1] ** 2).sum()

        assert loss[k] == pytest.approx(total(weights[:, k]))
        for i in range(len(weights)):
            step = np.zeros(len(weights))
            step[i] = 1e-6
            slope = (total(weights[:, k] + step) - total(weights[:, k] - step)) / 2e-6
            assert gradient[i, k] == pytest.approx(slope, abs=1e-6)


def test_solver_reaches_the_minimum_in_passes_that_do_not_grow_with_classes(spark):
    passes = {}
    for classes in (3, 6):
        x, labels, sizes = dense_problem(4, n=90, k=classes)
        objective = solver.Objective(blocks_of(spark, x, labels).cache(), x.shape[1], solver.Balance.of(sizes), 0.05)
        weights = solver.minimize(objective, 60, 1e-9)
        passes[classes] = objective.passes
        assert np.abs(objective(weights)[1]).max() < 2e-3
        steps = solver.descend(objective, 40, 0.2)
        assert (objective(weights)[0] <= objective(steps)[0] + 1e-9).all()
    assert passes[6] < 1.6 * passes[3]


def test_training_scoring_and_reload(spark, rows, folder):
    trained = router.train_router(rows, as_of=AS_OF, minimum_rows=10, workspace=f"{folder}/work")
    model = trained.model
    assert model.classes == ["Garden", "Kitchen"]
    assert 0.25 <= model.temperature <= 4.0
    reports = trained.reports
    unseen = reports["unseen_labels"].collect()
    assert [(r["label"], r["row_count"]) for r in unseen] == [("Sky", 3)]
    got = {r["metric"]: r["value"] for r in reports["evaluation"].collect()}
    assert got["accuracy"] == pytest.approx(18 / 21) and got["test_rows"] == 21
    assert reports["status"].first()["status"] == "available"
    assert {r["month"] for r in reports["drift"].collect()} == {f"{y}-{m:02d}" for y, m in MONTHS}

    cases = rows.unionByName(
        spark.createDataFrame([("blank", AS_OF, "  ", "Garden"), ("null", AS_OF, None, "Garden")], SHAPE)
    )
    scored = {r["complaint_id"]: r for r in model.score(cases).collect()}
    assert len(scored) == rows.count() + 2
    for key in ("blank", "null"):
        assert (scored[key]["predicted_product"], scored[key]["prediction_confidence"]) == (None, None)
        assert scored[key]["prediction_abstained"] is True
    assert scored["fresh-1"]["predicted_product"] == "Garden" and scored["blank"]["narrative"] == "  "
    digest = models.save_model(model, f"{folder}/model")
    again = models.load_model(spark, f"{folder}/model")
    assert (again.temperature, again.threshold, again.classes) == (model.temperature, model.threshold, model.classes)
    assert again.score(cases).exceptAll(model.score(cases)).isEmpty()

    assert models.save_model(again, f"{folder}/model") == digest == models.model_digest(again)
    again.temperature = model.temperature + 1
    other = models.save_model(again, f"{folder}/model")
    assert other != digest and models.current_model(spark, f"{folder}/model") == other
    assert models.load_model(spark, f"{folder}/model", digest).temperature == model.temperature
    stored = spark.read.parquet(f"{folder}/model/{other}/terms")
    stored.limit(stored.count() - 1).write.mode("overwrite").parquet(f"{folder}/model/{digest}/terms")
    with pytest.raises(models.ModelDigestError):
        models.load_model(spark, f"{folder}/model", digest)


def test_three_classes_have_three_margins(spark, rows):
    more = rows.withColumn("label", F.when(F.col("narrative").contains("telescope"), "Sky").otherwise(F.col("product")))
    terms = written(router.fit_terms(more, more.count()))
    weights = router.fit_classifiers(more, terms, router.class_sizes(more))
    known = written(router.with_coefficients(terms, weights))
    model = router.RouterModel(known, ["Garden", "Kitchen", "Sky"], weights[-1].tolist(), len(weights) - 1)
    assert weights.shape[1] == 3
    right = metrics.decide(model.probabilities(more), model.classes).where("label = predicted")
    assert right.count() == more.count()


def test_one_label_cannot_be_routed(spark):
    with pytest.raises(ValueError, match="two labels"):
        router.class_sizes(spark.createDataFrame([("a",)], "label string"))


def test_terms_are_looked_up_without_a_row_for_each(spark, monkeypatch):
    """Keys that come back, or are null, are one text; so they are with a join of rows of terms."""
    data = [("a", "oak elm elm"), ("a", "elm fir zz"), (None, "fir"), (None, "oak fir"), ("n", None), ("z", "zz yy")]
    texts = spark.createDataFrame(data, "k string, t string")
    kept = [("oak", 1.5, 2, [1.0, 2.0]), ("elm", 2.0, 0, [3.0, -1.0]), ("fir", 1.0, 1, [0.5, 4.0])]
    terms = spark.createDataFrame(kept, "term string, idf double, index int, coefficients array<double>")

    def made():
        vectors = features.tfidf_vectors(texts, terms, 3, "k", "t")
        return vectors, features.products(texts, terms, 3, 2, "k", "t")

    def values(tables):
        return [{r["k"]: r[1:] for r in t.collect()} for t in tables]

    tables = made()
    for t in tables:
        assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    got = values(tables)
    monkeypatch.setattr(features, "LOOKED_UP_CELLS", 0)
    joined = values(made())
    assert got[0].keys() == joined[0].keys() == {"a", None, "n", "z"}
    for key in joined[0]:
        assert got[0][key][0] == joined[0][key][0] and got[0][key][1] == pytest.approx(joined[0][key][1])
        assert got[1][key][0] == pytest.approx(joined[1][key][0])


def test_batches_of_blocks_are_bounded_by_bytes(spark):
    own = spark.conf.get(BATCH_BYTES_CONF)
    try:
        spark.conf.unset(BATCH_BYTES_CONF)
        rows = spark.range(40).select(F.lit(0).alias("label_index"), F.array(F.lit(0)).alias("indices"), F.array(F.lit(1.0)).alias("values"))
        solver.Objective(solver.pack_rows(rows), 1, solver.Balance.of({"a": 1, "b": 1}), 0.1)
        blocks = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("sums"))
        sizes = blocks.mapInArrow(lambda bs: (pa.record_batch({"n": [b.num_rows]}) for b in bs), "n long").collect()
        assert len(sizes) > 5 and sum(r["n"] for r in sizes) == 40
        spark.conf.set(BATCH_BYTES_CONF, "1000000")
        solver.pack_rows(rows)
        assert spark.conf.get(BATCH_BYTES_CONF) == "1000000"
    finally:
        spark.conf.set(BATCH_BYTES_CONF, own)
