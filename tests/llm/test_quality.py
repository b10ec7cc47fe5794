from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from casequeue.llm import quality
from tests.llm.samples import documents, nothing, texts

SF_DIR = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    models = quality.fit(docs, labels.where(~held))
    scored = quality.score_documents(docs, models).join(labels.where(held), "doc_id")
    share = scored.agg(
        F.avg((((F.col("quality_score") >= 0.5).cast("int")) == F.col("quality")).cast("int")),
        F.avg((((F.col("toxic_score") >= 0.5).cast("int")) == F.col("toxic")).cast("int")),
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("keep").cast("int"))),
    ).first()
    assert share[0] > 0.96 and share[1] > 0.97 and share[2] > 0.99


def test_kept_rows_are_those_scored_to_keep(spark):
    r = random.Random(1)
    made = [("bad%%% words!!" if i % 3 == 0 else "a quiet river of stones") + f" {r.random()}" for i in range(90)]
    made += texts()
    docs = documents(spark, made)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "own") for i in range(80)] + [(None, 1, 0, ""), (3, None, None, "")], LABELS)
    models = quality.fit(docs, labels)
    scored = quality.score_documents(docs, models)
    kept = quality.kept_documents(docs, models)
    assert kept.columns == docs.columns
    assert sorted(x[0] for x in kept.select("doc_id").collect()) == sorted(
        x[0] for x in scored.where("keep").select("doc_id").collect()
    )
    assert {i for i in range(80) if i % 3} <= {x[0] for x in kept.select("doc_id").collect()}


def test_every_unlabelled_document_teaches(spark):
    """A word that no labelled document has is learned from a few documents among many."""
    r = random.Random(2)
    kinds = {"s1": "river stone grass", "s2": "spam%% click!! now%%"}
    made = [(i, f"{kinds['s1' if i % 3 else 's2']} {r.random()}", "s1" if i % 3 else "s2") for i in range(6000)]
    made += [(6000 + i, f"rarity {r.random()}", "s2") for i in range(30)] + [(None, f"rarity {i}", "s2") for i in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "") for i in range(1200)], LABELS)
    view, _ = quality.fit(docs, labels)["quality"]["views"]
    weights, _ = view
    assert weights[quality._WORDS["rarity"][0]] < 0


def test_without_labels_all_stay(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert quality.kept_documents(docs, quality.fit(docs, none)).count() == len(texts())
    one = spark.createDataFrame([(i, 1, 0, "") for i in range(20)], LABELS)
    assert quality.score_documents(docs, quality.fit(docs, one)).where("keep").count() == len(texts())
    empty = nothing(spark)
    assert quality.score_documents(empty, quality.fit(empty, none)).count() == 0


def test_text_alone_is_enough(spark):
    docs = documents(spark).select("doc_id", "text")
    none = spark.createDataFrame([], LABELS)
    assert quality.score_documents(docs, quality.fit(docs, none)).count() == len(texts())


def test_scores_from_written_features_are_those_of_the_texts(spark):
    r = random.Random(3)
    made = [("bad%%% words!!" if i % 3 == 0 else "a quiet river of stones") + f" {r.random()}" for i in range(90)]
    made += texts()
    docs = documents(spark, made)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0), "own") for i in range(80)] + [(3, 1, 1, "")], LABELS)
    for known in (labels, labels.limit(0)):
        wanted = quality.score_documents(docs, quality.fit(docs, known)).collect()
        got = quality.fit_and_score(docs, known).collect()
        key = lambda row: tuple((x is not None, x) for x in (round(v, 6) if isinstance(v, float) else v for v in row))
        assert sorted(map(key, got)) == sorted(map(key, wanted)) and len(got) == docs.count()


def _plain_fit(rows, y, taught, mass):
    """Weights by feature and bias, over sets of features; ``taught`` is a list of (features, value)."""
    ones, zeros = sum(y), len(y) - sum(y)
    told = [sum(1 for _, v in taught if v == value) for value in (0, 1)]
    share = [min(1.0, mass * n / max(1, t)) for n, t in ((zeros, told[0]), (ones, told[1]))]
    names = {f for r in rows for f in r} | {f for r, _ in taught for f in r}
    own = {f: [sum(f in r and v == value for r, v in zip(rows, y, strict=True)) for value in (0, 1)] for f in names}
    new = {f: [sum(f in r and v == value for r, v in taught) for value in (0, 1)] for f in names}
    ratio = {
        f: math.log((own[f][1] + share[1] * new[f][1] + 1) / (ones + share[1] * told[1] + 2))
        - math.log((own[f][0] + share[0] * new[f][0] + 1) / (zeros + share[0] * told[0] + 2))
        for f in names
    }
    used = [f for f in names if sum(own[f]) >= 3 and abs(ratio[f]) >= 1]
    scale = {f: ratio[f] * (4 if f >= 1 << quality.WORD_BITS else 1) for f in used}
    v, squares, bias, bias_square = dict.fromkeys(used, 0.0), dict.fromkeys(used, 1e-8), math.log(ones / zeros), 1e-8
    for _ in range(80):
        error = [1 / (1 + math.exp(-bias - sum(v[f] * scale[f] for f in r if f in v))) - t for r, t in zip(rows, y, strict=True)]
        for f in used:
            g = scale[f] * sum(e for e, r in zip(error, rows, strict=True) if f in r) / len(y) + 1e-5 * v[f]
            squares[f] += g * g
            v[f] -= 0.1 * g / math.sqrt(squares[f])
        b = sum(error) / len(y)
        bias_square += b * b
        bias -= 0.1 * b / math.sqrt(bias_square)
    weights = {f: v[f] * scale[f] for f in used}
    if taught and used:
        n = [zeros + told[0], ones + told[1]]
        rate = n[1] / sum(n)
        for f in names:
            low, high = (own[f][i] + new[f][i] for i in (0, 1))
            both = math.log((high + 2 * rate) / n[1]) - math.log((low + 2 * (1 - rate)) / n[0])
            if sum(own[f]) < 3 <= low + high and abs(both) >= 1:
                weights[f] = sum(v.values()) / len(v) * both
    return weights, bias


def test_views_are_those_of_plain_co_training(spark):
    r = random.Random(4)
    words = {1: "river stone grass cloud", 0: "spam%% click!! now%% win"}

    def made(i):
        value = int(r.random() < 0.6)
        text = " ".join(r.choice(words[value if r.random() < 0.9 else 1 - value].split()) for _ in range(r.randint(2, 5)))
        return i, text, r.choice(["s1", "s1", "s2"] if value else ["s2", "s3", "s1"]), value

    docs = [made(i) for i in range(400)]
    table = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string").repartition(4)
    labels = [(i, v, None, "") for i, _, _, v in docs[:160]]
    got = quality.fit(table, spark.createDataFrame(labels, LABELS))["quality"]["views"]

    features = [
        (set(quality.text_features(t, quality._WORDS).tolist()), set(quality.metadata_features(s, None, None).tolist()))
        for _, t, s, _ in docs
    ]
    packed = [(*(quality._packed_features(np.array(sorted(f), np.int32)) for f in pair), pair, d[3]) for pair, d in zip(features, docs, strict=True)]
    known = sorted(packed[:160], key=lambda p: (zlib.crc32(p[0]), p[0], p[1]))
    train = [p for i, p in enumerate(known) if i % 5]
    judge = [p for i, p in enumerate(known) if i % 5 == 0]
    y = [p[3] for p in train]

    def odds(model, found):
        return model[1] + sum(model[0].get(f, 0.0) for f in found)

    def loss(model, view):
        clipped = [(max(-15.0, min(15.0, odds(model, p[2][view]))), p[3]) for p in judge]
        return sum(math.log1p(math.exp(o)) - v * o for o, v in clipped)

    models = [_plain_fit([p[2][view] for p in train], y, [], 0.0) for view in (0, 1)]
    for _ in range(quality.ROUNDS):
        after = []
        for view in (0, 1):
            taught = []
            for pair in features[160:]:
                p = 1 / (1 + math.exp(-odds(models[1 - view], pair[1 - view])))
                if p <= 0.05 or p >= 0.95:
                    taught.append((pair[view], int(p >= 0.95)))
            tried = [_plain_fit([p[2][view] for p in train], y, taught, mass) for mass in quality.MASSES]
            after.append(min(tried, key=lambda m, view=view: loss(m, view)))
        models = after
    for (weights, bias), (wanted, wanted_bias) in zip(got, models, strict=True):
        assert abs(bias - wanted_bias) < 1e-6
        assert {int(f) for f in np.flatnonzero(weights)} == {f for f, w in wanted.items() if w}
        assert all(abs(weights[f] - w) < 1e-5 for f, w in wanted.items())


def test_lessons_change_what_labelled_rows_have():
    rows = quality.Rows.of([np.array([i % 2], np.int32) for i in range(40)])
    y = np.array([float(i % 4 > 0 if i % 2 else i % 4 > 1) for i in range(40)])
    alone = quality.fit_logistic(rows, y, 2)
    taught = quality.Taught(np.array([900, 0]), np.array([0, 900]), 900, 900)
    more = quality.fit_logistic(rows, y, 2, taught, 1.0)
    assert alone[1] != more[1] and (alone[0] != more[0]).all()
