"""The text router: deduplication, TF-IDF features, training and scoring."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.functions.probability import argmax_class, confidence, softmax
from casequeue.functions.text import narrative_group, strip
from casequeue.operators import metrics
from casequeue.operators.features import counted_terms, narrative_terms, numbered_terms, products, tfidf_vectors
from casequeue.operators.solver import Balance, Objective, minimize, pack_rows
from casequeue.sources.handover import shared_folder, written

# Fixed values of the router.
DEFAULT_FEATURES = 40_000
MAX_DOCUMENT_SHARE = 0.995
MANY_TRAINING_ROWS = 1_000
ALPHA = 1e-5
MAX_ITERATIONS = 60
TOLERANCE = 1e-3


def dedup_narratives(rows: DataFrame) -> DataFrame:
    """Earliest row (received date, then id) of each narrative group.

    One row per group and map task reaches the shuffle, so a group that holds
    a third of all copies is no heavier than any other.
    """
    earliest = Window.partitionBy("_group").orderBy("date_received", "complaint_id")
    return (
        rows.withColumn("_group", narrative_group(F.col("narrative")))
        .withColumn("_rn", F.row_number().over(earliest))
        .where("_rn = 1")
        .drop("_group", "_rn")
    )


def dedup_report(rows: DataFrame) -> DataFrame:
    """One row: input rows, narrative groups and excluded copies. Only hashes move."""
    groups = rows.groupBy(narrative_group(F.col("narrative")).alias("g")).agg(
        F.count("*").alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count("*").alias("unique_narrative_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excluded_duplicate_rows"),
    )


def usual_minimum(rows: int) -> int:
    """Documents a term must occur in, by the contract's rule for a training set."""
    return 2 if rows >= MANY_TRAINING_ROWS else 1


def vocabulary(
    terms: DataFrame,
    rows: int,
    *,
    minimum_documents: int,
    features: int | None = None,
    column: str = "terms",
    pairs: bool = False,
) -> DataFrame:
    """`term, term_count, document_count, idf` of the kept terms.

    `features` keeps that many of the most frequent terms, None keeps them all. With `pairs`, `column`
    has only words, and pairs of neighbours are terms, too.

    Tasks count the terms of many documents at once, and a term's counts come from one shuffle of what
    they found. The count that the last kept term must reach comes from a histogram of counts, so the
    final ordering sees little more than the terms it keeps.
    """
    # Dealt by term before they add up: an aggregate before the shuffle would hash and sort the names of
    # pairs again, most of which differ.
    counts = counted_terms(terms, column, pairs).repartition("term").groupBy("term").agg(
        F.sum("term_count").alias("term_count"), F.sum("document_count").alias("document_count")
    )
    kept = counts.where(
        (F.col("document_count") >= minimum_documents)
        & (F.col("document_count") <= F.lit(MAX_DOCUMENT_SHARE) * rows)
    )
    idf = F.log(F.lit(1.0 + rows) / (F.lit(1.0) + F.col("document_count"))) + F.lit(1.0)
    if features is None:
        return kept.withColumn("idf", idf)
    kept = written(kept)  # read twice, and much smaller than what it is made of
    # T occurrences have at most sqrt(2 T) different counts: a short table.
    above = Window.orderBy(F.desc("term_count")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = kept.groupBy("term_count").agg(F.count("*").alias("n"))
    reached = histogram.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    cutoff = reached.where(F.col("above") < features).agg(F.min("term_count").alias("c"))
    return (
        kept.where(F.col("term_count") >= cutoff.scalar())
        .orderBy(F.desc("term_count"), "term")
        .limit(features)
        .withColumn("idf", idf)
    )


def fit_terms(
    train: DataFrame,
    rows: int,
    text: str = "narrative",
    *,
    minimum_documents: int | None = None,
    features: int = DEFAULT_FEATURES,
) -> DataFrame:
    """`term, term_count, document_count, idf, index` of the `features` most frequent terms."""
    least = minimum_documents or usual_minimum(rows)
    cut = narrative_terms(train.select(text), text, pairs=False).select("terms")
    return numbered_terms(vocabulary(cut, rows, minimum_documents=least, features=features, pairs=True))


def class_sizes(train: DataFrame) -> dict[str, int]:
    """Training rows per label, in label order."""
    counts = train.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")
    rows = counts.collect()  # one row per label, for which a model each is fitted
    if len(rows) < 2:
        raise ValueError("training months must contain at least two labels")
    return {r["label"]: r["n"] for r in rows}


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def labelled_blocks(
    train: DataFrame, terms: DataFrame, features: int, classes: list[str], key: str, text: str
) -> DataFrame:
    """Packed vectors of training rows with the place of their label in `classes`."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    labels = train.select(key, place.cast("int").alias("label_index"))
    vectors = tfidf_vectors(train, terms, features, key, text).join(labels, key)
    # Every pass computes on all of them, so they are dealt evenly, however few bytes they are.
    return pack_rows(vectors.repartition(_tasks(train)))


def with_coefficients(terms: DataFrame, weights: np.ndarray) -> DataFrame:
    """Terms with the row of weights at their index, as `coefficients`."""
    rows = [(i, row) for i, row in enumerate(weights[:-1].tolist())]
    shape = "index int, coefficients array<double>"
    return terms.join(F.broadcast(terms.sparkSession.createDataFrame(rows, shape)), "index")


def fit_classifiers(
    train: DataFrame, terms: DataFrame, sizes: dict[str, int], key: str = "complaint_id", text: str = "narrative"
) -> np.ndarray:
    """Weights of balanced logistic models, one per class against the rest, terms by classes.

    The last row holds the intercepts. Two classes share one model, the second one's.
    """
    features = terms.agg(F.count("*")).first()[0]
    blocks = labelled_blocks(train, terms, features, list(sizes), key, text).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        objective = Objective(blocks, features, Balance.of(sizes), ALPHA)
        return minimize(objective, MAX_ITERATIONS, TOLERANCE)
    finally:
        blocks.unpersist()


@dataclass
class RouterModel:
    """Terms with their coefficients, and the calibration that turns margins into decisions.

    `terms` has `term, idf, index, coefficients`, one coefficient for each model.
    """

    terms: DataFrame
    classes: list[str]
    intercepts: list[float]
    features: int
    temperature: float = 1.0
    threshold: float = 0.0
    key: str = "complaint_id"
    text: str = "narrative"

    def logits(self, df: DataFrame) -> DataFrame:
        """Add `logits`: one margin per class; two classes share one margin.

        `key` identifies a row; the product is a join of its terms with the model's.
        """
        width = len(self.intercepts)
        found = products(df, self.terms, self.features, width, self.key, self.text)
        margins = [F.get("products", F.lit(k)) + F.lit(self.intercepts[k]) for k in range(width)]
        if len(self.classes) == 2:
            margins = [-margins[0] / F.lit(2.0), margins[0] / F.lit(2.0)]
        return df.join(found.select(self.key, F.array(*margins).alias("logits")), self.key, "left")

    def probabilities(self, df: DataFrame) -> DataFrame:
        return self.logits(df).withColumn(
            "probabilities", softmax(F.col("logits"), self.temperature)
        )

    def score(self, df: DataFrame) -> DataFrame:
        """Add class, confidence and abstention; rows without text abstain."""
        has_text = F.coalesce(strip(F.col(self.text)), F.lit("")) != ""
        p = F.col("probabilities")
        # A row without a key meets no scores; it abstains like one without text.
        scored = has_text & p.isNotNull()
        return (
            self.probabilities(df)
            .withColumns(
                {
                    "predicted_product": F.when(scored, argmax_class(p, self.classes)),
                    "prediction_confidence": F.when(scored, confidence(p)),
                    "prediction_abstained": ~scored
                    | F.coalesce(confidence(p) < self.threshold, F.lit(True)),
                }
            )
            .drop("logits", "probabilities")
        )


def apply_scores(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases with the predictions of a score table; unscored cases abstain."""
    predictions = ("predicted_product", "prediction_confidence", "prediction_abstained")
    has_text = F.coalesce(strip(F.col("narrative")), F.lit("")) != ""
    joined = cases.drop(*predictions).join(
        scores.select("complaint_id", *predictions), "complaint_id", "left"
    )
    return joined.withColumns(
        {
            "predicted_product": F.when(has_text, F.col("predicted_product")),
            "prediction_confidence": F.when(has_text, F.col("prediction_confidence")),
            "prediction_abstained": ~has_text
            | F.coalesce(F.col("prediction_abstained"), F.lit(True)),
        }
    )


def score_counts(cases: DataFrame) -> DataFrame:
    """One row: cases with a text to score, and cases that abstain for lack of one."""
    has_text: Column = F.coalesce(strip(F.col("narrative")), F.lit("")) != ""
    return cases.agg(
        F.count_if(has_text).alias("scored_count"),
        F.count_if(~has_text).alias("no_narrative_abstained_count"),
    )


@dataclass
class TrainingResult:
    model: RouterModel
    reports: dict[str, DataFrame]


def train_router(
    rows: DataFrame,
    *,
    as_of: date,
    test_months: int = 1,
    minimum_rows: int = metrics.MINIMUM_TEST_ROWS,
    minimum_class: int = metrics.MINIMUM_CLASS_SUPPORT,
    minimum_documents: int | None = None,
    max_features: int = DEFAULT_FEATURES,
    workspace: str | None = None,
) -> TrainingResult:
    """Train, calibrate and evaluate on complete months, oldest to newest.

    `rows` are eligible narratives. Copies are removed before the split, so a
    text never sits on both sides of it. Deduplicated rows and the model's terms are written
    to `workspace`, a folder that all executors see, by default a new one in the shared folder.
    """
    workspace = workspace or shared_folder(rows.sparkSession)
    # Texts are cut into terms several times from here on, so they are dealt evenly once.
    unique = written(dedup_narratives(rows).repartition(_tasks(rows)), f"{workspace}/unique")
    split = metrics.chronological_split(
        unique, as_of=as_of, test_months=test_months
    ).withColumnRenamed("product", "label")
    train = split.where("role = 'train'")
    sizes = class_sizes(train)
    terms = written(
        fit_terms(train, sum(sizes.values()), minimum_documents=minimum_documents, features=max_features),
        f"{workspace}/terms",
    )
    weights = fit_classifiers(train, terms, sizes)
    model = RouterModel(
        written(with_coefficients(terms, weights), f"{workspace}/model"),
        list(sizes),
        weights[-1].tolist(),
        len(weights) - 1,
    )

    def kept_row(report: DataFrame) -> tuple[DataFrame, dict]:
        """A one-row report and its values, computed once."""
        row = report.first()
        return report.sparkSession.createDataFrame([row], report.schema), row.asDict()

    temperature, fitted = kept_row(
        metrics.fit_temperature(
            model.logits(split.where("role = 'calibration'")), model.classes
        )
    )
    model.temperature = fitted["temperature"]
    held_out = metrics.decide(
        model.probabilities(split.where("role = 'threshold'")), model.classes
    )
    threshold, chosen = kept_row(metrics.choose_threshold(held_out))
    model.threshold = chosen["threshold"]

    def scored(part: DataFrame) -> DataFrame:
        rows = metrics.decide(model.probabilities(part), model.classes)
        return rows.withColumnsRenamed({"date_received": "received", "complaint_id": "row_id"})

    # Several reports read the scored test months; the wide columns are not kept.
    test = (
        scored(split.where("role = 'test'"))
        .select("row_id", "received", "label", "probabilities", "predicted", "confidence")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    cells = metrics.evaluation_cells(test, model.classes, model.threshold)
    minimums = {"minimum_rows": minimum_rows, "minimum_class": minimum_class}
    passed = metrics.support_gate(cells, **minimums).select("passed").scalar()
    reports = {
        "split": metrics.split_report(split),
        "duplicates": dedup_report(rows),
        "temperature": temperature,
        "threshold": threshold,
        "status": metrics.evaluation_status(cells, **minimums),
        "evaluation": metrics.evaluate_router(cells, model.classes, **minimums),
        # Below the support gate the listings stay empty.
        "calibration_bins": metrics.reliability_bins(cells).where(passed),
        "false_routes": metrics.false_routes(test).where(passed),
        "unseen_labels": metrics.unseen_labels(cells, model.classes),
        "drift": metrics.distribution_drift(scored(split), train),
    }
    return TrainingResult(model, reports)
