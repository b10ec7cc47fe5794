"""Router evaluation: calibration, selective metrics, false routes, drift.

Input is one row per scored case: `label`, an array `probabilities` over the
class list, and where needed `received` and `row_id`. Evaluation first reduces
the rows to cells (label x predicted x confidence bin); every metric is then a
small aggregate over the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.functions.probability import argmax_class, class_index, confidence
from casequeue.functions.ranges import running_totals
from casequeue.operators.views import ratio
from casequeue.sources.handover import written

# Fixed values of calibration, abstention and evaluation.
BINS = 10
TARGET_ACCURACY = 0.80
MINIMUM_COVERAGE = 0.50
THRESHOLD_GRID = (0.20, 0.95, 76)
TEMPERATURE_GRID = (0.25, 4.0, 81)
MINIMUM_PROBABILITY = 1e-12
MINIMUM_TEST_ROWS = 50
MINIMUM_CLASS_SUPPORT = 2
FALSE_ROUTE_LIMIT = 20
PSI_EPSILON = 1e-6
GATED_METRICS = (
    "macro_f1",
    "accuracy",
    "ece",
    "brier",
    "coverage",
    "abstention_rate",
    "selective_accuracy",
    "selective_macro_f1",
)


def linear_grid(low: float, high: float, count: int) -> list[float]:
    step = (high - low) / (count - 1)
    return [low + step * i for i in range(count - 1)] + [high]


def geometric_grid(low: float, high: float, count: int) -> list[float]:
    growth = (high / low) ** (1 / (count - 1))
    return [low] + [low * growth**i for i in range(1, count - 1)] + [high]


def decide(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add `predicted, confidence`."""
    return scored.withColumns(
        {
            "predicted": argmax_class(F.col("probabilities"), classes),
            "confidence": confidence(F.col("probabilities")),
        }
    )


def _bin_edges(bins: int) -> list[float]:
    return linear_grid(0.0, 1.0, bins + 1)


def confidence_bin(c: Column, bins: int = BINS) -> Column:
    """Index of `[low, high)`, the last one closed, by comparison with the edges."""
    index = F.lit(0)
    for edge in _bin_edges(bins)[1:-1]:
        index = index + F.when(c >= F.lit(edge), 1).otherwise(0)
    return index


def brier_score(label: Column, probabilities: Column, classes: Sequence[str]) -> Column:
    """Squared distance to the true class; an unseen class adds its missing 1."""
    known = class_index(label, classes)
    distance = F.aggregate(
        F.transform(
            probabilities,
            lambda p, i: F.pow(p - F.when(i + 1 == known, F.lit(1.0)).otherwise(F.lit(0.0)), 2),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return distance + F.when(known == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def evaluation_cells(
    scored: DataFrame, classes: Sequence[str], threshold: float | Column, bins: int = BINS
) -> DataFrame:
    """Counts and sums per label, predicted class and confidence bin.

    The only step that touches scored rows; the result has at most
    labels x classes x bins rows.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = decide(scored, classes).select(
        F.col("label").cast("string").alias("label"),
        "predicted",
        "confidence",
        confidence_bin(F.col("confidence"), bins).alias("bin"),
        (F.col("confidence") >= limit).cast("bigint").alias("accepted"),
        brier_score(F.col("label"), F.col("probabilities"), classes).alias("brier"),
    )
    return rows.groupBy("label", "predicted", "bin").agg(
        F.count("*").alias("n"),
        F.sum("accepted").alias("n_accepted"),
        F.sum("confidence").alias("confidence_sum"),
        F.sum("brier").alias("brier_sum"),
    )


def accuracy_summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy, coverage, abstention, accuracy on accepted rows, Brier."""
    right = F.col("label") == F.col("predicted")

    def total(name: str, only: Column | None = None) -> Column:
        value = F.col(name) if only is None else F.when(only, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    sums = cells.agg(
        total("n").alias("test_rows"),
        total("n_accepted").alias("accepted_rows"),
        total("n", right).alias("right_rows"),
        total("n_accepted", right).alias("right_accepted"),
        F.sum("brier_sum").alias("brier_sum"),
    )
    rows, accepted = F.col("test_rows"), F.col("accepted_rows")
    return sums.select(
        "test_rows",
        "accepted_rows",
        ratio(F.col("right_rows"), rows).alias("accuracy"),
        ratio(accepted, rows).alias("coverage"),
        (F.lit(1.0) - ratio(accepted, rows)).alias("abstention_rate"),
        ratio(F.col("right_accepted"), accepted).alias("selective_accuracy"),
        ratio(F.col("brier_sum"), rows).alias("brier"),
    )


def class_counts(cells: DataFrame) -> DataFrame:
    """Per class: support, predictions and hits, over all and over accepted rows."""

    def side(name: str) -> Column:
        truth, guess = F.lit(name == "label"), F.lit(name == "predicted")
        hit = guess & (F.col("label") == F.col("predicted"))
        counted = {
            "support": truth,
            "predicted_rows": guess,
            "hits": hit,
        }
        fields = [F.col(name).alias("class")]
        for prefix, count in (("", "n"), ("accepted_", "n_accepted")):
            for field, flag in counted.items():
                fields.append(F.when(flag, F.col(count)).otherwise(0).alias(prefix + field))
        return F.struct(*fields)

    sides = cells.select(F.inline(F.array(side("label"), side("predicted"))))
    names = [c for c in sides.columns if c != "class"]
    return sides.groupBy("class").agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def macro_f1(per_class: DataFrame) -> DataFrame:
    """One row: mean F1 over the classes that occur as truth or prediction."""

    def f1(prefix: str) -> Column:
        both = F.col(f"{prefix}support") + F.col(f"{prefix}predicted_rows")
        return F.avg(ratio(F.lit(2) * F.col(f"{prefix}hits"), F.nullif(both, F.lit(0))))

    return per_class.agg(
        f1("").alias("macro_f1"),
        f1("accepted_").alias("selective_macro_f1"),
    )


def reliability_bins(cells: DataFrame, bins: int = BINS) -> DataFrame:
    """Non-empty confidence bins with mean confidence and accuracy."""
    edges = F.array(*[F.lit(e) for e in _bin_edges(bins)])
    right = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    grouped = cells.groupBy("bin").agg(
        F.sum("n").alias("count"),
        F.sum(right).alias("right"),
        F.sum("confidence_sum").alias("confidence_sum"),
    )
    return grouped.select(
        "bin",
        F.element_at(edges, F.col("bin") + 1).alias("lower"),
        F.element_at(edges, F.col("bin") + 2).alias("upper"),
        ratio(F.col("confidence_sum"), F.col("count")).alias("mean_confidence"),
        ratio(F.col("right"), F.col("count")).alias("accuracy"),
        "count",
    )


def expected_calibration_error(cells: DataFrame, bins: int = BINS) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("count")
    return reliability_bins(cells, bins).agg(
        ratio(F.sum(gap), F.sum("count")).alias("ece")
    )


def false_routes(decided: DataFrame, limit: int = FALSE_ROUTE_LIMIT) -> DataFrame:
    """Most frequent wrong routes; equal counts in order of first appearance."""
    wrong = decided.where(F.col("label") != F.col("predicted"))
    return (
        wrong.groupBy(F.col("label").alias("actual"), "predicted")
        .agg(F.count("*").alias("count"), F.min(F.struct("received", "row_id")).alias("_first"))
        .orderBy(F.desc("count"), F.asc("_first"))
        .limit(limit)
        .drop("_first")
    )


def unseen_labels(cells: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Labels the classes lack, with rows and their share of all rows."""
    known = class_index(F.col("label"), classes) > 0
    per_label = cells.groupBy("label").agg(F.sum("n").alias("row_count"))
    total = cells.agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")).scalar()
    return (
        per_label.where(~known)
        .select("label", "row_count", ratio(F.col("row_count"), total).alias("rate"))
        .orderBy("label")
    )


def support_gate(
    cells: DataFrame,
    minimum_rows: int = MINIMUM_TEST_ROWS,
    minimum_class: int = MINIMUM_CLASS_SUPPORT,
) -> DataFrame:
    """One row: whether there are enough rows overall and in every true class."""
    per_label = cells.groupBy("label").agg(F.sum("n").alias("n"))
    return per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observed_rows"),
        F.min("n").alias("smallest_class"),
        F.coalesce(
            (F.sum("n") >= minimum_rows) & (F.min("n") >= minimum_class), F.lit(False)
        ).alias("passed"),
    )


def _as_rows(df: DataFrame, *names: str) -> DataFrame:
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ]
    return df.select(F.inline(F.array(*pairs)))


def evaluate_router(
    cells: DataFrame,
    classes: Sequence[str],
    *,
    minimum_rows: int = MINIMUM_TEST_ROWS,
    minimum_class: int = MINIMUM_CLASS_SUPPORT,
) -> DataFrame:
    """All metrics as `(metric, value)`; below the support gate they are NULL."""
    gate = support_gate(cells, minimum_rows, minimum_class)
    unseen = unseen_labels(cells, classes).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("unseen_rows"),
        F.coalesce(F.sum("rate"), F.lit(0.0)).alias("unseen_rate"),
    )
    rows = (
        _as_rows(
            accuracy_summary(cells),
            "accuracy",
            "coverage",
            "abstention_rate",
            "selective_accuracy",
            "brier",
            "test_rows",
            "accepted_rows",
        )
        .unionByName(_as_rows(macro_f1(class_counts(cells)), "macro_f1", "selective_macro_f1"))
        .unionByName(_as_rows(expected_calibration_error(cells), "ece"))
        .unionByName(_as_rows(unseen, "unseen_rows", "unseen_rate"))
    )
    passed = gate.select("passed").scalar()
    gated = F.col("metric").isin(*GATED_METRICS) & ~passed
    return rows.select("metric", F.when(~gated, F.col("value")).alias("value")).unionByName(
        _as_rows(gate.withColumnRenamed("passed", "support_gate_passed"), "support_gate_passed")
    )


def evaluation_status(cells: DataFrame, **minimums: int) -> DataFrame:
    gate = support_gate(cells, **minimums)
    return gate.select(
        F.when(F.col("passed"), F.lit("available"))
        .otherwise(F.lit("unavailable_insufficient_test_support"))
        .alias("status")
    )


def temperature_losses(
    logits: DataFrame, classes: Sequence[str], temperatures: Sequence[float]
) -> DataFrame:
    """Mean negative log likelihood of known labels at each temperature."""
    target = class_index(F.col("label"), classes)
    known = logits.withColumn("_target", target).where(F.col("_target") > 0)
    heated = known.select(
        "logits",
        F.element_at("logits", F.col("_target").cast("int")).alias("_true"),
        F.array_max("logits").alias("_top"),
        F.explode(F.array(*[F.lit(t) for t in temperatures])).alias("temperature"),
    )
    total = F.aggregate(
        "logits",
        F.lit(0.0),
        lambda a, x: a + F.exp((x - F.col("_top")) / F.col("temperature")),
    )
    p = F.exp((F.col("_true") - F.col("_top")) / F.col("temperature")) / total
    clipped = F.least(F.greatest(p, F.lit(MINIMUM_PROBABILITY)), F.lit(1.0))
    return heated.groupBy("temperature").agg(
        F.avg(-F.log(clipped)).alias("negative_log_likelihood"),
        F.count("*").alias("known_label_rows"),
    )


def fit_temperature(
    logits: DataFrame,
    classes: Sequence[str],
    temperatures: Sequence[float] | None = None,
) -> DataFrame:
    """One row: the temperature with the least loss, the smallest on a tie."""
    grid = temperatures or geometric_grid(*TEMPERATURE_GRID)
    losses = temperature_losses(logits, classes, grid)
    order = F.struct("negative_log_likelihood", "temperature")
    best = losses.agg(F.min(order).alias("b"), F.max("known_label_rows").alias("known"))
    rows = logits.agg(F.count("*").alias("n")).scalar()
    none_known = F.raise_error(F.lit("no label was seen during training")).cast("double")
    return best.select(
        F.when(F.col("b").isNull(), none_known).otherwise(F.col("b.temperature")).alias(
            "temperature"
        ),
        F.col("b.negative_log_likelihood").alias("negative_log_likelihood"),
        F.col("known").alias("known_label_rows"),
        (rows - F.col("known")).alias("unseen_label_rows"),
    )


def threshold_sweep(decided: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """Coverage and accepted accuracy at every observed confidence and grid point.

    Rows are reduced to distinct confidences, then swept once by running totals
    from the most confident down.
    """
    points = grid or linear_grid(*THRESHOLD_GRID)
    session = decided.sparkSession
    observed = decided.groupBy(F.col("confidence").alias("threshold")).agg(
        F.count("*").alias("n"),
        F.sum((F.col("label") == F.col("predicted")).cast("bigint")).alias("right"),
    )
    fixed = session.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in points])).alias("threshold"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("right"),
    )
    # Written once: their number, the ranges, the totals and the sweep read the rows no more.
    candidates = written(
        observed.unionByName(fixed)
        .groupBy("threshold")
        .agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    )
    swept = running_totals(candidates, "threshold", ["n", "right"], descending=True)
    total = candidates.agg(F.sum("n").alias("n")).scalar()
    return swept.select(
        "threshold",
        F.coalesce(ratio(F.col("cum_n"), total), F.lit(0.0)).alias("coverage"),
        F.coalesce(ratio(F.col("cum_right"), F.col("cum_n")), F.lit(0.0)).alias("accuracy"),
    )


def choose_threshold(
    decided: DataFrame,
    *,
    target_accuracy: float = TARGET_ACCURACY,
    minimum_coverage: float = MINIMUM_COVERAGE,
    grid: Sequence[float] | None = None,
) -> DataFrame:
    """One row: the widest threshold that meets both targets, else the best product."""
    t, coverage, accuracy = F.col("threshold"), F.col("coverage"), F.col("accuracy")
    feasible = (coverage >= minimum_coverage) & (accuracy >= target_accuracy)
    # The negated threshold comes last, so the lowest threshold wins ties.
    wide = F.struct(coverage.alias("a"), accuracy.alias("b"), (-t).alias("c"))
    product = F.struct((accuracy * coverage).alias("a"), coverage.alias("b"), (-t).alias("c"))
    choice = F.struct(t, coverage, accuracy)
    best = threshold_sweep(decided, grid).agg(
        F.max_by(choice, F.when(feasible, wide)).alias("meets"),
        F.max_by(choice, product).alias("fallback"),
    )
    return best.select(
        F.coalesce("meets", "fallback").alias("s"), F.col("meets").isNotNull().alias("feasible")
    ).select("s.*", "feasible")


def distribution_drift(
    scored: DataFrame, training: DataFrame, *, received: str = "received"
) -> DataFrame:
    """Month x product shares against training, with PSI terms and month PSI.

    `scored` has `label, predicted` and a date; `training` has `label`. Months
    show every product of training plus those seen in the month.
    """
    month = F.date_format(received, "yyyy-MM")
    pairs = scored.groupBy(month.alias("month"), "label", "predicted").agg(
        F.count("*").alias("n")
    )
    train = training.groupBy(F.col("label").alias("product")).agg(F.count("*").alias("train_n"))

    def side(name: str) -> Column:
        return F.struct(
            F.col(name).alias("product"),
            F.when(F.lit(name == "label"), F.col("n")).otherwise(0).alias("actual_n"),
            F.when(F.lit(name == "predicted"), F.col("n")).otherwise(0).alias("predicted_n"),
        )

    seen = pairs.select("month", F.inline(F.array(side("label"), side("predicted"))))
    # Labels of training are the classes: a short list.
    products = train.agg(F.collect_set("product").alias("p")).scalar()
    zero = F.lit(0).cast("bigint")
    grid = (
        pairs.select("month")
        .distinct()
        .select(
            "month",
            F.explode(products).alias("product"),
            zero.alias("actual_n"),
            zero.alias("predicted_n"),
        )
    )
    counts = (
        seen.unionByName(grid)
        .groupBy("month", "product")
        .agg(F.sum("actual_n").alias("actual_n"), F.sum("predicted_n").alias("predicted_n"))
    )
    whole = Window.partitionBy("month")
    train_total = train.agg(F.sum("train_n").alias("n")).scalar()
    eps = F.lit(PSI_EPSILON)
    shares = (
        counts.join(train, "product", "left")
        .withColumn("sample_size", F.sum("actual_n").over(whole))
        .select(
            "month",
            "product",
            "sample_size",
            F.coalesce(ratio(F.col("train_n"), train_total), F.lit(0.0)).alias("train_share"),
            ratio(F.col("actual_n"), F.col("sample_size")).alias("actual_share"),
            ratio(F.col("predicted_n"), F.col("sample_size")).alias("predicted_share"),
        )
    )
    shift = F.col("actual_share") - F.col("train_share")
    psi = shift * F.log((F.col("actual_share") + eps) / (F.col("train_share") + eps))
    return (
        shares.withColumn("absolute_actual_share_shift", F.abs(shift))
        .withColumn("psi_component", psi)
        .withColumn("actual_vs_train_psi", F.sum("psi_component").over(whole))
    )


_PRODUCT_FIELDS = (
    "product",
    "train_share",
    "actual_share",
    "predicted_share",
    "absolute_actual_share_shift",
    "psi_component",
)


def drift_by_month(drift: DataFrame) -> DataFrame:
    """One row per month with its products nested, in product order."""
    return drift.groupBy("month", "sample_size", "actual_vs_train_psi").agg(
        F.sort_array(F.collect_list(F.struct(*_PRODUCT_FIELDS))).alias("by_product")
    )


def flatten_drift(nested: DataFrame) -> DataFrame:
    """Products of each month as rows that inherit the month; none keeps the month."""
    return nested.select("*", F.inline_outer("by_product")).drop("by_product").withColumnRenamed(
        "month", "period"
    )


def month_role(
    months_newest_first: Column, month: Column, test_months: int
) -> Column:
    """Role of a month counted back from the newest complete one."""
    place = F.array_position(months_newest_first, month)
    return (
        F.when(place <= test_months, "test")
        .when(place == test_months + 1, "threshold")
        .when(place == test_months + 2, "calibration")
        .otherwise("train")
    )


def chronological_split(
    rows: DataFrame, *, as_of: date, test_months: int = 1, received: str = "date_received"
) -> DataFrame:
    """Rows before `as_of`'s month with their `month` and `role`."""
    if test_months < 1:
        raise ValueError("test_months must be positive")
    eligible = rows.where(F.col(received) < F.lit(as_of.replace(day=1))).withColumn(
        "month", F.date_format(received, "yyyy-MM")
    )
    # One entry per calendar month.
    months = eligible.agg(
        F.sort_array(F.collect_set("month"), asc=False).alias("m")
    ).scalar()
    enough = F.size(months) >= test_months + 3
    failure = F.raise_error(
        F.lit("train, calibration, threshold and test months are required")
    ).cast("string")
    role = F.when(enough, month_role(months, F.col("month"), test_months)).otherwise(failure)
    return eligible.withColumn("role", role)


def split_report(split: DataFrame) -> DataFrame:
    return split.groupBy("role").agg(
        F.sort_array(F.collect_set("month")).alias("months"), F.count("*").alias("rows")
    )
