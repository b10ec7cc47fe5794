"""Windows, weekly strata, proportional caps and the stratified sample."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casequeue.functions.ranges import top_per_group

# Fixed values of the sampling contract.
MAX_RECORDS = 100_000
DEFAULT_COMPLETE_MONTHS = 12
MINIMUM_COMPLETE_MONTHS = 4
STRATUM_DAYS = 7
CURRENT_SUFFIX = "-current-slice"

STRATUM = ("window_name", "stratum_start")


def _month_index(day: date) -> int:
    return day.year * 12 + day.month - 1


def _month_from_index(index: int) -> date:
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class SelectionPlan:
    """Whole months before `as_of`'s month, then the current slice through `as_of`."""

    as_of: date
    max_records: int = MAX_RECORDS
    complete_months: int = DEFAULT_COMPLETE_MONTHS

    def __post_init__(self) -> None:
        if self.max_records < 1:
            raise ValueError("max_records must be at least 1")
        if self.complete_months < MINIMUM_COMPLETE_MONTHS:
            raise ValueError(f"at least {MINIMUM_COMPLETE_MONTHS} complete months are required")

    @property
    def first_start(self) -> date:
        return _month_from_index(_month_index(self.as_of) - self.complete_months)

    @property
    def end_exclusive(self) -> date:
        return self.as_of + timedelta(days=1)

    def columns(self, month_start: Column) -> dict[str, Column]:
        """Window attributes as expressions of the month a row falls in.

        Windows are months, so no join is needed to find a row's window.
        """
        count = self.complete_months + 1
        base, remainder = divmod(self.max_records, count)
        offset = (
            F.year(month_start) * 12
            + F.month(month_start)
            - F.lit(1 + _month_index(self.first_start))
        )
        complete = offset < self.complete_months
        name = F.date_format(month_start, "yyyy-MM")
        return {
            "window_name": F.when(complete, name).otherwise(F.concat(name, F.lit(CURRENT_SUFFIX))),
            "window_start": month_start,
            "window_end": F.when(complete, F.add_months(month_start, 1)).otherwise(
                F.lit(self.end_exclusive)
            ),
            "selection_cap": (
                F.lit(base) + F.when(offset >= count - remainder, 1).otherwise(0)
            ).cast("bigint"),
            "complete_month": complete,
        }


def selection_windows(spark: SparkSession, plan: SelectionPlan) -> DataFrame:
    """One row per window; a remainder of the cap goes to the last windows."""
    months = spark.range(plan.complete_months + 1).select(
        F.add_months(F.lit(plan.first_start), F.col("id").cast("int")).alias("month")
    )
    return months.select(*[c.alias(n) for n, c in plan.columns(F.col("month")).items()])


def assign_window(df: DataFrame, plan: SelectionPlan, received: str = "date_received") -> DataFrame:
    """Rows inside the windows with the window they belong to."""
    day = F.col(received)
    inside = df.where((day >= F.lit(plan.first_start)) & (day < F.lit(plan.end_exclusive)))
    return inside.withColumns(plan.columns(F.trunc(day, "month").cast("date")))


def _stratum_columns(day: Column) -> dict[str, Column]:
    week = F.floor(F.datediff(day, F.col("window_start")) / F.lit(STRATUM_DAYS)).cast("int")
    start = F.date_add(F.col("window_start"), week * STRATUM_DAYS)
    end = F.least(F.date_add(start, STRATUM_DAYS), F.col("window_end"))
    return {"stratum_start": start, "stratum_end": end}


def assign_stratum(windowed: DataFrame, received: str = "date_received") -> DataFrame:
    """Weekly stratum of each row, counted from its window's first day."""
    return windowed.withColumns(_stratum_columns(F.col(received)))


def stratum_calendar(windows: DataFrame) -> DataFrame:
    """Every weekly stratum of every window, including those without rows."""
    starts = F.sequence(
        "window_start", F.date_sub("window_end", 1), F.expr(f"interval {STRATUM_DAYS} days")
    )
    return windows.withColumn("stratum_start", F.explode(starts)).withColumn(
        "stratum_end", F.least(F.date_add("stratum_start", STRATUM_DAYS), F.col("window_end"))
    )


def daily_counts(population: DataFrame, created: str = "date_received") -> DataFrame:
    """Rows per stratum and creation day: the one aggregate all totals come from."""
    day = F.to_date(F.col(created)).alias("day")
    return population.groupBy(*STRATUM, day).agg(F.count("*").alias("rows"))


def stratum_totals(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Population rows of every stratum in the calendar, 0 where there are none."""
    counts = daily.groupBy(*STRATUM).agg(F.sum("rows").alias("rows"))
    return (
        stratum_calendar(windows)
        .join(counts, list(STRATUM), "left")
        .withColumn("source_total", F.coalesce("rows", F.lit(0)).cast("bigint"))
        .withColumn("source_total_relation", F.lit("eq"))
        .drop("rows")
    )


def window_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("window_name").agg(
        F.sum("rows").alias("window_total"), F.lit("eq").alias("window_relation")
    )


def reconcile_totals(strata: DataFrame, totals: DataFrame) -> DataFrame:
    """Per window: strata sum against the window total, where both are exact."""
    summed = strata.groupBy("window_name").agg(
        F.sum("source_total").alias("strata_total"),
        F.every(F.col("source_total_relation") == "eq").alias("strata_exact"),
    )
    window_total = F.coalesce(F.col("window_total"), F.lit(0)).cast("bigint")
    exact = F.col("strata_exact") & (F.coalesce("window_relation", F.lit("eq")) == "eq")
    joined = summed.join(totals, "window_name", "left")
    delta = F.col("strata_total") - window_total
    return joined.select(
        "window_name",
        "strata_total",
        window_total.alias("window_total"),
        delta.alias("delta"),
        exact.alias("exact"),
        (~exact | (delta == 0)).alias("reconciled"),
    )


def require_reconciled(reconciliation: DataFrame) -> DataFrame:
    """The same rows; the job fails on the first window that does not add up."""
    failure = F.raise_error(
        F.concat(F.lit("strata do not add up to window "), F.col("window_name"))
    ).cast("boolean")
    return reconciliation.withColumn(
        "reconciled", F.when(F.col("reconciled"), F.lit(True)).otherwise(failure)
    )


def allocate_caps(strata: DataFrame) -> DataFrame:
    """Share each window's cap over its strata by largest remainder.

    Needs `window_name, stratum_start, source_total, selection_cap`. A window
    has a handful of strata, so the window functions stay small at any size.
    """
    whole = Window.partitionBy("window_name")
    total = F.greatest(F.col("source_total"), F.lit(0))
    cap = F.when(
        F.col("selection_cap") < 0, F.raise_error(F.lit("cap cannot be negative")).cast("bigint")
    ).otherwise(F.col("selection_cap"))
    sized = strata.withColumn("_total", total).withColumn("_sum", F.sum("_total").over(whole))
    target = F.least(cap, F.col("_sum"))
    quota = F.coalesce(
        F.try_divide((F.col("_target") * F.col("_total")).cast("double"), F.col("_sum")),
        F.lit(0.0),
    )
    floors = (
        sized.withColumn("_target", target)
        .withColumn("_quota", quota)
        .withColumn("_floor", F.least(F.floor("_quota"), F.col("_total")).cast("bigint"))
    )
    order = Window.partitionBy("window_name").orderBy(
        F.desc(F.col("_quota") - F.floor("_quota")), F.desc("_total"), F.asc("stratum_start")
    )
    leftover = F.col("_target") - F.sum("_floor").over(whole)
    extra = F.when(
        (F.row_number().over(order) <= leftover) & (F.col("_floor") < F.col("_total")), 1
    ).otherwise(0)
    return floors.withColumn("stratum_cap", F.col("_floor") + extra).drop(
        "_total", "_sum", "_target", "_quota", "_floor"
    )


def stratified_take(
    population: DataFrame,
    caps: DataFrame,
    daily: DataFrame,
    *,
    created: str = "date_received",
    key: str = "complaint_id",
) -> DataFrame:
    """Newest rows of every stratum up to its cap.

    Daily counts decide how many rows each day still gives. Days that give none
    are left out before the shuffle, days that fit are taken whole, and the
    ranking of a cut day is sliced, so no task sorts a whole busy day.
    """
    newer = (
        Window.partitionBy(*STRATUM)
        .orderBy(F.desc("day"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most one row per sampled record; the optimizer sees its size and joins accordingly.
    days = (
        daily.withColumn("_before", F.coalesce(F.sum("rows").over(newer), F.lit(0)))
        .join(caps.select(*STRATUM, "stratum_cap"), list(STRATUM))
        .where(F.col("_before") < F.col("stratum_cap"))
        .select(
            *STRATUM,
            F.col("day").alias("_day"),
            "rows",
            (F.col("stratum_cap") - F.col("_before")).alias("_need"),
        )
        # Slices that balance rows per slice against rows in the last step.
        .withColumn("_slices", F.ceil(F.sqrt(F.col("rows") / F.col("_need"))))
        .drop("rows")
    )
    dated = population.withColumn("_day", F.to_date(F.col(created)))
    offered = dated.join(days, [*STRATUM, "_day"])
    order = [F.desc(created), F.desc(key)]
    taken = top_per_group(
        offered,
        [*STRATUM, "_day"],
        order,
        F.col("_need"),
        rank="_rn",
        slices=F.col("_slices"),
        spread=[key],
    )
    return taken.drop("_day", "_need", "_slices", "_rn")


def dedup_global(
    sample: DataFrame, *, created: str = "date_received", key: str = "complaint_id"
) -> DataFrame:
    """First occurrence of each non-empty id in window order; a hash of the row breaks ties."""
    content = F.xxhash64(*[F.col(c) for c in sample.columns])
    first = Window.partitionBy(key).orderBy(
        "window_start", "stratum_start", F.desc(created), content
    )
    return (
        sample.where(F.coalesce(F.col(key), F.lit("")) != "")
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .drop("_rn")
    )


def retained_per_window(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("window_name").agg(F.count("*").alias("selected_sample_rows"))


def final_cap(sample: DataFrame, n: int, key: str = "complaint_id") -> DataFrame:
    """Newest `n` rows by received date, then id."""
    received = F.coalesce(F.col("date_received").cast("string"), F.lit(""))
    return sample.orderBy(F.desc(received), F.desc(key)).limit(n)


def sampling_report(caps: DataFrame, taken: DataFrame, totals: DataFrame) -> DataFrame:
    """Per stratum: interval, total, cap and rows retrieved, with window sums."""
    retrieved = taken.groupBy(*STRATUM).agg(F.count("*").alias("retrieved"))
    window = Window.partitionBy("window_name")
    window_total = F.coalesce(F.col("window_total"), F.lit(0)).cast("bigint")
    return (
        caps.join(retrieved, list(STRATUM), "left")
        .join(totals, "window_name", "left")
        .select(
            *STRATUM,
            "stratum_end",
            "source_total",
            "source_total_relation",
            "stratum_cap",
            F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
            window_total.alias("window_total"),
            (F.sum("source_total").over(window) - window_total).alias("window_delta"),
        )
    )


def draw_sample(
    spark: SparkSession,
    population: DataFrame,
    plan: SelectionPlan,
    *,
    received: str = "date_received",
    created: str | None = None,
    key: str = "complaint_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample with window columns, caps per stratum, totals per window)."""
    windowed = assign_stratum(assign_window(population, plan, received), received)
    daily = daily_counts(windowed, created or received)
    caps = allocate_caps(stratum_totals(daily, selection_windows(spark, plan)))
    taken = stratified_take(windowed, caps, daily, created=created or received, key=key)
    return taken, caps, window_totals(daily)
