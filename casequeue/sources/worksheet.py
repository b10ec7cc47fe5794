"""Review worksheets: ten-column CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casequeue.schemas import WORKSHEET, WORKSHEET_COLUMNS


class WorksheetError(ValueError):
    """A worksheet does not have the template's shape."""


def read_review_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Completed rows. Header, order and width must match the template exactly."""
    header = spark.read.option("header", True).csv(path).columns
    if tuple(header) != WORKSHEET_COLUMNS:
        raise WorksheetError("worksheet columns differ from the template")
    # Without an enforced schema every other file's header is checked as well.
    rows = (
        spark.read.schema(WORKSHEET)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if rows.isEmpty():
        raise WorksheetError("worksheet has no rows")
    return rows


def write_review_template(template: DataFrame, path: str) -> None:
    """Template rows as CSV with a header, blanks as empty fields."""
    template.select(*WORKSHEET_COLUMNS).coalesce(1).write.mode("overwrite").option(
        "header", True
    ).option("emptyValue", "").csv(path)
