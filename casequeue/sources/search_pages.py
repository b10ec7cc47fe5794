"""Search-response pages: nested JSON files, one response per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from casequeue.functions.text import clean_text, normalize_source_date, strip, to_bool
from casequeue.schemas import SOURCE_META, SOURCE_RECORD

# `hits` members stay JSON text: their types differ between responses.
_PAGE = StructType(
    [
        StructField(
            "hits",
            StructType([StructField("total", StringType()), StructField("hits", StringType())]),
        ),
        StructField("_meta", SOURCE_META),
    ]
)
_TOTAL = StructType([StructField("value", LongType()), StructField("relation", StringType())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per response: `page, total_json, hits_json, source_meta`."""
    pages = spark.read.schema(_PAGE).option("multiLine", True).json(path)
    return pages.select(
        F.col("_metadata.file_path").alias("page"),
        F.col("hits.total").alias("total_json"),
        F.col("hits.hits").alias("hits_json"),
        F.col("_meta").alias("source_meta"),
    )


def source_total(pages: DataFrame) -> DataFrame:
    """Add `source_total, source_total_relation`: a number or `{value, relation}`."""
    text = F.trim("total_json")
    nested = F.when(text.startswith("{"), F.from_json(text, _TOTAL))
    value = F.coalesce(nested["value"], text.try_cast("bigint"), F.lit(0).cast("bigint"))
    return pages.withColumns(
        {
            "source_total": value,
            "source_total_relation": F.coalesce(nested["relation"], F.lit("eq")),
        }
    )


def search_hits(pages: DataFrame) -> DataFrame:
    """Flatten hits to raw source records; `hits` that is not a list yields none."""
    listed = F.when(F.trim("hits_json").startswith("["), F.col("hits_json"))
    elements = pages.select(F.explode(F.from_json(listed, ArrayType(StringType()))).alias("hit"))
    inner = F.get_json_object("hit", "$._source")
    record = F.from_json(
        F.when(inner.startswith("{"), inner).otherwise(F.col("hit")), SOURCE_RECORD
    )
    return elements.select(record.alias("r")).select("r.*")


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    return search_hits(read_pages(spark, path))


def _reported(name: str) -> Column:
    return clean_text(F.col(name))


def normalize_source(records: DataFrame) -> DataFrame:
    """Raw source records as snapshot rows: trimmed text, ISO dates, booleans."""
    narrative = _reported("complaint_what_happened")
    return records.select(
        F.coalesce(strip(F.col("complaint_id").cast("string")), F.lit("")).alias("complaint_id"),
        normalize_source_date(F.col("date_received")).alias("date_received"),
        *[
            _reported(name).alias(name)
            for name in ("product", "sub_product", "issue", "sub_issue", "company", "state")
        ],
        _reported("submitted_via").alias("submitted_via"),
        normalize_source_date(F.col("date_sent_to_company")).alias("date_sent_to_company"),
        _reported("company_response").alias("company_response"),
        _reported("company_public_response").alias("company_public_response"),
        to_bool(F.col("timely")).alias("timely"),
        narrative.alias("narrative"),
        F.coalesce(to_bool(F.col("has_narrative")), narrative.isNotNull()).alias("has_narrative"),
    )
