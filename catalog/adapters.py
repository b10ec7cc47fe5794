"""Driver tables shaped as case tables, in Spark and as SQL.

Every adapter covers its whole tables. Values the driver data lacks
(predictions, decisions, scores) are derived from columns of the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CASES_SQL = """
shipped AS (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1),
cases AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS complaint_id,
         CAST(o_orderdate AS DATE) AS date_received,
         c_mktsegment AS product,
         substr(o_orderpriority, 3) AS issue,
         c_name AS company,
         n_name AS state,
         substr(o_orderpriority, 1, 1) AS submitted_via,
         CAST(first_ship AS DATE) AS date_sent_to_company,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS timely,
         d.text AS narrative,
         d.text IS NOT NULL AS has_narrative,
         CASE WHEN d.text IS NOT NULL AND o_orderpriority <> '1-URGENT'
              THEN c_mktsegment END AS predicted_product,
         CASE WHEN d.text IS NOT NULL
              THEN (CAST(round(o_totalprice * 1e2) AS BIGINT) % 100) / 1e2
         END AS prediction_confidence,
         d.text IS NULL OR o_orderpriority = '1-URGENT' AS prediction_abstained
  FROM orders o
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN shipped ON l_orderkey = o_orderkey
  LEFT JOIN documents d ON d.doc_id = o_orderkey
)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complaint per order; unused joins and columns are pruned by the optimizer."""
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_shipdate").alias("first_ship"))
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(documents, F.col("doc_id") == F.col("o_orderkey"), "left")
    )
    urgent, has_text = F.col("o_orderpriority") == "1-URGENT", F.col("text").isNotNull()
    cents = F.round(F.col("o_totalprice") * F.lit(100.0)).cast("bigint") % 100
    return joined.select(
        F.col("o_orderkey").cast("string").alias("complaint_id"),
        F.to_date("o_orderdate").alias("date_received"),
        F.col("c_mktsegment").alias("product"),
        F.substring("o_orderpriority", 3, 100).alias("issue"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("state"),
        F.substring("o_orderpriority", 1, 1).alias("submitted_via"),
        F.to_date("first_ship").alias("date_sent_to_company"),
        F.when(F.col("o_orderstatus") == "F", True)
        .when(F.col("o_orderstatus") == "O", False)
        .alias("timely"),
        F.col("text").alias("narrative"),
        has_text.alias("has_narrative"),
        F.when(has_text & ~urgent, F.col("c_mktsegment")).alias("predicted_product"),
        F.when(has_text, cents / F.lit(100.0)).alias("prediction_confidence"),
        (~has_text | urgent).alias("prediction_abstained"),
    )


REVIEWS_SQL = """
reviews AS (
  SELECT CAST(user_id AS VARCHAR) AS complaint_id, event_id AS review_id,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'approve'
              WHEN event_type IN ('click', 'signup') THEN 'override' ELSE 'reject' END AS decision,
         CASE WHEN event_type <> 'error' THEN event_type END AS approved_route,
         ts AS reviewed_at
  FROM events
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY complaint_id ORDER BY reviewed_at DESC, review_id) AS rn FROM reviews)
  WHERE rn = 1
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route decisions: purchase and view approve, click and signup override, the rest reject."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("complaint_id"),
        F.col("event_id").alias("review_id"),
        F.when(kind.isin("purchase", "view"), "approve")
        .when(kind.isin("click", "signup"), "override")
        .otherwise("reject")
        .alias("decision"),
        F.when(kind != "error", kind).alias("approved_route"),
        F.col("ts").alias("reviewed_at"),
    )


OPERATIONAL_SQL = (
    CASES_SQL
    + """,
operational AS (
  SELECT *,
    (prediction_abstained OR timely IS FALSE OR has_narrative IS FALSE)
      AS requires_manual_attention,
    array_to_string(list_filter([
      CASE WHEN prediction_abstained THEN 'uncertain_model_route' END,
      CASE WHEN timely IS FALSE THEN 'untimely_company_response' END,
      CASE WHEN has_narrative IS FALSE THEN 'no_published_narrative' END
    ], lambda r: r IS NOT NULL), ';') AS attention_reasons
  FROM cases
)"""
)

EVENTS_SQL = """
system_events AS (
  SELECT event_type, event_type <> 'error' AS success,
         CAST(round(value) AS BIGINT) AS latency_ms, value / 1e6 AS cost_usd
  FROM events
)"""


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("event_type") != "error").alias("success"),
        F.round("value").cast("bigint").alias("latency_ms"),
        (F.col("value") / F.lit(1e6)).alias("cost_usd"),
    )


def flat_list(df: DataFrame, *names: str) -> DataFrame:
    """Lists as `;`-joined text, so both engines compare scalars."""
    return df.withColumns({n: F.array_join(n, ";") for n in names})


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
