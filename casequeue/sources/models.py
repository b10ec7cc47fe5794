"""Router models as tables in folders named by their content.

A model is its table of terms with coefficients and one row of parameters. The folder's name is a
digest over the sorted rows of both, so the same model is stored once, and a model whose rows were
changed, lost or doubled no longer has the name it is asked for by.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequeue.functions.hashing import row_sha256, rowset_fingerprint
from casequeue.operators.router import RouterModel

TERMS = "term string, idf double, index int, coefficients array<double>"
PARAMETERS = (
    "classes array<string>, intercepts array<double>, features int, temperature double, "
    "threshold double, key string, text string"
)
_SAVED = "digest string, saved_at timestamp"


class ModelDigestError(ValueError):
    """Stored rows are not those of the model that was asked for."""


def _parameters(spark: SparkSession, model: RouterModel) -> DataFrame:
    row = (
        list(model.classes),
        [float(x) for x in model.intercepts],
        int(model.features),
        float(model.temperature),
        float(model.threshold),
        model.key,
        model.text,
    )
    return spark.createDataFrame([row], PARAMETERS)


def _digest(terms: DataFrame, parameters: DataFrame) -> str:
    rows = rowset_fingerprint(terms)
    named = parameters.select(row_sha256(parameters.columns).alias("p"))
    joined = F.concat_ws("|", "row_count", "rowset_sha256", "p")
    # One row each.
    return rows.join(named).select(F.sha2(joined, 256)).first()[0]


def _terms(model: RouterModel) -> DataFrame:
    return model.terms.select("term", "idf", "index", "coefficients")


def model_digest(model: RouterModel) -> str:
    terms = _terms(model)
    return _digest(terms, _parameters(terms.sparkSession, model))


def _read(spark: SparkSession, root: str, digest: str) -> tuple[DataFrame, DataFrame]:
    terms = spark.read.schema(TERMS).parquet(f"{root}/{digest}/terms")
    return terms, spark.read.schema(PARAMETERS).parquet(f"{root}/{digest}/parameters")


def is_stored(spark: SparkSession, root: str, digest: str) -> bool:
    try:
        return _digest(*_read(spark, root, digest)) == digest
    except AnalysisException:  # no such folder
        return False


def save_model(model: RouterModel, root: str) -> str:
    """Store a model below `root` and make it the current one; returns its digest.

    A model that is stored whole is not written again. The entry that names it is appended last, so a
    failed write leaves the model before it current.
    """
    terms = _terms(model)
    spark = terms.sparkSession
    digest = model_digest(model)
    if not is_stored(spark, root, digest):
        terms.write.mode("overwrite").parquet(f"{root}/{digest}/terms")
        _parameters(spark, model).write.mode("overwrite").parquet(f"{root}/{digest}/parameters")
    entry = spark.range(1).select(F.lit(digest).alias("digest"), F.current_timestamp().alias("saved_at"))
    entry.coalesce(1).write.mode("append").json(f"{root}/saved")
    return digest


def current_model(spark: SparkSession, root: str) -> str:
    """Digest of the model saved last."""
    saved = spark.read.schema(_SAVED).json(f"{root}/saved")
    return saved.agg(F.max_by("digest", F.struct("saved_at", "digest"))).first()[0]


def load_model(spark: SparkSession, root: str, digest: str | None = None) -> RouterModel:
    """A stored model, by default the one saved last; refused when its rows have another digest."""
    digest = digest or current_model(spark, root)
    terms, parameters = _read(spark, root, digest)
    rows = parameters.limit(2).collect()
    if len(rows) != 1 or _digest(terms, parameters) != digest:
        raise ModelDigestError(f"model {digest} does not have the rows it was saved with")
    row = rows[0]
    return RouterModel(
        terms,
        list(row["classes"]),
        list(row["intercepts"]),
        row["features"],
        row["temperature"],
        row["threshold"],
        row["key"],
        row["text"],
    )
