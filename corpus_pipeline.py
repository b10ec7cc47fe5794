"""Training-data pipeline over ``documents``: filter, drop near copies, redact, mix, pack.

Every stage works on all rows that the stage before it kept, written as Parquet and read again. All
but the last return the columns of ``documents``; the last returns the pieces of packed sequences.
Nulls, empty tables and repeated rows are handled as each operator's module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casequeue.llm import mixing, near_copies, packing, personal_data, quality
from casequeue.llm.common import handed_over, table

TOKENIZER = "word_bpe_49k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject."""
    models = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, models)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.without_copies(docs)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return personal_data.redact(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of one length."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", good_documents),
    ("near_dedup", distinct_documents),
    ("personal_data", redacted_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

# Classifier, signatures and hashed choices have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = handed_over(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
