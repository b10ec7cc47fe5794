"""Queries over token ids. Tokenizer files are parameters and are never copied."""

from __future__ import annotations

import public_tokenizers

from casequeue.llm import packing, token_store
from casequeue.llm.common import table


def op7_token_store(spark, sf_dir):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer)
    return token_store.document_sums(spark, path)


def op9_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


QUERIES = {"op7_token_store": op7_token_store, "op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
