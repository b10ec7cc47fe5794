from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from casequeue.llm import mixing, near_copies, personal_data
from casequeue.llm.common import handed_over
from tests.llm.test_near_copies import brute as components

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, handed_over(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["near_dedup"]
    groups = components([(r["doc_id"], r["text"]) for r in before.collect()], near_copies.WORDS)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, _, k) in groups.items() if k}
    before, after = kept["personal_data"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    found = personal_data.find_personal_data(after).where("n_email + n_ip + n_card + n_phone > 0")
    assert found.count() == 0
    before, after = kept["mixing"]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_copies(before).collect() if r["size"] and r["copies"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_run_packs_whole_documents(spark):
    by_sequence, by_doc = defaultdict(int), defaultdict(int)
    tokens = {}
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        by_sequence[r["sequence_id"]] += r["length"]
        by_doc[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert max(by_sequence.values()) <= 2048
    assert all(n % tokens[d] == 0 for d, n in by_doc.items())  # whole copies


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
