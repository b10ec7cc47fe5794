from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casequeue.llm import packing, token_store
from casequeue.llm.tokens import PieceEncoder
from tests.llm.samples import documents, nothing, texts

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def whole(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_join_to_the_whole(path):
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "B", "e\u0301", "é", "'s", "'re", "1", "23",
             ".", ",", "!!", "…", "漢", "🙂", "<|endoftext|>", "İ", "Σ", "ß", "\u200b", "\u0301", "word"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(3000)]
    made += ["line\n" * 3000, "x" * 5000, *(t or "" for t in texts())]
    encoder, plain = PieceEncoder(path, cache_pieces=50), Tokenizer.from_file(path)
    for text in made:
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_store_round_trip(spark, folder):
    made = texts()
    path = token_store.write_store(documents(spark), BYTES, path=f"{folder}/store")
    got = sorted(tuple(r) for r in token_store.document_sums(spark, path).collect())
    at, want = 0, []
    for i, t in enumerate(made):
        ids = whole(BYTES, t, 0)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    few = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path, [3, 40, 999]).collect()}
    assert few == {i: whole(BYTES, made[i], 0) for i in (3, 40)}


def test_store_of_nothing_and_of_odd_ids(spark, folder):
    path = token_store.write_store(nothing(spark), BYTES, path=f"{folder}/none")
    assert token_store.document_sums(spark, path).count() == 0
    rows = spark.createDataFrame([(None, "b"), (2, "a a"), (2, "a a"), (1, None)], "doc_id long, text string")
    path = token_store.write_store(rows, BYTES, path=f"{folder}/odd")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.document_sums(spark, path).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 3), (6, 2, 3)]


def test_another_dictionary_is_refused(spark, folder):
    path = token_store.write_store(documents(spark), BYTES, path=f"{folder}/store")
    row = spark.createDataFrame([(b"other", "wrong")], "content binary, digest string")
    row.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_store.open_store(spark, path)


def test_packing_covers_every_id_once(spark, monkeypatch):
    made = texts()
    rows = packing.pack_documents(documents(spark), WORDS, capacity=256, group=16).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array(whole(WORDS, made[r["doc_id"]], 1), "<u4")
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"], len(ids)))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by_doc) == list(range(len(made)))
    for parts in by_doc.values():
        at = 0
        for start, length, n in sorted(parts):
            assert start == at
            at += length
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing(spark), WORDS).count() == 0


def test_differencing_is_near_equal_and_padding_small():
    r = random.Random(3)
    sizes = [r.randrange(1, 2048) for _ in range(400)]
    k = -(-sum(sizes) // 2048)
    windows = packing.near_equal(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(400))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) < 600
    assert len(packing.pack(sizes)) == k
    uncut = packing.pack(sizes, cut=False)
    assert all(sum(n for _, _, n in w) <= 2048 for w in uncut)
    assert sorted(p[0] for w in uncut for p in w) == list(range(400))
    assert packing.pack([]) == [] and packing.near_equal([5], 3) == [[0], [], []]
