"""Binary store of token ids: documents compressed one by one with a shared zstandard dictionary.

The dictionary is trained on the serialized ids of a bounded sample of documents (``SAMPLE_DOCS`` by
hash of the id, ``SAMPLE_IDS`` ids of each). A store is a Parquet folder of blocks, one row each, in
ascending order of the document id:

``bucket, block``  place of the block in the order; ``start`` ids of its bucket before it
``first_doc, last_doc``  range of its document ids, for row-group pruning
``doc_ids, tokens, offsets``  index: id, number of ids and place in ``payload`` of each document
``id_bytes``  bytes of one little-endian id; ``dictionary``  SHA-256 of the dictionary
``payload``  the documents' zstandard frames, one after another

A short document is read by decompressing its own frame alone. The dictionary lies beside the
blocks in the same folder. Readers check its hash.

Null texts are empty documents, which hold the end id alone. Null ids come first, equal ids in the
order of their bytes; an empty table makes a store without blocks.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequeue.llm.common import cut_at, partitions, quantile_bounds, shared_folder
from casequeue.llm.tokens import encoder_of

SAMPLE_DOCS = 2_000
SAMPLE_IDS = 4_096
SAMPLE_CHARS = 40_000
DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 1 << 20
LEVEL = 1

BLOCK_SCHEMA = (
    "bucket int, block int, start long, first_doc long, last_doc long, doc_ids array<long>, "
    "tokens array<long>, offsets array<long>, id_bytes int, dictionary string, payload binary"
)
FRAME_SCHEMA = "bucket int, doc_id long, tokens long, frame binary"


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from a bounded sample, trained on the driver; empty without usable samples."""
    import zstandard

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = (
        docs.where(F.col("text").isNotNull())
        .join(F.broadcast(chosen.distinct()), "doc_id")  # at most SAMPLE_DOCS ids
        .select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        .limit(SAMPLE_DOCS)
        .collect()
    )
    texts.sort(key=lambda r: (r["doc_id"], r["text"]))
    encoder = encoder_of(tokenizer)
    samples = [encoder.encode(r["text"])[: SAMPLE_IDS * encoder.width] for r in texts]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their bytes themselves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def _digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _frames(tokenizer: str, dictionary: bytes, end_id: int):
    def encode(batches):
        import zstandard

        encoder = encoder_of(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        for batch in batches:
            tokens, frames = [], []
            for text in batch.column(2):
                ids = encoder.encode(text.as_py() or "") + end
                tokens.append(len(ids) // encoder.width)
                frames.append(packer.compress(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(frames, pa.binary())],
                names=["bucket", "doc_id", "tokens", "frame"],
            )

    return encode


def _blocks(id_bytes: int, digest: str):
    """Documents of a sorted partition, joined to blocks; a block lies in one bucket."""

    def row(bucket, block, start, held):
        offsets = np.cumsum([0] + [len(f) for _, _, f in held])[:-1].tolist()
        known = [d for d, _, _ in held if d is not None]
        return {
            "bucket": bucket,
            "block": block,
            "start": start,
            "first_doc": min(known, default=None),
            "last_doc": max(known, default=None),
            "doc_ids": [d for d, _, _ in held],
            "tokens": [t for _, t, _ in held],
            "offsets": offsets,
            "id_bytes": id_bytes,
            "dictionary": digest,
            "payload": b"".join(f for _, _, f in held),
        }

    schema = pa.schema(
        [("bucket", pa.int32()), ("block", pa.int32()), ("start", pa.int64())]
        + [("first_doc", pa.int64()), ("last_doc", pa.int64())]
        + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "tokens", "offsets")]
        + [("id_bytes", pa.int32()), ("dictionary", pa.string()), ("payload", pa.binary())]
    )

    def build(batches):
        bucket, block, start, held, size = None, 0, 0, [], 0
        for batch in batches:
            for at, doc, tokens, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (at != bucket or size >= BLOCK_BYTES):
                    yield pa.RecordBatch.from_pylist([row(bucket, block, start, held)], schema)
                    block, start = block + 1, start + sum(t for _, t, _ in held)
                    held, size = [], 0
                if at != bucket:
                    bucket, block, start = at, 0, 0
                held.append((doc, tokens, frame))
                size += len(frame)
        if held:
            yield pa.RecordBatch.from_pylist([row(bucket, block, start, held)], schema)

    return build


def write_store(docs: DataFrame, tokenizer: str, *, end_id: int = 0, path: str | None = None) -> str:
    """Encodes ``doc_id, text`` and writes a store; returns its path (in the shared folder if None)."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, tokenizer)
    width = encoder_of(tokenizer).width
    pieces = partitions(spark)
    bounds = quantile_bounds(docs, "doc_id", 2 * pieces)
    rows = docs.select(
        cut_at(F.col("doc_id"), bounds).alias("bucket"), F.col("doc_id").cast("long"), "text"
    )
    frames = rows.mapInArrow(_frames(tokenizer, dictionary, end_id), FRAME_SCHEMA)
    ordered = frames.repartition(pieces, "bucket").sortWithinPartitions(
        "bucket", F.asc_nulls_first("doc_id"), "frame"
    )
    blocks = ordered.mapInArrow(_blocks(width, _digest(dictionary)), BLOCK_SCHEMA)
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(dictionary, _digest(dictionary))], "content binary, digest string").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")
    return path


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """Blocks and dictionary of a store."""
    found = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(found["content"])
    if _digest(content) != found["digest"]:
        raise ValueError(f"the dictionary in {path} does not have its recorded hash")
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks"), content


def _unpack(dictionary: bytes, digest: str):
    """Frames of blocks as ids: a function of a block's columns, given as a dict of lists."""
    import zstandard

    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def documents(block: dict):
        if block["dictionary"] != digest:
            raise ValueError("a block was written with another dictionary")
        payload, offsets = block["payload"], [*block["offsets"], len(block["payload"])]
        kind = np.dtype(f"<u{block['id_bytes']}")
        for i, doc in enumerate(block["doc_ids"]):
            frame = payload[offsets[i] : offsets[i + 1]]
            yield i, doc, np.frombuffer(opener.decompress(frame), kind)

    return documents


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a store.

    ``start`` counts the ids of all documents before it. The sums of buckets, a few times the number
    of partitions, are the only rows that meet in one task.
    """
    from pyspark.sql import Window

    blocks, dictionary = open_store(spark, path)
    digest = _digest(dictionary)
    sums = blocks.groupBy("bucket").agg(F.sum(F.expr("aggregate(tokens, 0L, (a, t) -> a + t)")).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches):
        documents = _unpack(dictionary, digest)
        for batch in batches:
            for block in batch.to_pylist():
                at, rows = block["base"] + block["start"], []
                for i, doc, ids in documents(block):
                    n = block["tokens"][i]
                    if n != len(ids):
                        raise ValueError("a document does not have the recorded number of ids")
                    rows.append((doc, at, n, zlib.crc32(ids.astype("<u4").tobytes())))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.join(F.broadcast(starts), "bucket").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents: blocks by their id range, then single frames."""
    blocks, dictionary = open_store(spark, path)
    digest, wanted = _digest(dictionary), frozenset(doc_ids)
    between = F.lit(False)
    for d in sorted(wanted):
        between = between | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def read(batches):
        documents = _unpack(dictionary, digest)
        for batch in batches:
            for block in batch.to_pylist():
                ends = [*block["offsets"], len(block["payload"])]
                at = [i for i, d in enumerate(block["doc_ids"]) if d in wanted]
                frames = [block["payload"][ends[i] : ends[i + 1]] for i in at]
                few = block | {
                    "doc_ids": [block["doc_ids"][i] for i in at],
                    "offsets": np.cumsum([0] + [len(f) for f in frames])[:-1].tolist(),
                    "payload": b"".join(frames),
                }
                rows = [{"doc_id": d, "ids": ids.tolist()} for _, d, ids in documents(few)]
                kinds = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return blocks.where(between).mapInArrow(read, "doc_id long, ids array<long>")
