"""Text search by posting lists of three-character grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequeue.functions.ranges import RANGE_ROWS
from casequeue.operators.queue import SEARCHED, search
from casequeue.sources.handover import written
from casequeue.sources.ordered import read_first_keys, write_ordered

GRAM = 3
PROBES = 3  # lists that meet for a column, the shortest ones
_COUNTS = "gram string, part int, n long"
_WILD = ("%", "_")
LIST_ROWS = 256  # ids of a stored list, about
HELD_CHARACTERS = 4_000_000  # of the texts of a block, about
CASE_CHARACTERS = 16  # a case counts for, besides those of its texts
SENT_IDS = 1_000_000  # ids of lists that are copied to all executors, at most
_LISTS = "gram string, part int, block long, ids array<string>"
_PACKED = "gram string, part int, block long, n int, base int, places binary, cases array<string>"
_CASES = "block long, cases array<string>"
_PLACES = "part int, block long, places array<int>"


def _blocks(batches, most: int):
    """Cases put together until they have about `most` characters, equal texts beside each other.

    Columns with few different texts come first in the order, so that their lists are runs of places.
    """

    def ordered(pieces: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(pieces).combine_chunks()
        kinds = [pc.dictionary_encode(c.chunk(0)) for c in table.columns[1:]]
        kinds.sort(key=lambda k: -len(k.dictionary))
        return table.take(pa.array(np.lexsort([k.indices.to_numpy() for k in kinds])))

    held, size = [], 0
    for batch in batches:
        lengths = sum(pc.utf8_length(c).to_numpy() for c in batch.columns[1:])
        until = size + np.cumsum(lengths + CASE_CHARACTERS, dtype=np.int64)
        start = 0
        for end in np.flatnonzero(np.diff(until // most, prepend=0)):
            if pieces := [p for p in (*held, batch.slice(start, end - start)) if p.num_rows]:
                yield ordered(pieces)
            held, start = [], end
        held.append(batch.slice(start))
        size = int(until[-1]) % most if len(until) else size
    if pieces := [p for p in held if p.num_rows]:
        yield ordered(pieces)


def _lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of some texts, where the list of each begins, and the lists: places of the texts that have it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ends = max(0, len(points) - GRAM + 1)
    inside = text_of[:ends] == text_of[len(points) - ends :]  # grams of one text
    number = np.zeros(0x110000, np.int32)  # of a letter among those that occur
    number[points] = 1
    letters = np.flatnonzero(number)
    number[letters] = np.arange(len(letters))
    n, width = max(1, len(texts)), max(1, len(letters))
    given = number[points]
    pairs = given[:ends][inside].astype(np.int64)
    for i in range(1, GRAM):
        pairs *= width
        pairs += given[i : i + ends][inside]
    found = None
    if width**GRAM * n >= 2**63:  # more letters than any script has
        found, pairs = np.unique(pairs, return_inverse=True)
    pairs *= n
    pairs += text_of[:ends][inside]
    pairs.sort()
    once = np.ones(len(pairs), bool)
    once[1:] = pairs[1:] != pairs[:-1]
    pairs = pairs[once]
    gram_of, places = np.divmod(pairs, n)
    begins = np.flatnonzero(np.diff(gram_of, prepend=-1))
    grams = gram_of[begins] if found is None else found[gram_of[begins]]
    spelled = np.stack([letters[grams // width**2], letters[grams // width % width], letters[grams % width]], 1)
    spelled = spelled.astype("<u4").tobytes().decode("utf-32-le")
    return [spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)], begins, places


def _packed(begins: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each list the number of its places, its base and its bytes.

    Bytes are the gaps between places, seven bits in each, or a bit for each place from the base on,
    whichever are fewer. The base of gaps is -1.
    """
    counts = np.diff(begins, append=len(places))
    list_of = np.repeat(np.arange(len(begins)), counts)
    first = places[begins]
    gaps = np.diff(places, prepend=0) - 1
    gaps[begins] = first
    widths = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3))
    before = np.cumsum(widths) - widths
    gap_bytes = np.add.reduceat(widths, begins) if len(begins) else counts
    bit_bytes = ((places[begins + counts - 1] - first) >> 3) + 1
    dense = bit_bytes < gap_bytes
    offsets = np.concatenate([[0], np.cumsum(np.where(dense, bit_bytes, gap_bytes))])
    out = np.zeros(offsets[-1], np.uint8)
    is_dense = dense[list_of]
    at = offsets[list_of] + before - before[begins][list_of]
    for k in range(4):
        some = ~is_dense & (widths > k)
        out[at[some] + k] = (gaps[some] >> 7 * k & 127) | (widths[some] > k + 1) * 128
    bit = places[is_dense] - first[list_of[is_dense]]
    at = offsets[list_of[is_dense]] + (bit >> 3)
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    if len(heads):
        out[at[heads]] = np.add.reduceat(1 << (bit & 7), heads)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]
    return counts, np.where(dense, first, -1), pa.Array.from_buffers(pa.binary(), len(begins), buffers)


def _unpacked(base: int, packed: bytes) -> np.ndarray:
    """The places of a list."""
    held = np.frombuffer(packed, np.uint8)
    if base >= 0:
        return base + np.flatnonzero(np.unpackbits(held, bitorder="little"))
    starts = np.flatnonzero(np.concatenate([[True], held[:-1] < 128]))
    nth = np.arange(len(held)) - np.repeat(starts, np.diff(starts, append=len(held)))
    gaps = np.add.reduceat((held & 127).astype(np.int64) << 7 * nth, starts)
    return np.cumsum(gaps + 1) - 1


def _listing(columns: int, packed: bool):
    """Lists of the cases that have a gram, by column and gram."""
    blocks_of, lists_of, packed_of, most = _blocks, _lists, _packed, HELD_CHARACTERS

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for cases in blocks_of(batches, most):
            block, ids = block + 1, cases.column(0).combine_chunks()
            for part in range(columns):
                grams, begins, places = lists_of(cases.column(part + 1).to_pylist())
                n = len(grams)
                given = {"gram": pa.array(grams, pa.string()), "part": pa.array([part] * n, pa.int32())}
                given["block"] = pa.array([block] * n, pa.int64())
                if packed:
                    counts, bases, held = packed_of(begins, places)
                    given |= {"n": pa.array(counts, pa.int32()), "base": pa.array(bases, pa.int32()), "places": held}
                    given["cases"] = pa.nulls(n, pa.list_(pa.string()))
                else:
                    offsets = pa.array(np.append(begins, len(places)), pa.int32())
                    given["ids"] = pa.ListArray.from_arrays(offsets, ids.take(pa.array(places)))
                yield pa.RecordBatch.from_pydict(given)
            if packed:
                named = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                none = {"n": pa.int32(), "base": pa.int32(), "places": pa.binary()}
                given = {"gram": pa.nulls(1, pa.string()), "part": pa.nulls(1, pa.int32()), "block": pa.array([block], pa.int64())}
                yield pa.RecordBatch.from_pydict(given | {k: pa.nulls(1, t) for k, t in none.items()} | {"cases": named})

    return run


def postings(cases: DataFrame, *, packed: bool = False) -> DataFrame:
    """`gram, part, block, ids`: which cases have a gram in which column (by number).

    Texts are lowered in the JVM, as a search's is. A task gives out the lists of thousands of cases at
    a time, a `block`, so that what is stored and moved is lists, and not a row for each gram of each case.
    With `packed`, `n, base, places, cases` instead of ids: a list holds the places of its `n` cases in
    the block, a bit or a few for each, and a row of each block without a gram has the ids of its `cases`.
    """
    lowered = [F.lower(F.coalesce(F.col(name), F.lit(""))).alias(f"t{i}") for i, name in enumerate(SEARCHED)]
    texts = cases.select(F.col("complaint_id").cast("string"), *lowered)
    return texts.mapInArrow(_listing(len(SEARCHED), packed), _PACKED if packed else _LISTS)


def _with_places():
    """Stored lists with their places as numbers."""
    places_of = _unpacked

    def run(batches):
        for batch in batches:
            part, block, base, packed = batch.columns
            held = [places_of(b, p) for b, p in zip(base.to_pylist(), packed.to_pylist(), strict=True)]
            offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            places = pa.array(np.concatenate([np.empty(0, np.int64), *held]), pa.int32())
            given = [part, block, pa.ListArray.from_arrays(offsets, places)]
            yield pa.RecordBatch.from_arrays(given, names=["part", "block", "places"])

    return run


def write_search_index(cases: DataFrame, path: str, *, rows: int = RANGE_ROWS) -> None:
    """Store the posting lists of all cases, the ids of each block, and the length of each list, below `path`.

    Lists are stored in the order of gram, column and block, in ranges of about `rows` ids, so that the
    list of a common gram is many ranges and a rare one is part of a range.
    """
    made = written(postings(cases, packed=True))
    lists = made.where(F.col("gram").isNotNull()).drop("cases")
    write_ordered(lists, f"{path}/lists", ["gram", "part", "block"], rows=max(1, rows // LIST_ROWS))
    made.where(F.col("gram").isNull()).select("block", "cases").write.mode("error").parquet(f"{path}/cases")
    counts = lists.groupBy("gram", "part").agg(F.sum("n").alias("n"))
    counts.orderBy("gram").write.mode("error").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Ids of cases with a column that holds the rarest grams of `text`.

    None where grams say nothing: a pattern, or a text shorter than a gram.
    """
    lowered = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    if len(lowered) < GRAM or any(w in text for w in _WILD):
        return None
    wanted = sorted({lowered[i : i + GRAM] for i in range(len(lowered) - GRAM + 1)})
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/counts").where(F.col("gram").isin(wanted))
    lengths: dict[int, list] = {}
    for row in counts.collect():  # at most one row per gram of the text and column
        lengths.setdefault(row["part"], []).append((row["n"], row["gram"]))
    probes = {
        part: [g for _, g in sorted(held)[:PROBES]]
        for part, held in lengths.items()
        if len(held) == len(wanted)
    }
    read = read_first_keys(spark, f"{path}/lists", "gram", sorted({g for p in probes.values() for g in p}))
    chosen = F.lit(False)
    for part, held in probes.items():
        chosen = chosen | ((F.col("part") == part) & F.col("gram").isin(held))
    lists = read.where(chosen).select("part", "block", "base", "places").mapInArrow(_with_places(), _PLACES)
    if sum(n for part, held in lengths.items() for n, g in held if g in probes.get(part, ())) <= SENT_IDS:
        lists = F.broadcast(lists)
    named = spark.read.schema(_CASES).parquet(f"{path}/cases").join(lists, "block")
    ids = F.transform("places", lambda place: F.get("cases", place))
    each = named.select("part", F.explode(ids).alias("complaint_id"))
    met = each.groupBy("part", "complaint_id").agg(F.count("*").alias("n"))
    most = min(PROBES, len(wanted))
    return met.where(F.col("n") == most).select("complaint_id").distinct()


def indexed_search(spark: SparkSession, path: str, cases: DataFrame, text: str) -> DataFrame:
    """The rows of `search`, found among the cases that the posting lists name.

    `cases` are those the index was written from, with unique ids. Patterns and short texts scan all cases.
    """
    found = candidates(spark, path, text)
    if found is None:
        return search(cases, text)
    return search(cases.join(found, "complaint_id", "left_semi"), text)
