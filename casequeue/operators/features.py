"""Sparse text features as rows: term counts, TF-IDF weights, and their product with a weight matrix.

A feature matrix is a table `key, term, weight`, a weight matrix one of `term, coefficients`, and their
product a join on the term. Every text is cut into terms once and in the JVM. Known terms are counted
and weighted in the task that cut the text, so one row for each text is shuffled, not its terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casequeue.functions.text import accent_free, with_bigrams, words
from casequeue.session import bound_batches

# Cells of a term table up to which it is copied to all executors: about 100 MB. A larger one is
# joined by shuffles on the term, whose hot terms adaptive execution splits.
COPIED_CELLS = 8_000_000
# Cells up to which tasks look terms up in a table of their own, without a join.
LOOKED_UP_CELLS = 1_000_000
# Words that a task counts at once, with their pairs: some 200 MB.
COUNTED_WORDS = 2_000_000
SENT_ROWS = 100_000


def narrative_terms(df: DataFrame, text: str, column: str = "terms", pairs: bool = True) -> DataFrame:
    """Adds words of two or more characters without case and accents, and, with `pairs`, their bigrams."""
    if not pairs:
        return df.withColumn(column, words(accent_free(F.col(text))))
    # Named first, so the extraction is not repeated for each bigram side.
    staged = df.withColumn("_words", words(accent_free(F.col(text))))
    return staged.withColumn(column, with_bigrams(F.col("_words"))).drop("_words")


def term_frequencies(terms: Column) -> Column:
    """Array of `term, n` structs of an array of terms, each term once."""
    ordered = F.sort_array(terms)

    def counted(t: Column) -> Column:
        last = F.size(t) - 1
        starts = F.filter(
            F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(t, i - 1) != F.get(t, i))
        )
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(last + 1))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(F.get(t, a).alias("term"), (b - a).alias("n"))
        )

    # One element of a transform names the sorted array, so that it is sorted once.
    found = F.get(F.transform(F.array(ordered), counted), F.lit(0))
    return F.when(F.size(terms) > 0, found)


def counted_terms(df: DataFrame, column: str = "terms", pairs: bool = False) -> DataFrame:
    """`term, term_count, document_count` in some documents each; every row of `df` is a document.

    With `pairs`, `column` has words without spaces, and two neighbours joined by a space are a term, too.
    A term has a row for every `COUNTED_WORDS` elements that a task has read, so a common one has few.
    """
    bound_batches(df.sparkSession)
    fields = StructType.fromDDL("term string, term_count bigint, document_count bigint")

    def each(code, document):
        """Different codes, in order, each with how often it occurs and in how many documents."""
        order = np.argsort(code, kind="stable")  # documents stay in order
        code, document = code[order], document[order]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        first = new | np.append(True, document[1:] != document[:-1])[: len(code)]
        starts = np.flatnonzero(new)
        ends = np.append(starts, len(code))
        return code[starts], np.diff(ends), np.diff(np.append(0, np.cumsum(first))[ends])

    def found(term, n, documents):
        for start in range(0, len(term), SENT_ROWS):
            some = slice(start, start + SENT_ROWS)
            yield pa.RecordBatch.from_arrays(
                [term[some], pa.array(n[some], pa.int64()), pa.array(documents[some], pa.int64())], names=fields.names
            )

    def counted(held):
        lists = pa.concat_arrays(held)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = lists.flatten().dictionary_encode(null_encoding="encode")
        words, known = named.dictionary, len(named.dictionary)
        code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        document = np.repeat(np.arange(len(sizes)), sizes)
        codes, n, documents = each(code, document)
        yield from found(words.take(pa.array(codes)), n, documents)
        if pairs:
            near = document[1:] == document[:-1]
            codes, n, documents = each((code[:-1] * known + code[1:])[near], document[1:][near])
            first, second = (words.take(pa.array(c)) for c in (codes // known, codes % known))
            yield from found(pc.binary_join_element_wise(first, second, " "), n, documents)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(held[-1].flatten())
            if size >= COUNTED_WORDS:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    return df.select(column).mapInArrow(run, fields)


def numbered_terms(vocabulary: DataFrame) -> DataFrame:
    """A bounded vocabulary with `index`, from 0 in its order of frequency."""
    order = Window.orderBy(F.desc("term_count"), "term")  # as many rows as features
    return vocabulary.withColumn("index", (F.row_number().over(order) - 1).cast("int"))


def _looked_up(
    df: DataFrame, terms: DataFrame, key: str, text: str, columns: list[str], shape: str, weighted
) -> DataFrame:
    """`key` and what `weighted` makes of each text's known terms: the columns named in `shape`.

    It gets the number of texts and, of each known term in each text, the text's place, the term's
    place in the table and its weight before normalization; and the columns of the table.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = terms.select("term", "idf", *columns).collect()  # LOOKED_UP_CELLS at most
    table = {"term": pa.array([r["term"] for r in rows], pa.string())}
    table |= {c: np.array([r[c] for r in rows]) for c in ("idf", *columns)}
    sent = spark.sparkContext.broadcast(table)
    fields = StructType([df.select(key).schema[0], *StructType.fromDDL(shape)])

    def run(batches):
        table = sent.value
        known = len(table["term"])
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(lists.flatten(), value_set=table["term"])
            at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            text_of = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
            pairs, n = np.unique(text_of * max(known, 1) + at[at >= 0], return_counts=True)
            place, term = pairs // max(known, 1), pairs % max(known, 1)
            w = (1.0 + np.log(n)) * table["idf"][term]
            made = weighted(len(sizes), place, term, w, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=fields.names)

    cut = narrative_terms(df.select(key, F.coalesce(text, F.lit("")).alias("_text")), "_text")
    return cut.select(key, "terms").mapInArrow(run, fields)


def _lists_of_terms(texts, place, term, w, table):
    order = np.lexsort((table["index"][term], place))
    starts = pa.array(np.searchsorted(place, np.arange(texts + 1)), pa.int32())
    pairs = pa.StructArray.from_arrays(
        [pa.array(table["index"][term][order], pa.int32()), pa.array(w[order])], names=["index", "w"]
    )
    return [pa.ListArray.from_arrays(starts, pairs), _squares(texts, place, w)]


def _summed(texts, place, values):
    return np.bincount(place, values, texts).astype(float)  # integers if there is nothing to add


def _squares(texts, place, w):
    """Sum of the squares of each text's weights; null without known terms."""
    return pa.array(_summed(texts, place, w * w), mask=np.bincount(place, minlength=texts) == 0)


def _sums_of_products(texts, place, term, w, table):
    coefficients = table["coefficients"]
    sums = [_summed(texts, place, w * coefficients[term, k]) for k in range(coefficients.shape[1])]
    return [_squares(texts, place, w), *(pa.array(x) for x in sums)]


def _weighted(df: DataFrame, terms: DataFrame, key: str, text: str, columns: list[str], width: int) -> DataFrame:
    """`key` with the columns of each known term of its text and `w`, the weight before
    normalization; a text with no known term keeps one row of nulls."""
    cut = narrative_terms(df.select(key, F.coalesce(text, F.lit("")).alias("_text")), "_text")
    each = cut.select(key, F.explode_outer(term_frequencies(F.col("terms"))).alias("t")).select(
        key, F.col("t.term").alias("term"), F.col("t.n").alias("n")
    )
    side = terms.select("term", "idf", *columns)
    if width <= COPIED_CELLS:
        side = F.broadcast(side)
    joined = each.join(side, "term", "left")
    damped = F.lit(1.0) + F.log(F.col("n").cast("double"))
    return joined.withColumn("w", damped * F.col("idf")).drop("idf", "n")


def tfidf_vectors(
    df: DataFrame, terms: DataFrame, features: int, key: str = "complaint_id", text: str = "narrative"
) -> DataFrame:
    """`key, indices, values`: unit vectors of texts over `features` terms, indices in order.

    `terms` has `term, idf, index`; `key` identifies a row. A text with no known term has empty arrays.
    """
    # The norm is a sum of its own: an expression over the array would be computed for each element.
    if 0 < 2 * features <= min(LOOKED_UP_CELLS, COPIED_CELLS):
        shape = "f array<struct<index: int, w: double>>, square double"
        known = _looked_up(df, terms, key, text, ["index"], shape, _lists_of_terms)
        # One list, unless a key comes back; a list is in order.
        lists = known.groupBy(key).agg(F.collect_list("f").alias("f"), F.sqrt(F.sum("square")).alias("norm"))
        grouped = lists.withColumn("f", F.when(F.size("f") > 1, F.array_sort(F.flatten("f"))).otherwise(F.get("f", F.lit(0))))
    else:
        known = _weighted(df, terms, key, text, ["index"], 2 * features)
        pair = F.when(F.col("w").isNotNull(), F.struct("index", "w"))
        grouped = known.groupBy(key).agg(
            F.array_sort(F.collect_list(pair)).alias("f"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
        )
    return grouped.select(
        key,
        F.transform("f", lambda x: x["index"]).alias("indices"),
        F.transform("f", lambda x: x["w"] / F.col("norm")).alias("values"),
    )


def tfidf_weights(
    df: DataFrame, terms: DataFrame, features: int, key: str = "complaint_id", text: str = "narrative"
) -> DataFrame:
    """`key, term, weight` of the known terms of each text; squares of a text's weights add up to 1."""
    vectors = tfidf_vectors(df, terms, features, key, text)
    long = vectors.select(key, F.explode(F.arrays_zip("indices", "values")).alias("f"))
    names = terms.select("term", "index")
    if features <= COPIED_CELLS:
        names = F.broadcast(names)
    return long.join(names, F.col("f.indices") == F.col("index")).select(
        key, "term", F.col("f.values").alias("weight")
    )


def products(
    df: DataFrame,
    terms: DataFrame,
    features: int,
    width: int,
    key: str = "complaint_id",
    text: str = "narrative",
) -> DataFrame:
    """`key, products`: each text's unit vector times `width` columns of coefficients.

    `terms` has `term, idf, coefficients`; a text with no known term has zeros.
    """
    cells = features * (width + 2)
    if 0 < cells <= min(LOOKED_UP_CELLS, COPIED_CELLS):
        shape = ", ".join(["square double", *(f"p{k} double" for k in range(width))])
        known = _looked_up(df, terms, key, text, ["coefficients"], shape, _sums_of_products)
        grouped = known.groupBy(key).agg(*[F.sum(c).alias(c) for c in known.columns[1:]])
    else:
        known = _weighted(df, terms, key, text, ["coefficients"], cells)
        sums = [
            F.sum(F.col("w") * F.get("coefficients", F.lit(k))).alias(f"p{k}") for k in range(width)
        ]
        grouped = known.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("square"), *sums)
    each = [F.coalesce(F.col(f"p{k}") / F.sqrt("square"), F.lit(0.0)) for k in range(width)]
    return grouped.select(key, F.array(*each).alias("products"))
