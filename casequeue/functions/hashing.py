"""Canonical JSON and SHA-256 identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON object of the columns: keys sorted, NULL kept.

    The JVM writer spells control characters with upper-case hex; they are
    lowered so that hashes agree with other JSON writers.
    """
    text = F.to_json(
        F.struct(*[F.col(name) for name in sorted(columns)]), {"ignoreNullFields": "false"}
    )
    lowered = text
    for code in _UPPER_ESCAPES:
        # An even run of backslashes before the escape is literal text.
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}"
        )
    return F.when(F.contains(text, F.lit("\\u00")), lowered).otherwise(text)


def row_sha256(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def hash_rank(seed: int, c: Column) -> Column:
    """Seeded order key: SHA-256 hex of `seed|id`."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), c.cast("string")), 256)


LEAF_ROWS = 4_096  # different row hashes of a leaf at most, on average
_LEVELS = 7  # of 256 times as many leaves each


def hash_tree(hashes: DataFrame) -> DataFrame:
    """One row `(row_count, rowset_sha256)` naming a multiset of SHA-256 hex strings `h`.

    Different hashes, sorted, each with its count, make leaves by a prefix; the digests of leaves are
    hashed by the first half of the prefix, and those once more, with the row count. The prefix grows
    by two digits whenever leaves would exceed `LEAF_ROWS` on average, so no node of the tree holds more than
    about the square root of what lies below it. Copies of a row are one counted entry, added up before the shuffle;
    hashes spread evenly, so neither order nor layout of rows matters, nor do hot values.
    """
    counted = hashes.groupBy("h").agg(F.count("*").alias("n"))
    different = counted.agg(F.count("*").alias("d"))
    pairs = sum(
        (F.col("d") > F.lit(LEAF_ROWS * 256**k)).cast("int") for k in range(_LEVELS)
    )
    depth = different.select((pairs * 2).alias("depth")).scalar()

    def digest(entries: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(entries)), ","), 256)

    leaves = counted.groupBy(F.left("h", depth).alias("prefix")).agg(
        digest(F.concat_ws(":", "h", F.col("n").cast("string"))).alias("digest"), F.sum("n").alias("n")
    )
    branches = leaves.groupBy(F.left("prefix", (depth / 2).cast("int")).alias("prefix")).agg(
        digest(F.concat_ws(":", "prefix", "digest")).alias("digest"), F.sum("n").alias("n")
    )
    root = branches.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest"))), ",").alias("all"),
    )
    body = F.concat_ws("|", F.col("row_count").cast("string"), "all")
    return root.select("row_count", F.sha2(body, 256).alias("rowset_sha256"))


def rowset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row `(row_count, rowset_sha256)` naming a multiset of rows in any order."""
    return hash_tree(df.select(row_sha256(columns or df.columns).alias("h")))
