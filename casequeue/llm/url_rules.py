"""URL filters: host and path rules applied by a sorted sweep over reversed hosts.

``www.example.net`` becomes the key ``net.example.www.``, so a rule for a host and its subdomains is
an interval of keys, from ``net.example.`` up to ``net.example/`` (``/`` follows ``.`` and no host
holds one). Intervals of rules nest or are apart. Urls and the starts and ends of intervals are
sorted together; every event carries the stack of rules that are active after it, and a url takes
the stack of the last event before it. Its path then picks the longest of the active rules.

The sort is cut into key ranges. The stack at the start of a range is that of the last event in any
range before it: one row per range, joined as a broadcast. Urls of one hot host are told apart by a
hash, so they spread over ranges.

A null url, or one without ``://``, has empty host and path. A rule's path must be a prefix of the
url's path as it stands, so an empty path fits only rules with an empty path. Among equally long
rules the longer host wins, then the smaller rule; repeated rules count once, rules with a null
host, path or verdict not at all. Repeated urls are judged one by one. An empty table, or an empty
list of rules, gives no rows, or none but default verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casequeue.llm.common import fresh, handed_over, partitions

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, POINT, END = 0, 1, 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """Start and end of every rule host: ``key, kind, stack`` of what is active afterwards.

    The rules that enclose a host are those of its proper suffixes: a join on key prefixes, as many
    rows as a rule's host has labels.
    """
    by_host = rules.groupBy(host_key(F.col("host")).alias("k")).agg(
        F.array_sort(F.collect_set(F.struct("host", "path", "verdict"))).alias("rules")
    )
    labels = F.size(F.split("k", r"\.", -1)) - 1
    enclosing = by_host.select(
        "k",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), labels),
                lambda i: F.concat(F.array_join(F.slice(F.split("k", r"\.", -1), 1, i), "."), F.lit(".")),
            )
        ).alias("outer"),
    )
    layers = enclosing.join(
        by_host.select(F.col("k").alias("outer"), F.col("rules").alias("layer")), "outer"
    )
    stacks = layers.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct(F.length("outer").alias("n"), "outer", "layer"))).alias("s")
    )
    flat = stacks.select(
        "k",
        F.flatten(F.transform("s", lambda x: x["layer"])).alias("stack"),
        F.flatten(
            F.transform(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), lambda x: x["layer"])
        ).alias("below"),
    )
    start = flat.select(F.col("k").alias("key"), F.lit(START).alias("kind"), "stack")
    end = flat.select(
        F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/")).alias("key"),
        F.lit(END).alias("kind"),
        F.col("below").alias("stack"),
    )
    return start.unionByName(end)


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to the pages; ``rules`` has ``host, path, verdict``.

    Only the columns of ``pages`` that are passed in move: select those that are needed.
    """
    names = fresh(pages, "host", "path", "rule", "verdict")
    host, path, rule, verdict = names
    rules = rules.where(
        F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()
    )
    own = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")
    found_host, found_path = url_parts(F.col(url))
    points = pages.select(own, found_host.alias("host"), found_path.alias("path")).select(
        host_key(F.col("host")).alias("key"), F.lit(POINT).alias("kind"), "page", "host", "path"
    )
    rows = points.unionByName(_events(rules), allowMissingColumns=True)
    order = ["key", "kind", F.xxhash64("path", "page")]
    pieces = partitions(pages.sparkSession)
    placed = rows.withColumn("spread", order[2]).repartitionByRange(pieces, "key", "kind", "spread")
    ranged = handed_over(placed.withColumn("range", F.spark_partition_id()))

    by_range = Window.partitionBy("range").orderBy("key", "kind", "spread")
    # One row per range, each with the stack that its last event leaves.
    last = ranged.where(F.col("kind") != POINT).groupBy("range").agg(
        F.max_by("stack", F.struct("key", "kind")).alias("left")
    )
    ranges = ranged.sparkSession.range(pieces).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(last, "range", "left").select(
        "range", F.last("left", ignorenulls=True).over(before).alias("carried")
    )
    swept = ranged.withColumn("inside", F.last("stack", ignorenulls=True).over(by_range)).where(
        F.col("kind") == POINT
    )
    active = F.coalesce("inside", "carried", F.lit(None).cast(ranged.schema["stack"].dataType))
    stacked = swept.join(F.broadcast(carried), "range", "left").withColumn("active", active)
    fitting = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (-F.length(r["host"]) - F.length(r["path"])).alias("n"),
            (-F.length(r["host"])).alias("h"),
            F.concat(r["host"], r["path"]).alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    best = stacked.withColumn("best", F.array_min(ranked))
    return best.select(
        *(F.col(f"page.`{c}`").alias(c) for c in pages.columns),
        F.col("host").alias(host),
        F.col("path").alias(path),
        F.col("best.rule").alias(rule),
        F.coalesce("best.verdict", F.lit(default)).alias(verdict),
    )
