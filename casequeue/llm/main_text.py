"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with the path of tags and classes from the root to its
element. Per page and path the text that is in no link, its punctuation and the number of nodes are
summed. The ratios of text to nodes and of punctuation to nodes are smoothed along the tree of paths,
each path taking half of its own ratio and half of the smoothed ratio of the path above it, counted
over all that hangs there; so a short heading among long paragraphs stands with them and a long line in a
menu falls. Their geometric mean is held against a share of its mean over the page's text. The nodes on
paths above it are content; the narrowest element with nearly all content, or the articles of the page
if these hold most of it, is the main part, and every block in it is returned, in page order, except those on
paths that are mostly links. Elements and class names that say what they are (menus, adverts, notices,
comments and the like, ``html_blocks.BARRED_WORDS``) never take part.

A page depends on nothing but its own html, so pages are read where they lie, in batches bounded by
bytes, with no shuffle. Null or empty html and pages with no content have an empty text. Any text is read, however broken:
markup that never closes ends with the page. Very long pages take memory in proportion to their
length. Repeated rows, null ids and an empty table are kept as they are; other columns are not touched,
and a column named like an output is replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequeue.llm.common import bound_batches
from casequeue.llm.html_blocks import Block, Page, read_page

OWN_SHARE = 0.5  # of a path's own ratio; the rest comes from the paths above
LEAST_SHARE = 0.15  # of the page's mean ratio that content has at least
CONTAINED = 0.7  # share of content that makes an element the main part
MOSTLY_LINKS = 0.5


def _path_scores(page: Page, blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused ratio of each path with blocks."""
    n = len(page.path_parents)
    own = [[0, 0, 0] for _ in range(n)]  # free characters, punctuation, nodes
    for b in blocks:
        sums = own[b.path]
        sums[0] += len(b.text) - b.linked
        sums[1] += b.punctuation
        sums[2] += 1
    below = [sums.copy() for sums in own]
    for path in range(n - 1, 0, -1):  # paths above come first
        for i, value in enumerate(below[path]):
            below[page.path_parents[path]][i] += value
    smooth = [[0.0, 0.0] for _ in range(n)]  # over all that hangs on a path
    scores = {}
    for path in range(n):
        above = smooth[page.path_parents[path]]
        for i in (0, 1):
            whole = below[path][i] / max(1, below[path][2])
            smooth[path][i] = whole if path == 0 else OWN_SHARE * whole + (1 - OWN_SHARE) * above[i]
        if own[path][2]:
            text, marks = (
                OWN_SHARE * own[path][i] / own[path][2] + (1 - OWN_SHARE) * above[i] for i in (0, 1)
            )
            scores[path] = math.sqrt(text * (1.0 + marks))
    return scores


def _content(page: Page, blocks: list[Block]) -> list[Block]:
    """Blocks on paths whose score reaches a share of the mean over the page's text."""
    scores = _path_scores(page, blocks)
    weights = [len(b.text) - b.linked for b in blocks]
    total = sum(weights)
    if not total:
        return []
    mean = sum(w * scores[b.path] for w, b in zip(weights, blocks, strict=True)) / total
    return [b for b in blocks if scores[b.path] >= LEAST_SHARE * mean]


def _main_nodes(page: Page, blocks: list[Block], content: list[Block]) -> list[bool]:
    """Which nodes lie in the main part of the page."""
    n = len(page.parents)
    weight = [0] * n
    holds = [0] * n  # blocks of each node
    for b in content:
        weight[b.node] += len(b.text) - b.linked
    for b in blocks:
        holds[b.node] += 1
    inner = [False] * n  # has elements with blocks
    for node in range(n - 1, 0, -1):
        above = page.parents[node]
        weight[above] += weight[node]
        inner[above] = inner[above] or inner[node] or holds[node] > 0
    outer = [False] * n  # articles inside of no other
    covered = [False] * n
    for node in range(n):
        above = covered[page.parents[node]] if node else False
        outer[node] = page.main[node] and not above
        covered[node] = above or page.main[node]
    if sum(weight[node] for node in range(n) if outer[node]) >= CONTAINED * weight[0]:
        roots = {node for node in range(n) if outer[node]}
    else:
        root = 0
        for node in range(1, n):  # an element comes before those in it
            if page.parents[node] == root and inner[node] and weight[node] >= CONTAINED * weight[root]:
                root = node
        roots = {root}
    inside = [False] * n
    for node in range(n):
        inside[node] = node in roots or node > 0 and inside[page.parents[node]]
    return inside


def main_blocks(source: str) -> list[str]:
    """Texts of the blocks of a page's main part."""
    page = read_page(source)
    blocks = [b for b in page.blocks if not b.barred]
    content = _content(page, blocks)
    if not content:
        return []
    inside = _main_nodes(page, blocks, content)
    linked: dict[int, int] = {}
    length: dict[int, int] = {}
    for b in blocks:
        linked[b.path] = linked.get(b.path, 0) + b.linked
        length[b.path] = length.get(b.path, 0) + len(b.text)
    return [
        b.text for b in blocks if inside[b.node] and linked[b.path] < MOSTLY_LINKS * length[b.path]
    ]


def main_text(source: str | None) -> str:
    return "\n\n".join(main_blocks(source)) if source else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the column ``html``, and ``n_chars``, its code points."""
    bound_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extracted(sources: pa.Array) -> pa.Array:
        return pa.array((main_text(source.as_py()) for source in sources), pa.string())

    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, extracted(F.col(html)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
