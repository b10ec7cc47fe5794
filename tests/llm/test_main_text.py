from __future__ import annotations

import time

import pytest

from casequeue.llm.html_blocks import read_page
from casequeue.llm.main_text import extract_text, main_blocks, main_text

LONG = "The council met on Monday, and after two hours of debate it agreed on the plan. Nobody was surprised."
MORE = "Work starts in spring, said the mayor; the bridge will stay open to walkers while it is repaired."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p>a{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("name", "body", "wanted"),
    [
        ("article", f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}<p>Is.</article><footer>{MORE}</footer>",
         ["Head", LONG, "Is."]),
        ("no article", f"<div class=top><a href=a>Home</a> | <a href=b>News</a></div><div id=story><h2>Head</h2><p>{LONG}</p><p>{MORE}</p></div>"
         "<div>Short line</div>", ["Head", LONG, MORE]),
        ("text in a cell", f"<table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>",
         [LONG, MORE]),
        ("comments", f"<main><p>{LONG}</p><section class='post-comments'><article class=comment><p>{MORE} {MORE}</p></article></section></main>",
         [LONG]),
        ("sidebar, notice, advert, form", f"<div class='cookie-notice'><p>{MORE}</p></div><aside><p>{MORE}</p></aside><div class='ad'>{MORE}</div>"
         f"<article><p>{LONG}</p><form><p>{MORE}</p><button>Go</button></form></article><div id=sidebar><p>{MORE}</p></div>", [LONG]),
        ("page inside a form", f"<form id=aspnet><div class=menu>{MORE}</div><article><p>{LONG}</p></article></form>", [LONG]),
        ("headers", f"<header><p>{MORE}</p></header><article><header><h1>Head</h1></header><p>{LONG}</p></article>", ["Head", LONG]),
        ("link list in an article", f"<article><p>{LONG}</p><ul><li><a href=a>{MORE}</a></li></ul><p>See <a href=b>it</a>.</p></article>",
         [LONG, "See it."]),
        ("hidden parts", f"<article><p hidden>{MORE}</p><p style='display: none'>{MORE}</p><p>{LONG} <span class=ad>Buy</span>now</p></article>",
         [LONG, "now"]),
        ("class that tells of the page", f"<div class='has-sidebar'><article class='no-comments'><p>{LONG}</p></article></div>", [LONG]),
        ("list and table in an article", f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article>",
         [LONG, "one", "two", "3", "4"]),
    ],
)
def test_main_part(name, body, wanted):
    assert main_blocks(page(body)) == wanted


def test_references_space_and_broken_markup():
    assert main_blocks("<p>a&nbsp;&amp;\n b&#x41;&lt;i&gt;<br>c <b>d<p>e &am") == ["a & bA<i> c d", "e &am"]
    assert main_text("<script>if (a</p>b) '</div>'</script>x <!-- <p>no --> y<style>p</style>") == "x y"
    assert main_text("<!-- never closed <p>a") == "" == main_text("<title>t<p>a") == main_text("<p")
    assert main_text("1 < 2 and 3<4") == "1 < 2 and 3<4"
    assert main_text("<p title='a>b'>x</p><p title=a'b>y</p>") == "x\n\ny"


def test_nothing_to_return():
    assert main_text(None) == "" == main_text("") == main_text("<nav>a</nav>") == main_text(" \n")
    assert main_text("<body><a href=x>only links</a>") == ""


def test_paths_of_implied_ends():
    blocks = read_page("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl><table><tr><td>e</div><td>f<tr><td>g</table>h").blocks
    assert [b.text for b in blocks] == list("abcdefgh")
    by_text = {b.text: b.path for b in blocks}
    assert by_text["a"] == by_text["b"] and by_text["e"] == by_text["f"] == by_text["g"]
    assert by_text["c"] != by_text["d"] and by_text["h"] == 0


@pytest.mark.parametrize(
    "source",
    ["<div>" * 100_000, "<ul>" + "<li><section>" + "<div>" * 30_000 + "<li></li>" * 30_000, '<a b="' * 50_000,
     "<" * 100_000, "<p>x" * 50_000, "<!--" * 100_000, "<b><div>" * 20_000 + "</b></div></section>" * 30_000],
)
def test_time_is_linear_whatever_the_markup(source):
    started = time.perf_counter()
    main_text(source)
    assert time.perf_counter() - started < 20


def test_rows_of_all_kinds(spark):
    text = page(f"<article><p>{LONG}</p></article>")
    huge = page("<article>" + f"<p>{MORE}</p>" * 20_000 + "</article>")
    rows = [(1, "u", text, 9), (1, "u", text, 9), (None, None, None, None), (2, "v", "", 0), (3, "w", huge, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, N_chars int").repartition(3)
    got = sorted(extract_text(pages).drop("html").collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [
        (None, None, 0), (1, "u", len(LONG)), (1, "u", len(LONG)), (2, "v", 0), (3, "w", 20_000 * (len(MORE) + 2) - 2)
    ]
    assert got[4].text == "\n\n".join([MORE] * 20_000)
    empty = extract_text(pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "html", "text", "n_chars"]
