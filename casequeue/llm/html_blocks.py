"""Text blocks of an HTML page with their tag paths, read in one pass and linear time.

Follows the rules browsers use for broken markup as far as blocks need them: implied end tags, void
elements, raw text of scripts and styles, comments and tags that never close. Phrase markup is not
part of a path, since it is the part of pages that is most often left open; ``a`` only marks link
text and ``span`` only what it hides.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names by their role in the HTML standard.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
PHRASE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
    "samp small strike strong sub sup time tt u var".split()
)
TRANSPARENT = frozenset("p div address span center".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
# Elements an element of the same group ends: p, li, dd and dt, cells, rows, options.
GROUP = {"p": 0, "li": 1, "dd": 2, "dt": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
NONE = (-1,) * 6

# Elements and words in class names that mark what is not main text.
BARRED = frozenset(
    "nav footer aside form button select datalist dialog noscript template svg math object audio video "
    "canvas menu map applet".split()
)
BARRED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
BARRED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos "
    "promotion banner cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist reply replies respond discussion disqus "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar "
    "masthead header footer copyright share sharing social related recommended recommendations widget widgets".split()
)
# Words that turn a class name into a statement about its page: "has-sidebar", "content-with-ads".
ABOUT = frozenset("has no with without is hide show enable disable".split())
MAIN = frozenset(("article", "main"))

_PIECE = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.DOTALL
)
_WANTED = re.compile(r"class|id\s*=|role|hidden|style", re.IGNORECASE)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


@dataclass(slots=True)
class Block:
    node: int  # the element that holds it
    path: int
    text: str
    linked: int  # characters inside links
    punctuation: int
    barred: bool


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    parents: list[int]  # of nodes; the root is 0 and its own parent
    main: list[bool]  # whether a node is an article or the main part
    path_parents: list[int]


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    path: int
    barred: bool
    by_form: bool
    in_main: bool
    near: tuple


def _attributes(text: str) -> dict[str, str]:
    if not _WANTED.search(text):
        return {}
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def _bars(name: str, in_main: bool) -> bool:
    """Whether a class name or id marks what is not main text."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or ABOUT.intersection(words):
        return False
    ends = {words[0], words[-1]} & BARRED_WORDS
    return bool(ends - {"header"} if in_main else ends)


def _barred(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in BARRED or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if _HIDDEN_STYLE.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").strip().lower() in BARRED_ROLES:
        return True
    names = [*attributes.get("class", "").split(), attributes.get("id", "")]
    return any(_bars(name, in_main) for name in names)


class _Reader:
    def __init__(self) -> None:
        self.page = Page([], [0], [False], [0])
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [_Open("", 0, 0, False, False, False, NONE)]
        self.open_at: dict[str, list[int]] = {}
        self.link = 0  # height of the stack where a link began
        self.words: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        # Script-like subtrees need no decoding, so barred text is only kept as it stands.
        self.words.append(raw if self.stack[-1].barred else html.unescape(raw))
        if self.link:
            self.linked += len(self.words[-1])

    def flush(self) -> None:
        """Ends the block that is being read."""
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            top = self.stack[-1]
            marks = len(_PUNCTUATION.findall(text))
            self.page.blocks.append(
                Block(top.node, top.path, text, min(self.linked, len(text)), marks, top.barred)
            )
        self.linked = 0

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        top = self.stack[-1]
        bars = _barred(tag, attributes, top.in_main)
        if tag in MAIN and top.by_form and not bars:
            barred = by_form = False  # a form around the whole page
        else:
            barred = top.barred or bars
            by_form = top.by_form if top.barred else bars and tag == "form"
        node, path = top.node, top.path
        if tag == "span":
            if bars and not top.barred:
                self.flush()
        else:
            step = f"{tag}.{attributes['class'].strip()}" if attributes.get("class") else tag
            path = self.paths.setdefault((top.path, step), len(self.page.path_parents))
            if path == len(self.page.path_parents):
                self.page.path_parents.append(top.path)
            node = len(self.page.parents)
            self.page.parents.append(top.node)
            self.page.main.append(not barred and (tag in MAIN or attributes.get("role") == "main"))
        near = list(top.near)
        if tag not in TRANSPARENT:
            near[:3] = NONE[:3]
            if tag == "table":
                near[3:5] = NONE[3:5]
        if tag in GROUP:
            near[GROUP[tag]] = len(self.stack)
        self.open_at.setdefault(tag, []).append(len(self.stack))
        in_main = top.in_main or tag in MAIN
        self.stack.append(_Open(tag, node, path, barred, by_form, in_main, tuple(near)))

    def pop(self, height: int) -> None:
        """Ends all elements from ``height`` of the stack on."""
        while len(self.stack) > height:
            ended = self.stack.pop()
            self.open_at[ended.tag].pop()
        if self.link > len(self.stack):
            self.link = 0

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.words.append(" ")
            return
        if tag == "a":
            self.link = len(self.stack)
            return
        if tag in PHRASE or tag in VOID and tag != "hr":
            return
        if tag in ("html", "body") and self.open_at.get(tag):
            return
        attributes = _attributes(rest)
        if tag == "span":
            self.push(tag, attributes)
            return
        self.flush()
        if rest.endswith("/") and tag in ("svg", "math"):
            return
        near = self.stack[-1].near
        if near[0] >= 0:
            self.pop(near[0])
            near = self.stack[-1].near
        own = GROUP.get(tag)
        if tag in ("thead", "tbody", "tfoot", "tr"):
            own = 4
        if own and near[own] >= 0:
            self.pop(near[own])
        if tag != "hr":
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
            return
        if tag == "br":
            self.words.append(" ")
        if tag in PHRASE or not self.open_at.get(tag):
            return
        height = self.open_at[tag][-1]
        if tag not in TABLE and height < self.stack[-1].near[3]:
            return  # outside of the table cell
        if tag != "span":
            self.flush()
        elif self.stack[height].barred and not self.stack[height - 1].barred:
            self.flush()
        self.pop(height)


def read_page(source: str) -> Page:
    """Blocks in page order. Any text is read; what is no markup is text."""
    reader = _Reader()
    at = 0
    while at < len(source):
        piece = _PIECE.match(source, at)
        at = piece.end()
        tag = piece[2]
        if tag is None:
            if source[piece.start()] != "<" or at == piece.start() + 1:
                reader.text(piece[0])
            continue
        tag = tag.lower()
        if piece[1]:
            reader.end(tag)
        elif tag in RAW:
            ended = _RAW_END[tag].search(source, at)
            at = ended.start() if ended else len(source)
        else:
            reader.start(tag, piece[3])
    reader.flush()
    return reader.page
