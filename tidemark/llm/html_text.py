"""Main text of web pages: flat text blocks, each judged with its neighbours by a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its word count and link density, those of
the blocks before and after it, of its wider neighbourhood and of the boxes it is in, and where it stands (inside an
article, a menu, a form, something named like an advert). A decision tree learns from the small labelled table of pages below which blocks are main text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Element names of HTML and words that sites name boilerplate with.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "select", "textarea", "button", "canvas", "audio", "video", "datalist", "dialog"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "fieldset", "search"}
MAIN = {"article", "main"}
NAMED = {
    "ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notification", "alert", "disclaimer", "sidebar", "sidenav", "aside", "comment", "comments",
    "respond", "reply", "replies", "discussion", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter",
    "feedback", "reviews", "responses", "guestbook", "subscribe", "subscription", "signup", "login", "search", "breadcrumb", "breadcrumbs", "pagination", "pager", "menu", "nav",
    "navbar", "navigation", "footer", "header", "masthead", "topbar", "modal", "popup", "overlay", "widget", "toolbar", "skip",
    "hidden", "meta", "tags", "copyright", "legal", "form",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
MAIN_NAMED = {"article", "content", "main", "post", "entry", "story", "body", "text"}

#: Elements that hold paragraphs and lists of their own.
BOXES = {"body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form"}
#: Elements that hold text: a name of theirs says something about the text only as a whole.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "caption", "figcaption"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|data-main)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after",
    "in_main", "in_frame", "named_boilerplate", "named_main", "page_has_main", "heading",
    "near_words", "near_links", "box_words", "box_links", "outer_words", "outer_links",
)
PLACES = ("in_main", "in_frame", "named_boilerplate", "named_main")
#: Blocks on either side that make the wider neighbourhood.
NEAR = 3


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    in_main: bool
    in_frame: bool
    named: bool
    named_main: bool
    heading: bool
    boxes: tuple[int, int, int] = (0, 0, 0)
    label: int | None = None


@dataclass
class _Open:
    name: str
    main: bool
    frame: bool
    named: bool
    named_main: bool
    hidden: bool
    label: int | None
    boxes: tuple[int, int, int] = (0, 0, 0)


def tags(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """``(start, end, closing, name, attributes)`` of each tag in order, name None for comments and declarations.

    Reads forward only: a tag ends at the first `>` outside quotes. An open comment, quote or tag ends with the page.
    """
    at, size = page.find("<"), len(page)
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, False, None, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = size if end < 0 else end + 1
            yield at, end, False, None, ""
        else:
            m = _NAME.match(page, at)
            if m is None:
                at = page.find("<", at + 1)
                continue
            stop, end = m.end(), None
            while end is None:
                found = _STOP.search(page, stop)
                if found is None:
                    end = size + 1
                elif found.group() == ">":
                    end = found.end()
                else:
                    close = page.find(found.group(), found.end())
                    stop, end = (close + 1, None) if close >= 0 else (size, size + 1)
            yield at, min(end, size), page[at + 1] == "/", m.group(1).lower(), page[m.end() : end - 1]
            end = min(end, size)
        at = page.find("<", end)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = _Open("", False, False, False, False, False, None)
    stack, out = [root], []
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    # Places in the stack by name, and where its main part begins, so that no tag scans the whole stack.
    places: dict[str, list[int]] = defaultdict(list)
    main_from = 0

    def push(mark: _Open) -> None:
        nonlocal main_from
        if mark.main and not stack[-1].main:
            main_from = len(stack)
        places[mark.name].append(len(stack))
        stack.append(mark)

    def close(at: int) -> None:
        for mark in stack[at:]:
            places[mark.name].pop()
        del stack[at:]

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else 0

    def flush() -> None:
        words = "".join(text).split()
        if words:
            top = stack[-1]
            n_linked = len("".join(linked).split())
            heading = any(re.fullmatch(r"h[1-6]", x.name) for x in stack[-2:])
            out.append(Block(" ".join(words), len(words), min(1.0, n_linked / len(words)), top.main, top.frame, top.named, top.named_main, heading, top.boxes, top.label))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not stack[-1].hidden:
            decoded = html_lib.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if in_link:
                linked.append(decoded + " ")

    boxes = 0
    at = 0
    for start, end, closing, name, attributes in tags(page):
        if start < at:
            continue  # inside raw text
        say(page[at:start])
        at = end
        if name is None:
            continue
        if name == "a":
            in_link = not closing
            continue
        if name not in BLOCK and name not in HIDDEN:
            if not closing and attributes and name not in VOID:
                mark = _opened(name, attributes, stack[-1])
                if mark.hidden or mark.named != stack[-1].named:
                    flush()
                    push(mark)
            elif closing and stack[-1].name == name:
                flush()
                close(len(stack) - 1)
            continue
        if name in BLOCK:
            flush()
            in_link = in_link and name not in MAIN | FRAME
        if closing:
            if last(name):
                flush()
                close(last(name))
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            # An open one of the same kind ends here, unless a list or table of its own lies between.
            between = max(map(last, ("ul", "ol", "table", "dl", "div", "section", "blockquote", "form", "select")))
            if last(name) and last(name) >= max(between, main_from - 1 if stack[-1].main else 0):
                close(last(name))
        if stack[-1].name == "p" and name in BLOCK:
            close(len(stack) - 1)
        mark = _opened(name, attributes, stack[-1])
        if name in BOXES:
            boxes += 1
            mark.boxes = (boxes, *mark.boxes[:2])
        push(mark)
    say(page[at:])
    flush()
    return out


def _opened(name: str, attributes: str, above: _Open) -> _Open:
    main, frame, named = above.main, above.frame, above.named
    named_main, hidden, label = above.named_main, above.hidden or name in HIDDEN, above.label
    if name in MAIN and not frame:
        main = True
    elif name in FRAME and not (name == "header" and main):
        frame = True
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "")
            if key in ("class", "id"):
                found = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                # A paragraph on related work is none of the related links.
                hit = (set(value.lower().split()) if name in TEXTUAL else found) & NAMED
                if main:
                    hit -= {"header", "meta", "text"}
                named = named or (bool(hit) and name not in MAIN and name not in ("body", "html"))
                named_main = named_main or bool(found & MAIN_NAMED)
            elif key == "role":
                frame = frame or value.lower() in ROLES
                main = main or value.lower() in MAIN
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "data-main":
                label = int(value)
    return _Open(name, main, frame, named, named_main, hidden, label, above.boxes)


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.link_density for b in blocks])
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    flags = [(b.in_main, b.in_frame, b.named, b.named_main) for b in blocks]
    out[:, 6:10] = flags
    out[:, 10] = any(b.in_main for b in blocks)
    out[:, 11] = [b.heading for b in blocks]
    linked = words * links
    sums = np.concatenate([np.zeros((1, 2)), np.cumsum(np.column_stack([words, linked]), axis=0)])
    lo, hi = np.maximum(np.arange(n) - NEAR, 0), np.minimum(np.arange(n) + NEAR + 1, n)
    near = sums[hi] - sums[lo]
    out[:, 12], out[:, 13] = near[:, 0] / (hi - lo), near[:, 1] / near[:, 0]
    # What a box holds: its own blocks and those of boxes up to two levels down.
    held: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for b, w, k in zip(blocks, words.tolist(), linked.tolist(), strict=True):
        for box in set(b.boxes):
            held[box][0] += w
            held[box][1] += k
    for at, level in ((14, 0), (16, 1)):
        totals = np.array([held[b.boxes[level]] for b in blocks])
        out[:, at], out[:, at + 1] = totals[:, 0], totals[:, 1] / totals[:, 0]
    return out


# The labelled table: small pages whose elements say by data-main whether their text is main text.
_LONG = "It was late when the last of them came down from the hill, and nobody in the valley had kept a fire for the night."
_MID = "The river ran high that spring and took two bridges."
_PLAIN = [f'<div data-main="1">{x}</div>' for x in (f"{_LONG} {_MID}", "No one.", f"{_LONG} {_LONG}", f"{_MID} {_LONG}")]


def _words(n: int) -> str:
    """A text of n words."""
    words = f"{_LONG} {_MID}".split()
    return " ".join(words[i % len(words)] for i in range(n))


LABELLED_PAGES = (
    f'<body><nav data-main="0"><ul><li><a>Home</a><li><a>World news</a><li><a>Sport</a></ul></nav><div class="ad" data-main="0">{_MID}</div>'
    f'<article data-main="1"><h1>Late</h1><p>{_LONG}</p><p>{_MID}</p><p>No.</p><p>Then <a>one link only</a></p><p><a>whole line linked</a></p><p>{_LONG}</p></article>'
    f'<footer data-main="0">&copy; The Valley &middot; {_LONG}</footer></body>',
    f'<body><header data-main="0"><h1>The Valley Times</h1><p>{_MID}</p></header><aside data-main="0"><p>{_LONG}</p><a>More</a></aside>'
    f'<main data-main="1"><h2>A flood</h2><p>{_MID}</p><table><tr><td>One</td><td>Two</td></tr></table><ul><li>{_MID}</li><li>End</li></ul>'
    f'<section class="comments" data-main="0"><h3>Comments</h3><p>{_LONG}</p><p>Great!</p></section></main><footer data-main="0"><a>Contact</a></footer></body>',
    f'<body><div class="cookie-notice" data-main="0">{_LONG}</div><div id="menu" data-main="0"><a>a</a> <a>b</a></div><div class="content" data-main="1"><p>{_LONG}</p>'
    f'<p>{_LONG} {_MID}</p><p>{_MID}</p></div><div class="sidebar" data-main="0"><p>{_LONG}</p></div><form data-main="0"><label>{_MID}</label></form></body>',
    f'<body><p data-main="0"><a>Home</a> <a>About us</a> <a>Shop</a></p><p data-main="1">{_LONG} {_LONG}</p><p data-main="1">{_LONG} {_MID}</p><p data-main="1">{_MID} {_LONG}</p>'
    f'<p data-main="0"><a>Imprint</a></p></body>',
    f'<body><article data-main="1"><header><h1>Bridges</h1></header><p>{_LONG}</p><div class="promo" data-main="0">{_LONG}</div><blockquote>{_MID}</blockquote>'
    f'<aside data-main="0"><p>{_LONG}</p></aside><form data-main="0">{_MID}</form><p>{_MID}</p><div class="share" data-main="0"><a>Tell others</a></div><footer data-main="0">{_MID}</footer></article>'
    f'<div class="related" data-main="0"><h3>More</h3><p><a>{_MID}</a></p></div><div class="notice" data-main="0"><p>{_LONG}</p></div></body>',
    f'<body><div data-main="0">Top</div><article data-main="1"><p>{_MID}</p></article><div data-main="0"><p>{_LONG} {_LONG}</p></div><p data-main="0">{_MID}</p></body>',
    f'<body><article data-main="1"><p>Short.</p><p>Two words</p><h2>Part two</h2><p><a>{_MID}</a></p><p>{_MID}</p></article><nav data-main="0"><p>{_LONG}</p></nav></body>',
    f'<body><div data-main="0"><a>In</a></div><div data-main="0"><a>Out</a> now</div><h1 data-main="1">A long road home for all</h1><div data-main="1">{_LONG} {_LONG}</div><div data-main="1">{_LONG} {_LONG} {_MID}</div>'
    f'<div data-main="0"><a>Next page</a></div></body>',
    f'<body><div data-main="0"><a>{_MID}</a></div><div data-main="0"><a>{_MID}</a></div><div data-main="0"><a>{_LONG}</a></div><h2 data-main="0">Top stories</h2><div data-main="0"><a>{_MID}</a></div>'
    f'<div data-main="1">{_LONG} {_MID}</div><div data-main="1">No one.</div><div data-main="1">{_MID} {_LONG}</div><div data-main="1">{_LONG} <a>a word</a> {_MID}</div><div data-main="0"><a>{_LONG}</a></div>'
    f'<div data-main="0">All rights</div><div data-main="0"><a>{_MID}</a></div></body>',
    f'<body><p data-main="1">{_LONG}</p><p data-main="1">Not yet.</p><p data-main="1">{_LONG} {_LONG}</p><p data-main="1">Soon</p><p data-main="1">{_MID} {_MID}</p><p data-main="0"><a>Back</a></p><p data-main="0">Terms</p></body>',
) + tuple(
    # Pages without an article element: something framed or named between plain paragraphs.
    "<body>" + "".join(_PLAIN[:at]) + frame + "".join(_PLAIN[at:]) + "</body>"
    for at in range(len(_PLAIN) + 1)
    for text in (_LONG, f"{_LONG} {_LONG} {_MID}", _MID)
    for frame in (
        f'<div class="sidebar" data-main="0"><p>{text}</p></div>', f'<footer data-main="0"><p>{text}</p></footer>', f'<form data-main="0">{text}</form>',
        f'<div id="comments" data-main="0"><p>{text}</p></div>', f'<header data-main="0"><p>{text}</p></header>', f'<div class="ad" data-main="0">{text}</div>',
    )
) + tuple(
    # Pages with one: paragraphs of any length and links count, whatever stands before and after.
    f'<body>{before}<{tag} data-main="1"><h1>{_words(n)}</h1><p><a>{_words(n + 2)}</a></p><p>{_words(2 * n)}</p><p>{_words(5 * n)}</p><p>Yes.</p><p>{_words(9 * n)}</p><p>{_words(3 * n)}</p>'
    f'{inside}<p>{_words(7 * n)}</p><p>{_words(n)}</p></{tag}>{after}</body>'
    for n in (1, 3, 8, 20)
    for tag in ("article", "main")
    for inside in ("", f'<div class="promo" data-main="0">{_words(4 * n)}</div>', f'<aside data-main="0"><p>{_words(8 * n)}</p></aside>')
    for before in ('<nav data-main="0"><a>Home</a></nav>', f'<div data-main="0">{_words(6 * n)}</div>', f'<p data-main="0"><a>{_words(n)}</a></p>')
    for after in ("", '<footer data-main="0"><a>Contact</a> us</footer>', f'<div data-main="0">{_words(4 * n)}</div>')
) + tuple(
    # Pages with one, and long text outside of it.
    f'<body>{before}<{tag} data-main="1"><p>{_words(n)}</p><p>{_words(m)}</p></{tag}>{after}</body>'
    for n in (2, 20, 60)
    for m in (4, 30)
    for tag in ("article", "main")
    for before in ("", f'<div data-main="0"><p>{_words(25)}</p></div>')
    for after in (f'<div data-main="0"><p>{_words(20)}</p><p>{_words(45)}</p></div>', f'<section data-main="0"><p>{_words(70)}</p></section>', f'<p data-main="0">{_words(22)}</p>')
) + tuple(
    # Pages with a short one, between as much text that is framed or named.
    f'<body><nav data-main="0"><ul>{links}</ul></nav>{before}<{tag} data-main="1"><h1>{_words(n)}</h1>{"".join(f"<p>{_words(m)}</p>" for m in sizes)}{inside}</{tag}>{after}</body>'
    for n, sizes in ((8, (8, 9)), (3, (2,)), (12, (12, 4)), (5, (16,)), (1, (30,)), (9, (1, 1, 1)), (6, (6, 24, 6, 60)))
    for tag in ("article", "main")
    for links in ("<li><a>One</a>" * 3, "<li><a>One and two</a>" * 9)
    for before in ("", f'<div class="ad" data-main="0">{_words(7)}</div>', f'<header data-main="0"><p>{_words(20)}</p></header>')
    for inside in ("", f'<section class="comments" data-main="0"><p>{_words(n)}</p></section>')
    for after in (f'<footer data-main="0">{_words(12)}</footer>', f'<aside data-main="0"><p>{_words(3)}</p><p>{_words(33)}</p></aside>')
) + tuple(
    # Pages without one: a box of paragraphs, lists and headings of any length in any order, between boxes of links and lines.
    f'<body>{before}<div>{"".join(body)}</div>{after}</body>'
    for sizes in ((22, 22, 1, 22), (22, 2, 2, 22), (1, 30, 22), (40, 6, 3, 50, 1), (22, 12, 22, 4), (60, 22), (3, 44, 3, 44, 3), (25,) * 6)
    for body in (
        [f'<p data-main="1">{_words(n)}</p>' for n in sizes],
        [f'<p data-main="1">{_words(n)}</p>' if n > 3 else f'<ul data-main="1"><li>{_words(n)}<li>{_words(n + 1)}</ul>' for n in sizes],
        [f'<p data-main="1">{_words(n)}</p>' if n > 3 else f'<h2 data-main="1">{_words(n)}</h2>' for n in sizes],
        [f'<div data-main="1">{_words(n)}</div>' for n in sizes],
    )
    for before in ("", '<div data-main="0"><a>Home</a> <a>World news</a> <a>Sport</a></div>', '<ul data-main="0"><li><a>Home</a><li><a>Shop</a><li><a>About us</a></ul>')
    for after in ("", '<div data-main="0">All rights reserved</div>', f'<div data-main="0"><p><a>{_words(6)}</a></p><p><a>{_words(9)}</a></p><p><a>{_words(7)}</a></p></div>')
)


@dataclass
class Tree:
    """A binary decision tree: a leaf has a ``share`` of main text, an inner node tests ``feature <= cut``."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share >= 0.5)
        out, low = np.zeros(len(x), bool), x[:, self.feature] <= self.cut
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def train(x: np.ndarray, y: np.ndarray, depth: int = 8, using: tuple[str, ...] = FEATURES) -> Tree:
    """Greedy splits by Gini impurity; ties go to the flag or measure that comes last in FEATURES."""
    tree = Tree(float(y.mean()))
    if depth == 0 or len(set(y.tolist())) < 2:
        return tree
    best = (1e-9, -1, 0.0)
    gini = len(y) * y.mean() * (1 - y.mean())
    for f in (n for n in range(x.shape[1] - 1, -1, -1) if FEATURES[n] in using):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            parts = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if gini - parts > best[0] + 1e-9:
                best = (gini - parts, f, float(cut))
    if best[1] < 0:
        return tree
    low = x[:, best[1]] <= best[2]
    return Tree(tree.share, best[1], best[2], train(x[low], y[low], depth - 1, using), train(x[~low], y[~low], depth - 1, using))


def trained(pages: tuple[str, ...] = LABELLED_PAGES) -> Tree:
    """The tree of a labelled table. It asks first whether the page marks its main part itself; if so, only the places of
    blocks count from there on, not how long they are or how many links they and their neighbours have."""
    found = [blocks_of(p) for p in pages]
    x, y = np.concatenate([features(b) for b in found]), np.array([b.label for blocks in found for b in blocks], float)
    marked = FEATURES.index("page_has_main")
    high = x[:, marked] > 0.5
    return Tree(float(y.mean()), marked, 0.5, train(x[~high], y[~high]), train(x[high], y[high], using=PLACES))


def main_text(page: str | None, tree: Tree) -> str:
    """Main text of one page: its blocks in order, joined by a space."""
    blocks = blocks_of(page or "")
    keep = tree.predict(features(blocks)) if blocks else ()
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every column of ``pages`` but the html, and ``text``: the page's main text, empty if it has none.

    Null html is empty. Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space; nothing else is dropped or shortened. Broken and cut-off markup is read as far as it goes.
    Repeated rows each give a row. A column that already is named text is replaced. An empty table gives an empty result.
    """
    tree = trained()
    rest = [c for c in pages.columns if c not in (html, "text")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(p, tree) for p in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), texts], [*rest, "text"])

    return pages.select(*rest, F.col(html)).mapInArrow(read, StructType([pages.schema[c] for c in rest]).add("text", "string"))
