"""Main text of web pages by two passes of block rules.

A page becomes blocks of text with their length, stop-word density, link
density and place. The first pass calls a block good or bad where these
measures decide, and ambiguous where it is short, middling or, in an article,
poor in stop words (a table, code, another language). The second pass gives
ambiguous blocks the label of their nearest decided neighbours, within the
article they stand in, if they stand in one.

Elements and roles that never hold the text (navigation, footers, forms, ...)
are put aside before. Class and id do so only as whole names: every part of
the name must be a marker or a word for a piece of a page, so "comment-list" is
the readers', while "social-history" or "related-work" says nothing and the
measures decide.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Blocks shorter than SHORT characters are ambiguous; those above LONG can be good on their own.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, MOST_LINKS = 0.10, 0.20, 0.33

STOP_WORDS = {
    "en": "the of and to in is was that it for with as by from on be this are at an or have not which but",
    "fr": "le la les de des du et un une en est que qui dans pour par sur au aux avec ce il ne pas plus",
    "de": "der die das den dem des und ein eine einer einem ist in zu von mit auf für als im an auch nicht",
    "es": "el la los las de del y un una en es que por para con no se su al lo como más pero",
}

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
#: Elements whose text is never the article's.
ASIDE_TAGS = {
    "nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "template", "noscript", "svg", "canvas", "object",
    "audio", "video", "head", "datalist",
}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Words of class and id that mark such elements: always, or only where no content class stands beside them.
ASIDE_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertising", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "replies", "disqus", "respond", "cookie", "cookies",
    "consent", "gdpr", "newsletter", "subscribe", "signup", "related", "recommended", "share", "sharing", "social", "pagination",
    "pager", "popup", "modal", "toolbar",
}
WEAK_WORDS = {"header", "sidebar", "notice", "banner", "widget", "search", "login", "form", "copyright", "legal", "disclaimer", "aside"}
#: Words that name a piece of a page; beside a marker they leave it one.
PIECE_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "entry", "frame", "group",
    "icons", "inner", "item", "items", "left", "links", "link", "list", "main", "message", "module", "outer", "page", "panel", "post", "posts", "primary",
    "right", "row", "secondary", "section", "site", "slot", "space", "story", "stories", "article", "articles", "text", "thread", "title", "top", "unit",
    "widgets", "wrap", "wrapper", "zone", "component", "count", "desktop", "email", "fixed", "follow", "global", "icon", "label", "large", "media", "mobile",
    "more", "overlay", "placeholder", "policy", "print", "reader", "readers", "settings", "small", "sticky", "tool", "tools", "ui", "user", "users", "wp",
}
CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "text", "body"}
MARKERS = ASIDE_WORDS | WEAK_WORDS | PIECE_WORDS
NEVER_ASIDE = {"html", "body", "article", "main"}
#: An article element of such a class is a reader's, not the page's.
READER_WORDS = {"comment", "comments", "reply", "replies"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"""(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)(?=[\s/]|\Z)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_STOP = {w: k for k, ws in enumerate(STOP_WORDS.values()) for w in ws.split()}
_STOP_SETS = [frozenset(ws.split()) for ws in STOP_WORDS.values()]


@dataclass
class Block:
    text: str
    linked: int
    aside: bool
    article: int  # number of the article or main element around it; 0: none
    label: str = ""
    words: list[str] = field(default_factory=list)


def _is_aside(tag: str, attributes: str, in_article: bool, by_class: bool, by_content: bool) -> tuple[bool, bool]:
    """Whether an element is beside the text, and whether it is the text's own container.

    Inside an article an id counts as a whole only: it may be a heading's slug.
    """
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return True, False
    own = tag in ("article", "main")
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, own
    names: list[set[str]] = []  # parts of the names that consist of markers and pieces of a page
    classes: set[str] = set()
    for name, a, b, c, hidden in _NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return tag not in NEVER_ASIDE, own
        if name == "role":
            if value in ASIDE_ROLES and tag not in NEVER_ASIDE:
                return True, False
            own |= value in ("main", "article")
        elif name == "itemprop":
            own |= value == "articlebody"
        elif name in ("class", "id"):
            for one in value.split():
                if not one.startswith(("has-", "with-", "no-", "js-")):
                    classes.add(one)
                    parts = _PARTS.findall(one)
                    if MARKERS.issuperset(parts) and not (in_article and name == "id" and len(parts) > 1):
                        names.append(set(parts))
                    own |= by_content and bool(parts) and CONTENT_WORDS.issuperset(parts) and tag not in ("html", "body")
    words = set().union(*names)
    if tag in NEVER_ASIDE or not by_class:
        reader = by_class and tag == "article" and bool(words & READER_WORDS)
        return reader, own and not reader
    weak = words & (WEAK_WORDS - {"header"} if in_article else WEAK_WORDS) and not classes & CONTENT_WORDS
    return bool(words & ASIDE_WORDS or weak), own


def blocks(page: str, by_class: bool = True) -> list[Block]:
    """The page's blocks of text in order; broken markup is read as far as it can be.

    ``by_class`` lets class and id say what stands beside the text, and on a
    page without an article also what holds it; without it only elements and
    roles do.
    """
    found = _blocks(page, by_class, False)
    return _blocks(page, True, True) if by_class and not any(b.article for b in found) else found


def _blocks(page: str, by_class: bool, by_content: bool) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements that are not inline: tag, aside, article
    text: list[str] = []
    linked, links, articles, breaks = 0, 0, 0, 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if not raw:
            return
        piece = entities.unescape(raw) if "&" in raw else raw
        text.append(piece)
        if piece.strip():
            breaks = 0
            if links:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, aside, article = stack[-1] if stack else ("", False, 0)
                out.append(Block(joined, min(linked, len(joined)), aside, article))
            text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in INLINE:
            continue
        if tag in RAW:
            if not closing:
                flush()
                close = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(page, at)
                at = close.start()
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        while tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "section", "article", "table") and stack and stack[-1][0] == "p":
            stack.pop()
        _, aside, article = stack[-1] if stack else ("", False, 0)
        beside, own = _is_aside(tag, attributes, bool(article), by_class, by_content)
        if own and not article and not aside:
            articles += 1
            article = articles
        if not attributes.endswith("/"):
            stack.append((tag, aside or beside, article))
    flush()
    return out


def classify(found: list[Block]) -> None:
    """Label the blocks: first by their own measures, then the ambiguous ones by their neighbours."""
    counts = [0] * len(_STOP_SETS)
    for b in found:
        if not b.aside:
            b.words = [w.strip(".,;:!?()\"'«»").lower() for w in b.text.split()]
            for w in b.words:
                if w in _STOP:
                    for k, s in enumerate(_STOP_SETS):
                        counts[k] += w in s
    stop = _STOP_SETS[max(range(len(counts)), key=counts.__getitem__)]
    for b in found:
        size = len(b.text)
        if b.aside or b.linked > MOST_LINKS * size:
            b.label = "bad"
        elif size < SHORT:
            b.label = "short"
        else:
            density = sum(w in stop for w in b.words) / max(1, len(b.words))
            if density >= STOP_HIGH and size > LONG:
                b.label = "good"
            elif density >= STOP_LOW:
                b.label = "near"
            else:
                b.label = "thin" if b.article else "bad"
    by_article: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        by_article.setdefault(b.article, []).append(i)
    for article, places in by_article.items():
        _inherit(found, [i for i in places if not found[i].aside], bool(article))


def _inherit(found: list[Block], places: list[int], in_article: bool) -> None:
    """Decide the ambiguous blocks of one stretch.

    In an article one good neighbour is enough, and where nothing is decided
    all are good; elsewhere a short block needs its nearest neighbour, or both.
    """
    n = len(places)
    before: list[tuple[int, str]] = [(n + 1, "")] * n
    after: list[tuple[int, str]] = [(n + 1, "")] * n
    for side, order, into in ((-1, range(n), before), (1, range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            label = found[places[k]].label
            if label in ("good", "bad"):
                last = (k, label)
            elif last:
                into[k] = (abs(k - last[0]), last[1])
    for k in range(n):
        b = found[places[k]]
        if b.label not in ("short", "near", "thin"):
            continue
        (d1, l1), (d2, l2) = before[k], after[k]
        if not l1 and not l2:
            b.label = "good" if in_article or b.label == "near" else "bad"
        elif in_article or b.label == "near":
            b.label = "good" if "good" in (l1, l2) else "bad"
        else:
            b.label = (l1 if d1 < d2 else l2) if d1 != d2 else ("good" if l1 == l2 == "good" else "bad")


def main_text(page: str | None) -> str:
    """The good blocks, joined by an empty line; empty for a null or empty page.

    Where class names leave nothing, as when they stand on what holds the
    whole page, they are not heeded.
    """
    for by_class in (True, False):
        found = blocks(page or "", by_class)
        classify(found)
        good = [b.text for b in found if b.label == "good"]
        if good:
            break
    return "\n\n".join(good)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of ``html``, and ``n_chars``, its code points; columns of these names are replaced.

    One row out for each row in, whatever the other columns hold. A null page
    counts as empty and has the empty text.
    """

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    added = pages.withColumn(out, text.asNondeterministic()(F.col(html).cast("string")))
    return added.withColumn("n_chars", F.length(out).cast("long"))
