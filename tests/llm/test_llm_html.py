"""The block rules of HTML extraction: each decides somewhere, and a plain reader of elements agrees on the given pages."""

from html.parser import HTMLParser

import duckdb
import pytest

from patronage.llm import html_text
from patronage.llm.html_text import main_text

PROSE = "It was the best of the days and it was for the most of us that the sun was on the hills, so we had to go with them. "
THIN = "Zinc 30.38 lead 207.2 gold 196.97 iron 55.84 neon 20.18 argon 39.95 xenon 131.29 radon 222 helium 4.0026 boron 10.81 carbon 12.011 silver 107.87 copper 63.55 tin 118.71 cobalt 58.93 nickel 58.69 arsenic 74.92 "
LINKS = "<p>" + "".join(f'<a href="/{i}">Another story of the day number {i}</a> ' for i in range(6)) + "</p>"


def article(*parts):
    return "<body><nav><a href='/'>Home</a></nav><article>" + "".join(parts) + "</article><footer>Us</footer></body>"


PAGES = {
    "links go": (article(f"<p>{PROSE * 3}</p>", LINKS, f"<p>{PROSE * 3}</p>"), 2),
    "a caption among links goes": (article(f"<p>{PROSE * 3}</p>", LINKS, "<p>More of it</p>", LINKS), 1),
    "a middling block among links goes": (article(f"<p>{PROSE * 3}</p>", LINKS, f"<p>{PROSE}</p>", LINKS), 1),
    "a list of figures among links goes": (article(f"<p>{PROSE * 3}</p>", LINKS, f"<p>{THIN * 2}</p>", LINKS), 1),
    "long prose among links stays": (article(f"<p>{PROSE * 3}</p>", LINKS, f"<p>{PROSE * 2}</p>", LINKS), 2),
    "figures beside prose stay": (article(f"<p>{PROSE * 3}</p>", f"<p>{THIN * 2}</p>", "<p>Short.</p>"), 3),
    "no prose at all stays": (article(f"<p>{THIN}</p>", "<h1>Title</h1>"), 2),
    "without an article prose stays": (f"<body><div>{PROSE * 3}</div><div>{PROSE}</div><div>{THIN * 2}</div><div>Menu</div></body>", 2),
    "without an article a heading between prose stays": (f"<body><div>{PROSE * 3}</div><h2>Then</h2><div>{PROSE * 3}</div>{LINKS}</body>", 3),
}


def paragraphs(page):
    text = main_text(page)
    return len(text.split("\n\n")) if text else 0


@pytest.mark.parametrize("name", PAGES)
def test_rules_decide(name):
    page, n = PAGES[name]
    assert paragraphs(page) == n


def changed(monkeypatch, **constants):
    before = {name: main_text(page) for name, (page, _) in PAGES.items()}
    for k, v in constants.items():
        monkeypatch.setattr(html_text, k, v)
    return {name for name, (page, _) in PAGES.items() if main_text(page) != before[name]}


def test_without_link_density_other_text_comes_out(monkeypatch):
    assert len([n for n in changed(monkeypatch, MOST_LINKS=2.0) if "links" in n]) >= 4


def test_without_stop_words_other_text_comes_out(monkeypatch):
    assert {"a list of figures among links goes", "without an article prose stays"} <= changed(monkeypatch, STOP_LOW=0.0, STOP_HIGH=0.0)


def test_without_good_stop_words_other_text_comes_out(monkeypatch):
    assert "long prose among links stays" in changed(monkeypatch, STOP_LOW=2.0, STOP_HIGH=2.0)


def test_without_length_other_text_comes_out(monkeypatch):
    assert "a middling block among links goes" in changed(monkeypatch, LONG=0)


def test_without_short_blocks_other_text_comes_out(monkeypatch):
    assert "without an article a heading between prose stays" in changed(monkeypatch, SHORT=0)


def test_without_neighbours_other_text_comes_out(monkeypatch):
    def all_good(found, places, in_article):
        for i in places:
            if found[i].label in ("short", "near", "thin"):
                found[i].label = "good"

    assert {"a caption among links goes", "a middling block among links goes", "a list of figures among links goes"} <= changed(monkeypatch, _inherit=all_good)


@pytest.mark.parametrize("name", ["related-work", "ad-hoc-notes", "social-history", "legal-history", "menu-of-the-day", "share-prices", "promo-code-theory"])
def test_a_name_is_a_marker_only_as_a_whole(name):
    part = f'<section class="{name}"><p>{PROSE}</p></section>'
    assert paragraphs(article(f"<p>{PROSE * 3}</p>", part, f"<p>{PROSE * 3}</p>")) == 3
    assert paragraphs(article(f"<p>{PROSE * 3}</p>", part.replace("class", "id"))) == 2


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "comment-list", "comments", "cookie-banner", "share_buttons", "related-posts", "newsletter signup", "sidebar"])
def test_markers_put_prose_aside(name):
    assert paragraphs(article(f"<p>{PROSE * 3}</p>", f'<div class="{name}"><p>{PROSE * 3}</p></div>')) == 1


def test_a_fieldset_is_no_form():
    assert paragraphs(article(f"<fieldset><p>{PROSE * 3}</p></fieldset>", f"<form><p>{PROSE * 3}</p></form>")) == 1


class Reader(HTMLParser):
    """Blocks of text within article elements, by the elements alone."""

    INLINE = html_text.INLINE - {"br"}

    def __init__(self):
        super().__init__()
        self.inside, self.beside, self.breaks, self.text, self.out = 0, [], 0, "", []

    def cut(self):
        if text := " ".join(self.text.split()):
            self.out.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
            return
        if tag in self.INLINE:
            return
        self.cut()
        self.inside += tag == "article"
        if tag in ("nav", "footer", "aside", "form", "script", "style") or dict(attrs).get("class") == "ad":
            self.beside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.INLINE:
            return
        self.cut()
        self.inside -= tag == "article"
        if self.beside and self.beside[-1] == tag:
            self.beside.pop()

    def handle_data(self, data):
        if self.inside > 0 and not self.beside:
            self.text += data


def test_a_plain_reader_agrees_on_the_given_pages():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in pages:
        reader = Reader()
        reader.feed(page or "")
        reader.close()
        reader.cut()
        assert main_text(page) == "\n\n".join(reader.out)
