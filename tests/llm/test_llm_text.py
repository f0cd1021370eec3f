"""HTML extraction, quality rules, licence scans and language, on small tables."""

import pytest

from patronage.llm import html_text, language, licenses, quality

PROSE = "The house on the hill was old, and it is said that the owner of the land had come to it in the winter of that year with the rest of his people. "


def page(article, before="", after=""):
    return f"<html><head><title>The title of it</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


def test_article_without_what_surrounds_it():
    before = '<header><h1>Site of the news</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>' + PROSE * 2 + "</p></div>"
    after = (
        '<aside><p>' + PROSE * 2 + '</p></aside><div id="comments"><p>' + PROSE * 2 + '</p></div><form>Mail <input> <button>Go</button></form>'
        '<div class="ad">' + PROSE * 2 + '</div><footer>&copy; the owner of it all</footer>'
    )
    article = "<article><h1>On &amp; off</h1><p><b>" + PROSE * 2 + "<p>Short one.</p><script>var t='</p>'</script><p>A&nbsp;&lt;b&gt;\n  c</p></article>"
    assert html_text.main_text(page(article, before, after)) == "\n\n".join(["On & off", (PROSE * 2).strip(), "Short one.", "A <b> c"])


def test_page_without_an_article_element():
    body = f"<div class='menu'>{PROSE}</div><div><p>{PROSE * 2}</p><p>Brief.</p><p>{PROSE * 2}</p></div><p><a href='/'>one</a> <a href='/'>two</a></p>"
    assert html_text.main_text(page(body)) == "\n\n".join([(PROSE * 2).strip(), "Brief.", (PROSE * 2).strip()])


def test_readers_and_notices():
    inside = f'<article><p>{PROSE * 2}</p><div class="post-notice"><p>{PROSE * 2}</p></div><div class="right-sidebar">{PROSE * 2}</div></article>'
    readers = f'<article class="comment"><p>{PROSE * 2}</p></article><section id="comments"><article><p>{PROSE * 2}</p></article></section>'
    assert html_text.main_text(page(inside, after=readers)) == (PROSE * 2).strip()
    whole = f'<div class="fixed-header"><article><p>{PROSE * 2}</p></article><footer>{PROSE * 2}</footer></div>'
    assert html_text.main_text(page(whole)) == (PROSE * 2).strip()


@pytest.mark.parametrize("slug", ["related-work", "share-prices", "navigation-in-birds", "legal-history"])
def test_slugs_of_headings_are_no_class_names(slug):
    inside = f'<article><p>{PROSE * 2}</p><section id="{slug}"><h2 id="{slug}-2">Of it</h2><p>{PROSE * 3}</p></section><div id="comments">{PROSE * 2}</div></article>'
    assert html_text.main_text(page(inside)) == "\n\n".join([(PROSE * 2).strip(), "Of it", (PROSE * 3).strip()])


@pytest.mark.parametrize("around, heading", [("<div>{}</div>", False), ("<div class='content'><h2>Of it</h2>{}</div>", True), ("<div id='post-body'><h2>Of it</h2>{}</div>", True)])
def test_middling_paragraphs_without_an_article(around, heading):
    nav, footer = '<nav><a href="/">Home</a></nav>', f"<footer>{PROSE}</footer>"
    assert html_text.SHORT < len(PROSE.strip()) < html_text.LONG
    text = html_text.main_text(page(around.format(f"<p>{PROSE}</p>" * 3), nav, footer))
    assert text == "\n\n".join(["Of it"] * heading + [PROSE.strip()] * 3)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<", "") , ("<article>x", "x"), ("<article><p>a < b & c &bogus; &#65;</p>", "a < b & c &bogus; A"),
    ('<article><p title="unclosed>tail</p></article>', "tail"), ("<article>one<br>two<br><br>three</article>", "one two\n\nthree"),
])
def test_broken_pages(html, text):
    assert html_text.main_text(html) == text


def test_long_pages_take_linear_time():
    assert len(html_text.main_text("<article>" + f"<p>{PROSE * 2}</p>" * 5000)) > 1_000_000
    html_text.main_text("<div>" * 50_000 + "x")


def test_extract_keeps_rows(frame):
    df = frame([(1, None, "old", 5), (1, "<article><p>né</p></article>", "old", 5)], "page_id int, html string, text string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("", 0), ("né", 2)]
    assert html_text.extract(df.where("page_id = 9")).count() == 0


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


TEXTS = [
    None, "", " \n\t", "a", "a b", "a b c", "a a a a", "one\ntwo\none\n\n\none", "#*$% &|<> \x85\xa0 x", "w1 " * 300,
    " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 40}" for i in range(120)), " ".join(f"w{i}" for i in range(20_000)), "é😀 " * 60,
]


def test_measures(frame):
    df = frame([(i, t, "h", True) for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, source string, kept boolean")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        assert tuple(rows[i][c] for c in (*quality.MEASURES, "base_failed")) == brute_quality(t), i
    assert quality.judge(df.where("doc_id < 0")).count() == 0


def test_bad_hosts_apply_the_strict_rules(frame):
    good = " ".join(f"w{i}" for i in range(90))
    symbols = good + " #" * 50  # breaks a strict rule only
    rows = [("clean", good)] * 40 + [("clean", symbols)] * 2 + [("junk", symbols)] * 30 + [("junk", good)] * 3 + [(None, good)] * 5 + [("tiny", symbols)]
    out = quality.judge(frame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id int, source string, text string")).collect()
    kept = {(r.source, r.n_symbols > 0): r.kept for r in out}
    assert kept == {("clean", False): True, ("clean", True): True, ("junk", True): False, ("junk", False): True, (None, False): True, ("tiny", True): kept[("tiny", True)]}
    hosts = {r["_host"]: r for r in quality.host_verdicts(quality.measure(frame([(s, t) for s, t in rows], "source string, text string"))).collect()}
    assert hosts["tiny"].host_rate < hosts["junk"].host_rate < 1 and len(hosts) == 4


def test_licences(frame):
    texts = {
        1: None, 2: "", 3: "Licensed under CC BY-NC 4.0.", 4: "x all rights\nRESERVED. Everything else; General public license",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "Licensed under the Apache License, Version 2.0.",
        7: "license mit the of and", 8: "word " * 30_000 + "Released under the MIT License.", 9: "CC-BY cc by", 10: "rights reserved all",
    }
    df = frame([(k, t, "x") for k, t in texts.items()], "doc_id int, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for k, r in rows.items()} == {
        1: (0, None, None, "", ""), 2: (0, None, None, "", ""), 3: (1, 2, 2, "cc-by", "cc-by,cc-by-nc"), 4: (2, 1, 6, "gpl,reserved", "gpl,reserved"),
        5: (1, 7, 7, "gpl", "gpl,gpl-notice"), 6: (0, None, None, "", "apache-2.0"), 7: (0, None, None, "", ""),
        8: (0, None, None, "", "mit"), 9: (2, 0, 2, "cc-by", "cc-by"), 10: (0, None, None, "", ""),
    }
    assert rows[8].n_words == 30_005 and rows[6].score == pytest.approx(1.0) and rows[7].score == 0
    assert licenses.scan(df.where("doc_id > 99")).count() == 0


def test_a_file_of_all_notices_has_every_label(frame):
    notices = [text for _, _, text in licenses.TEMPLATES]
    common = "mit license under the apache gnu cc by nc general public"  # the corpus's common words are looked up as well
    df = frame([(0, " and\n".join(notices)), *((k, f"{common} {k}") for k in range(1, 40))], "doc_id int, text string")
    row = licenses.scan(df).where("doc_id = 0").first()
    assert row.labels.split(",") == sorted({label for label, _, _ in licenses.TEMPLATES} | {"cc-by", "gpl"}) and row.score == pytest.approx(1.0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_held_out_texts(documents):
    model = language.learn(documents.select("doc_id", "text", "lang"))
    out = language.predict(documents, model)
    held = out.where(language.held_out(out["doc_id"])).select("lang", "lang_pred", "score").collect()
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held) and out.count() == 1000


def test_language_without_letters_or_labels(frame, documents):
    model = language.learn(documents)
    df = frame([(1, None), (2, ""), (3, "123 !?"), (4, "the house of the king " * 20_000), (4, "the")], "doc_id int, text string")
    rows = language.predict(df, model).collect()
    assert {r.lang_pred for r in rows if r.doc_id < 4} == {"und"} and {r.score for r in rows if r.doc_id < 4} == {0.0} and len(rows) == 5
    none = language.learn(frame([(1, "text", None), (None, None, "en")], "doc_id int, text string, lang string"))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.where("doc_id > 9"), model).count() == 0


def test_fit_does_not_see_held_out_rows(frame):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(200)]
    df = frame(rows, "doc_id long, text string, lang string")
    held = df.where(language.held_out(df["doc_id"]))
    assert language.learn(held).languages == [] and language.learn(df).languages == ["x", "y"]
