"""HTML extraction: every page against a plain reading of its article, and odd pages."""

import re
from html import unescape

import pytest

from rewardframe.llm import html_text
from rewardframe.llm.common import read

SF = "/root/testdata/sf0.01"
LONG = "The quick brown fox is in the house and it was on the way to the town of all the others."


def plain(page):
    """The given pages hold their text in one article of h1 and p elements."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
    return "\n".join(t for t in (" ".join(unescape(b).split()) for b in blocks) if t)


def test_pages_equal_their_articles(spark):
    pages = read(spark, SF, "pages")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = html_text.op3_extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("only text &amp; nothing", "only text & nothing"),
        (f"<nav><a href=x>A</a></nav><div id=content><p>{LONG}<p>Short.</div><div class=comments><p>{LONG}</div>", f"{LONG}\nShort."),
        ("<header>Site</header><main><p>Short</p><aside>x</aside><form><label>y</label></form><ul><li><a href=#>R</a></li></ul></main>", "Short"),
        ("<article><header><h1>T</h1></header><p>Hi", "T\nHi"),
        ("<article><p>x</p><div class='cookie-notice'>We use cookies</div></article><!-- open <p>", "x"),
        ("<article class=post><p>a</p></article><section id=comments><article><p>b</p></article></section>", "a"),
        ("<article><p>a\t b\n c &#233;&nbsp;d<br>e<script>if (a < b) x('</p>')</script></p>", "a b c é d e"),
        ("<article><p>1 < 2 and 3 > 2</p><p", "1 < 2 and 3 > 2"),
        ("<article><p style='display:none'>no</p><p hidden>no</p><p>yes</p></article>", "yes"),
        (f"<div><p>{LONG}</p><p>Short one.</p><p><a href=x>{LONG}</a></p></div>", f"{LONG}\nShort one."),
        ("<article><p>" + "word " * 200000 + "</p></article>", " ".join(["word"] * 200000)),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page)[0] == text


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    rows = html_text.op3_extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in rows) == [(0, "u", "x", 1), (0, "u", "x", 1), (1, "", "", 0)]
    assert html_text.op3_extract(df.limit(0)).count() == 0


LINKS = "<a href=x>Home</a> <a href=y>News</a>"
SPARSE = "Offer 3000 cheap flights hotels cars insurance casino poker loans phones watches discount brands deals."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # pages whose names and elements tell nothing
        (f"<div>{LINKS}</div><div class=c3>Sign up now!</div><h1>T</h1><p>{LONG}<p>End.", f"T\n{LONG}\nEnd."),
        (f"<div><p>{LONG}<p>{LONG}</div><div class=c1><p>{SPARSE}<p>Buy now!</div>", f"{LONG}\n{LONG}"),
        (f"<table><tr><td>{LINKS}<td>Log in<tr><td>{LONG}<td>More by us, <a href=x>here and there</a>", LONG),
        # without any known stop words, density rejects nothing
        (f"<div><p>{SPARSE}<p>Short</div>", f"{SPARSE}\nShort"),
    ],
)
def test_density_decides(page, text):
    assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='main-image'><p>Photo: X</p></div><div class='body'><p>{LONG}</p><p>{LONG}</p></div>", f"Photo: X\n{LONG}\n{LONG}"),
        (f"<div class=content><p>{LONG}</p></div><article><h2><a href=x>Teaser</a></h2></article>", f"{LONG}\nTeaser"),
        (f"<div class='page-with-sidebar'><p>{LONG}</p><div class=sidebar><p>{LONG}</p></div></div>", LONG),
        (f"<div class='content-sidebar'><h1>T</h1><p>{LONG}</p></div><div class=footer>{LONG}</div>", f"T\n{LONG}"),
        (f"<main><p>{LONG}</p><p>{LONG}</p></main><div class='left-sidebar'><p>{LONG}</p></div><div>Sign up</div>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><article><p>Short story.</p></article>", f"{LONG}\nShort story."),
        (f"<article><p>x</p></article><div class='post-comments'><p>{LONG}</p></div>", "x"),
        (f"<div id=main><p>Hi</p></div><div><p>{LONG}</p></div>", f"Hi\n{LONG}"),
    ],
)
def test_one_name_does_not_drop_the_text(page, text):
    assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # what attributes say in passing
        (f'<article title="The hidden cost of it"><p>{LONG}</p></article>', LONG),
        (f'<div class="block hidden md:flex"><p>{LONG}</p></div>', LONG),
        (f'<div data-id="ad" data-role=banner><p>{LONG}</p></div>', LONG),
        (f"<div style='color: red; DISPLAY:  none'><p>{LONG}</p></div><p>{LONG} Two.</p>", f"{LONG} Two."),
        # names that the text overrules
        (f"<form id=aspnetForm><div class=menu>{LONG[:40]}</div><h1>T</h1><p>{LONG}</p><p>End.</p></form>", f"T\n{LONG}\nEnd."),
        (f"<form id=aspnetForm><p>{LONG}</p></form>", LONG),
        (f"<div class='promo-layout'><main><h1>T</h1><p>{LONG}</p></main></div><div class=promo>Buy</div>", f"T\n{LONG}"),
        (f"<div class=banner><main><p>{LONG}</p></main></div><footer>{LONG[:60]}</footer>", LONG),
        # subjects as ids
        (f"<article><h2 id=alert-levels>A</h2><p>{LONG}</p><h2 id=notice>N</h2><p>{LONG}</p><section id=promotion-of-health><h3 id=social-impact>S</h3><p>Short.</p></section></article>", f"A\n{LONG}\nN\n{LONG}\nS\nShort."),
        # the header of a text, and that of a page
        (f"<body><header><h1>Site</h1></header><div class=entry><header><h1>T</h1></header><p>{LONG}</p><p>End.</p></div>", f"T\n{LONG}\nEnd."),
        # furniture without a name
        (f"<div>Home News Sport</div><div><h1>T</h1><p>{LONG}</p><p>End.</p></div><div>Sign up now!</div>", f"T\n{LONG}\nEnd."),
        (f"<div>{LONG}</div><div>So he said.</div><div>{LONG}</div>", f"{LONG}\nSo he said.\n{LONG}"),
        # furniture with the longer text stays furniture
        (f"<div><h1>T</h1><p>Some short news.</p></div><footer><p>{LONG}</p></footer>", "T\nSome short news."),
        (f"<div><h1>T</h1><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p><h1>x</h1></div>", f"T\n{LONG}"),
    ],
)
def test_text_and_names(page, text):
    assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize(
    "unit",
    [
        ("<div>", "</section>"), ("<b>", "</i>"), ("<i><div>" + "<b>" * 9, "</i>"), ("<div class=x-sidebar>a", ""), ("<b>", "<div>x</div>"),
        ("<p><table><b>", "<div></div>"), ("<div a=b ", "c='>' "), ("<", ">"), ("<header>", "<h1>"), ("<!--", "<p"), ("&lt;", "<a href=x>y"),
    ],
)
def test_time_is_linear(unit):
    import time

    times = []
    for size in (250_000, 1_000_000):
        page = unit[0] * (size // 2 // len(unit[0])) + unit[1] * (size // 2 // max(1, len(unit[1])))
        start = time.process_time()
        html_text.main_text(page)
        times.append(time.process_time() - start)
    assert times[1] < 12 * max(times[0], 0.05) and times[1] < 15
