import html
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy</div><aside>Side</aside>
<article><h1>Caf&eacute; &amp;  more</h1><p><b>One &lt;two&gt;
 three<br>four<p>Five&nbsp;six<div class="share-buttons">Share</div><ul><li>a<li>b</ul>
<table><tr><td>c<td>d</table><form><input value=x><p>Mail</p></form><section class="comments"><p>First!</p></section><!-- <p>no</p> --><p hidden>no</p></article>
<article class="comment"><p>Me too</p></article><footer>End</footer>"""


def test_one_page():
    assert extract.main_text(PAGE) == "Café & more\nOne <two> three four\nFive six\na\nb\nc\nd"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; so", "no markup & so"),
        ("<p>a</p>b<p>c", "a\nb\nc"),
        ("<body><nav>x</nav></body>", ""),
        ("<div class='content'><p>in</p><div class='sidebar'>no</div></div><div>out</div>", "in"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<div role='navigation'>no</div><p>a <b>b</b> <i>c</i>d</p>", "a b cd"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<p title='a>b'>x</p></div></p>y", "x\ny"),
        ("<script>never ends <p>x</p>", ""),
        ("<P>UP</P><BR/>er", "UP\ner"),
        ("<blockquote><p>q</p></blockquote><pre>a\n  b</pre>", "q\na b"),
        ("<p>&#8364;&#x41;&bogus;</p>", "€A&bogus;"),
    ],
)
def test_small_pages(page, text):
    assert extract.main_text(page) == text


def site(spark, n=24):
    """Pages of one host without telling elements: the template has to be deduced."""
    rows = []
    for i in range(n):
        extra = "<div>Members only</div><div>Club</div>" if i % 2 else ""
        shared = "<p>A passage some pages share.</p>" if i % 3 == 0 else ""
        rows.append((i, f"https://h.example/p/{i}", f"<body><div>Main menu</div>{extra}<div><p>Text {i} &amp; so.</p>{shared}</div><div>All about us</div></body>"))
    rows += [(100 + i, f"https://few.example/{i}", "<body><div>Main menu</div><p>Same</p></body>") for i in range(3)]
    rows += [(200, None, "<p>n</p>"), (201, "https://h.example/x", None), (None, "https://h.example/y", ""), (202, "mailto:x", "<p>m</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "token": F.lit(2), "pages": F.lit(3)})


def test_template_is_deduced(spark):
    rows, pages = site(spark)
    out = extract.extracted(pages)
    assert out.columns == [*pages.columns, "text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["url"] and r["url"].startswith("https://h.example/p/"):
            i = r["page_id"]
            assert r["text"] == f"Text {i} & so." + ("\nA passage some pages share." if i % 3 == 0 else "")
    by = {r["page_id"]: r["text"] for r in got}
    assert by[100] == "Main menu\nSame" and by[200] == "n" and by[201] == "" and by[None] == "" and by[202] == "m"


def test_template_against_occurrence_vectors(spark):
    """The sums stand for whole vectors: the same classes come out of comparing these."""
    rows, pages = site(spark)
    vectors = {}
    mine = [r for r in rows if r[1] and r[1].startswith("https://h.example/")]
    for page_id, url, page in mine:
        for t in extract.page_tokens(page):
            vectors.setdefault((t["token"], t["is_text"], t["parent"]), {})[url] = t["n"]
    often = {k: tuple(sorted(v.items())) for k, v in vectors.items() if len(v) >= extract.MIN_PAGES and len(v) >= extract.MIN_SHARE * len(mine)}
    tokens = [v for k, v in often.items() for _ in range(1 if k[1] else 2)]
    valid = {k for k, v in often.items() if tokens.count(v) > 1}
    elements = {k[0] for k in valid if not k[1]}
    want = sorted(k[0] for k in valid if k[1] and k[2] in elements)
    got = {r["host"]: r["tokens"] for r in extract.templates(pages).collect()}
    assert list(got) == ["h.example"] and got["h.example"] == want and len(want) == 4


def test_deep_and_broken_pages_take_linear_time():
    import time

    start = time.thread_time()
    for page in ("<div>" * 60_000 + "x", "<p>" + "<b>a" * 60_000, "</i>" * 60_000 + "y", "<div><i>" * 30_000 + "</b>" * 30_000 + "z"):
        assert extract.main_text(page) and extract.page_tokens(page)
    assert time.thread_time() - start < 20


def test_empty_and_query(spark):
    from tidemark.llm.queries import QUERIES

    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op9_page_template"](spark, sf).collect()
    assert sorted(pages) == sorted(r["page_id"] for r in got)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_template_decides_inside_articles_too(spark):
    """Lines that a host repeats in its articles, without a telling name, are dropped; an article element that holds nothing else is no slot."""
    rows = [(i, f"https://a.example/{i}", f"<article><h2>Our site</h2><p>Text {i}.</p><p>Own {i}.</p><p>Read on each day.</p><p>Made by us.</p></article>") for i in range(20)]
    rows += [(100 + i, f"https://b.example/{i}", f"<article><i>Join us</i></article><div><p>Text {i}.</p></div>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}.\nOwn {i}." for i in range(20)} | {100 + i: f"Text {i}." for i in range(20)}


def test_copies_and_shared_passages_are_no_template(spark):
    """Pages of plain divs: 8 copies of one article among 20, and a pair of paragraphs in half of the articles."""
    page = lambda body: f"<body><div>Main menu</div><div>{body}</div><div>All about us</div></body>"
    rows = [(i, f"https://c.example/{i}", page("<p>Copied one.</p><p>Copied two.</p>") if i < 8 else page(f"<p>Text {i}.</p><p>More {i}.</p>")) for i in range(20)]
    shared = "<p>Shared one.</p><p>Shared two.</p>"
    rows += [(100 + i, f"https://d.example/{i}", page(f"<p>Text {i}.</p>{shared if i % 2 else ''}")) for i in range(24)]
    rows += [(200 + i, f"https://e.example/{i}", page(f"<p>Copy {i % 2}.</p><p>Again {i % 2}.</p>")) for i in range(24)]
    got = {r["page_id"]: r["text"] for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        # Eight copies are one content.
        assert got[i] == ("Copied one.\nCopied two." if i < 8 else f"Text {i}.\nMore {i}.")
    for i in range(24):
        assert got[100 + i] == f"Text {i}." + ("\nShared one.\nShared two." if i % 2 else "")
        assert f"Copy {i % 2}.\nAgain {i % 2}." in got[200 + i]
