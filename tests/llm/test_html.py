import re
from html import unescape

import pytest

from orbweaver.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header>Site</header><nav><ul><li>Menu</li></ul></nav><!-- c --><div class="ad">Buy</div>
<article><header><h1>Head &amp;  line</h1></header><p>First <b>bold</b> x&nbsp;y<br>after break<p>open &lt;tag&gt;
<div class="cookie-notice"><p>Notice</p></div><form><p>Form</p><input></form><ul><li>item one<li>item two</ul>
<section id="comments"><p>Reader</p></section><blockquote>Quote</blockquote></article>
<aside>Side</aside><footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize(
    "page,want",
    [
        (PAGE, "Head & line\n\nFirst bold x y\n\nafter break\n\nopen <tag>\n\nitem one\n\nitem two\n\nQuote"),
        (None, ""),
        ("", ""),
        ("<p>no article</p><footer>f</footer>", "no article"),
        ("<article><p>cut off</p><p class='x", "cut off"),
        ("<article><p>a &am b &amp c &quot;d&quot; &#233;", 'a &am b & c "d" é'),
        ("<article>one<!-- hidden <p> -->two</article><article><p>three</article>", "onetwo\n\nthree"),
        ('<article><p title="a>b">ok</p><div style="display:none">no</div><div hidden>no</div><p class="broad">yes</p></article>', "ok\n\nyes"),
        ("<article>" + "<p>word " * 5000 + "</article>", "\n\n".join(["word"] * 5000)),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def slow(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"<(?:/?p|/?h1|br)>", body)
    parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_query_against_brute_force(spark):
    from orbweaver.llm.queries import op9_html_extraction

    got = {r.page_id: r for r in op9_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = slow(r.html)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html.extract(df).collect()) == [0, 79, 79]
    assert html.extract(df.limit(0)).count() == 0


def test_host_repeats(spark):
    page = lambda i: f"<p>menu of this site with many links to follow</p><p>story number {i} tells of thing {i}</p>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(4)] + [(9, "http://other.example/", page(9)), (10, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.host_repeats(df).collect()}
    assert got[2] == "story number 2 tells of thing 2" and got[9].startswith("menu of this site") and got[10] == ""
    assert html.host_repeats(df.limit(0)).count() == 0
