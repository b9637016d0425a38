"""Pages that are not as they should be."""

import time

import pytest

from orbweaver.llm import html


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p class=x">text one <a href="y">two</a> three</p></article>', "text one two three"),
        ("<article><p title='a>b' data-x=\"c>d\" e=f>ok</p></article>", "ok"),
        ('<article><p x = "a>b">ok <a href=/?q="z>link</a></p></article>', "ok link"),
        ("<article><!--><p>after an empty comment</p><!---><p>and another</p></article>", "after an empty comment\n\nand another"),
        ("<article><p>a</ bogus>b</p></article>", "ab"),
        ('<article><div class="related">Work that is related to ours began early.</div></article>', "Work that is related to ours began early."),
        ('<article><p>x</p><div class="related"><a href="1">One</a> <a href="2">Two</a></div></article>', "x"),
        ('<article><div role="note">A note of the article.</div><p class="tags">Tags are words <a>here</a>.</p></article>', "A note of the article.\n\nTags are words here ."[:-2] + "."),
        ('<article><p>x</p><div class="related"><a href="1">One</a>', "x"),
    ],
)
def test_broken_pages(page, want):
    assert html.main_text(page) == want


def test_time_follows_length():
    def seconds(n):
        page = "<article>" + "<b><i>x</u></s>" * n
        start = time.process_time()
        html.main_text(page)
        return time.process_time() - start

    seconds(1000)
    small, large = seconds(8_000), seconds(64_000)
    assert large < 30 * max(small, 0.02)


def test_strings_across_blocks(spark):
    menu = "".join(f"<li>{w}</li>" for w in "home news sport maps shop help jobs about".split())
    df = spark.createDataFrame([(i, f"http://h.example/{i}", f"<ul>{menu}</ul><p>page {i} is one of a kind {i}</p>") for i in range(3)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_removed) for r in html.host_repeats(df).collect()}
    assert got == {i: (f"page {i} is one of a kind {i}", 8) for i in range(3)}
