"""Main text of web pages.

Two means are offered. ``extract`` reads the page's markup: text outside the article, and inside it
everything that markup calls a menu, notice, advert, form or comment, is left out. ``host_repeats``
works without markup: the pages of a host are token streams, token strings that start on several
distinct pages are found by their hashes, and tokens covered by them are boilerplate.
Repetition alone can't tell a copied article from a footer, so the registered query uses markup, and
repeats serve pages whose markup says nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.session import cut

#: A tag, comment or declaration. A value in quotes after '=' may hold '>'; any other quote is a character of the tag.
#: What has no end of its own ends with the page.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*)(?:>|\Z)",
    re.S,
)
#: What a browser does not show as text; read up to its own end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object", "canvas", "audio", "video", "select"}
#: Elements that are no part of an article.
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "label", "datalist"}
#: Elements that end a block.
BLOCK = {
    *"address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form".split(),
    *"frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section".split(),
    *"summary table tbody td tfoot th thead tr ul caption".split(),
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that an open <p> does not survive, and which close an open one of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Words in class or id by which pages name what is no article text.
NAMED = re.compile(
    r"(?:^|[\s_\-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|"
    r"footer|masthead|cookie|cookies|consent|gdpr|notice|newsletter|subscribe|subscription|popup|modal|comment|comments|commentlist|disqus|replies|respond|pagination|pager)(?:$|[\s_\-\d])",
    re.I,
)
#: Words that name lists of links as well as parts of an article; only what is mostly links is left out.
LINKS = re.compile(
    r"(?:^|[\s_\-])(?:widget|reply|share|sharing|social|related|recommended|recommendations|toolbar|overlay|skip|login|signup|search|tags|tagcloud)(?:$|[\s_\-\d])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"[\s\x00]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _named(a: dict[str, str], pattern: re.Pattern) -> bool:
    return any(pattern.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a[k])) for k in ("class", "id") if a.get(k))


def _left_out(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(whether an element is left out, whether it is if most of its text is links)."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True, False
    if not attrs.strip():
        return False, False
    a = attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True, False
    if tag in ("article", "main", "body", "html"):
        return False, False
    return _named(a, NAMED), _named(a, LINKS)


class _Page:
    """The state of reading one page: open elements, what they leave out, and the blocks so far."""

    def __init__(self) -> None:
        self.inside: list[tuple[str, str]] = []  # blocks in articles
        self.outside: list[tuple[str, str]] = []
        self.stack: list[tuple[str, bool, tuple | None]] = []  # tag; whether text was left out before; counts before a list of links
        self.open: Counter = Counter()
        self.out = False
        self.parts: list[str] = []
        self.tag, self.chars, self.linked = "", 0, 0

    def text(self, s: str) -> None:
        if not self.out and s:
            self.parts.append(s)
            n = len(s.strip())
            self.chars += n
            self.linked += n * (self.open["a"] > 0)

    def flush(self) -> None:
        text = SPACE.sub(" ", unescape("".join(self.parts))).strip()
        self.parts.clear()
        if text:
            (self.inside if self.open["article"] else self.outside).append((self.tag, text))

    def push(self, tag: str, attrs: str) -> None:
        out, links = _left_out(tag, attrs, self.open["article"] > 0)
        mark = None
        if links and not out and not self.out:
            self.flush()
            mark = (len(self.inside), len(self.outside), self.chars, self.linked)
        self.stack.append((tag, self.out, mark))
        self.open[tag] += 1
        self.out = self.out or out

    def pop(self) -> str:
        tag, was, mark = self.stack.pop()
        if mark:
            self.flush()
            inside, outside, chars, linked = mark
            if 2 * (self.linked - linked) > self.chars - chars:
                del self.inside[inside:], self.outside[outside:]
        self.open[tag] -= 1
        self.out = was
        return tag


def blocks(html: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(blocks in articles, all other blocks that are not left out); a block is (tag, text).

    Takes time in proportion to the page: an end tag that closes nothing is known by a count of open elements.
    """
    page, at, low = _Page(), 0, None
    if not html:
        return page.inside, page.outside
    while m := MARKUP.search(html, at):
        page.text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag in ("p", "br"):
                page.flush()
            if page.open[tag] <= 0:
                continue
            if tag in BLOCK:
                page.flush()
            while page.pop() != tag:
                pass
            continue
        if tag in RAW:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            low = low if low is not None else html.lower()
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else (html.find(">", end) + 1 or len(html))
            continue
        if tag in BLOCK:
            page.flush()
            page.tag = tag
        if tag in VOID:
            continue
        if closes := CLOSES.get(tag):  # an end tag that was left away
            for i in range(len(page.stack) - 1, max(-1, len(page.stack) - 6), -1):
                if page.stack[i][0] in closes:
                    while len(page.stack) > i:
                        page.pop()
                    break
                if page.stack[i][0] in BLOCK and page.stack[i][0] != "p":
                    break
        elif tag in BLOCK and page.stack and page.stack[-1][0] == "p":
            page.pop()
        if m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        page.push(tag, m[3])
    page.text(html[at:])
    page.flush()
    while page.stack:
        page.pop()
    return page.inside, page.outside


def main_text(html: str | None) -> str:
    """The article's blocks, joined by two line breaks; where a page has no article, all blocks not left out."""
    inside, outside = blocks(html)
    return "\n\n".join(text for _, text in inside or outside)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (the main text) and n_chars (its code points), in place of ``html_col``.

    Rows are independent, so nothing is shuffled. Null and empty pages have an empty text; a page cut
    off in a tag ends there; pages of any length and depth are read whole; repeated rows stay; an empty
    table gives no rows. Columns named text or n_chars are replaced, other columns stay.
    """

    @F.pandas_udf("string")
    def of(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    out = pages.withColumn("text", of(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
    return out.drop(html_col) if html_col not in ("text", "n_chars") else out


def host(url: Column) -> Column:
    """The host of a URL, lower-cased; null where there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_tokens(html: str | None) -> list[list[str]]:
    """The tokens of each block of a page, in page order as far as articles and the rest allow."""
    inside, outside = blocks(html)
    return [t.split(" ") for _, t in [*inside, *outside]]


def all_tokens(html: str | None) -> list[list[str]]:
    """The tokens of each run of text between block tags, with nothing left out but what is never shown."""
    out, parts, at, low = [], [], 0, None

    def flush() -> None:
        if found := SPACE.sub(" ", unescape("".join(parts))).split():
            out.append(found)
        parts.clear()

    html = html or ""
    while m := MARKUP.search(html, at):
        parts.append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag in RAW and not m[1]:
            low = low if low is not None else html.lower()
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else (html.find(">", end) + 1 or len(html))
        elif tag in BLOCK:
            flush()
    parts.append(html[at:])
    flush()
    return out


def host_repeats(pages: DataFrame, min_tokens: int = 8, min_pages: int = 3, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", tokens=page_tokens) -> DataFrame:
    """(id, text, n_removed): the tokens of each page but those in strings that repeat on its host.

    Every page is one stream of tokens, across its blocks. The suffixes of a host's streams that agree in
    their first ``min_tokens`` tokens and start on ``min_pages`` distinct pages of the host are boilerplate:
    a block that such strings cover as a whole goes, and of other blocks what strings inside them cover. Suffixes are grouped by a hash of that beginning instead of
    sorted: only which of them agree is wanted, and counts of groups aggregate before their shuffle, so a host
    with very many pages is no task of its own. A page of fewer tokens is one string. ``tokens`` makes the
    blocks of a page: page_tokens of what markup leaves in, all_tokens of everything shown.

    Null and empty pages have no tokens; repeated rows count as pages of their own but each gets its
    result once; rows without an id are one page; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))

    def windows(found: list[str]) -> list[int]:
        import xxhash

        n = len(found)
        return [xxhash.xxh64_intdigest(" ".join(found[i : i + min_tokens]).encode("utf-8", "surrogatepass"), 42) - (1 << 63) for i in range(max(1, n - min_tokens + 1))] if n else []

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, html in enumerate(batch.column(2)):
                found = set(windows([t for b in tokens(html.as_py()) for t in b]))
                rows += [i] * len(found)
                out += found
            place = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(out, pa.int64())], ["id", "host", "h"])

    s = base.mapInArrow(strings, f"id {kind}, host string, h long")
    shared = cut(s.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "h"))
    mine = s.join(shared, ["host", "h"], "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs"))  # strings of one page
    joined = base.join(mine, base.id.eqNullSafe(mine.id), "left").select(base.id, "html", "hs")

    @F.pandas_udf("text string, n_removed long")
    def left(htmls: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        out = []
        for html, hs in zip(htmls, hashes, strict=True):
            bad, parts = set() if hs is None else set(map(int, hs)), tokens(html)
            found = [t for b in parts for t in b]
            ends = np.repeat(np.cumsum([len(b) for b in parts]), [len(b) for b in parts]) if parts else np.zeros(0, np.int64)
            cover, own = np.zeros(len(found), bool), np.zeros(len(found), bool)  # by any string; by strings of one block
            for i, w in enumerate(windows(found) if bad else ()):
                if w in bad:
                    cover[i : i + min_tokens] = True
                    if i + min_tokens <= ends[i]:
                        own[i : i + min_tokens] = True
            kept, at, removed = [], 0, 0
            for b in parts:
                here = slice(at, at + len(b))
                gone = cover[here] if cover[here].all() else own[here]
                removed += int(gone.sum())
                if text := " ".join(t for t, g in zip(b, gone, strict=True) if not g):
                    kept.append(text)
                at += len(b)
            out.append(("\n\n".join(kept), removed))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    return joined.withColumn("r", left("html", "hs")).select(F.col("id").alias(id_col), "r.text", "r.n_removed")
