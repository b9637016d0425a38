"""Workbooks, slides and documents of the open XML formats, and HTML as plain text."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from orbweaver.operators.chunking import pack

MAX_PART = 64 << 20  # bytes of one part that are unpacked


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def _all(node: ElementTree.Element | None, tag: str) -> list[ElementTree.Element]:
    return [] if node is None else [n for n in node.iter() if _local(n.tag) == tag]


def _text(node: ElementTree.Element | None, tag: str = "t") -> str:
    return "".join(n.text or "" for n in _all(node, tag))


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def column_index(letters: str) -> int:
    """A column's letters as a number from 0."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(path: str, data: bytes) -> list[tuple[int, str]]:
    """'[Workbook: f | Sheet: s | Row n] header: value | ...' for each row under a sheet's first."""
    name, out = path.rsplit("/", 1)[-1], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_text(s) for s in _all(_part(z, "xl/sharedStrings.xml"), "si")]
        sheets = [s.get("name", "") for s in _all(_part(z, "xl/workbook.xml"), "sheet")]
        for sheet, part in zip(sheets, _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            header: dict[int, str] | None = None
            for row in _all(_part(z, part), "row"):
                cells = {}
                for k, c in enumerate(_all(row, "c")):
                    at = column_index(m[0]) if (m := re.match(r"[A-Za-z]+", c.get("r", ""))) else k
                    v = _text(c, "v")
                    cells[at] = shared[int(v)] if c.get("t") == "s" and v else _text(c) if c.get("t") == "inlineStr" else v
                if not any(cells.values()):
                    continue
                if header is None:
                    header = {k: v.strip() or f"Column {k + 1}" for k, v in cells.items()}
                    continue
                body = " | ".join(f"{header.get(k, f'Column {k + 1}')}: " + v.strip() for k, v in sorted(cells.items()) if v.strip())
                out.append((len(out), f"[Workbook: {name} | Sheet: {sheet} | Row {row.get('r', len(out) + 2)}] {body}"))
    return out


def slides(path: str, data: bytes) -> list[tuple[int, str]]:
    """'[Slide n] title', body lines, tables, diagrams' texts and notes of each slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n, part in enumerate(_numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
            title, lines = "", []
            for shape in _all(_part(z, part), "sp"):
                paragraphs = [t for p in _all(shape, "p") if (t := _text(p).strip())]
                if any(p.get("type") in ("title", "ctrTitle") for p in _all(shape, "ph")):
                    title = " ".join(paragraphs)
                else:
                    lines += paragraphs
            for row in _all(_part(z, part), "tr"):
                lines.append(" | ".join(_text(c).strip() for c in _all(row, "tc")))
            links = _all(_part(z, part.replace("slides/slide", "slides/_rels/slide") + ".rels"), "Relationship")
            for target in sorted(t for x in links if re.search(r"diagrams/data\d*\.xml$", t := x.get("Target", ""))):
                lines += [t for p in _all(_part(z, "ppt/" + target.removeprefix("../")), "p") if (t := _text(p).strip())]
            notes = [t for p in _all(_part(z, part.replace("slides/slide", "notesSlides/notesSlide")), "p") if (t := _text(p).strip()) and not t.isdigit()]
            text = "\n".join([f"[Slide {n}] {title}".strip(), *lines, *(["Notes: " + " ".join(notes)] if notes else [])])
            out.append((n, text))
    return out


def document(path: str, data: bytes, size: int = 1200) -> list[tuple[int, str]]:
    """Paragraphs packed under their heading; tables as Markdown chunks of their own."""
    chunks: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(_all(_part(z, "word/document.xml"), "body")), None)
        heading, lines = "", []

        def flush() -> None:
            chunks.extend(pack(lines, heading and f"Section: {heading}", size))
            lines.clear()

        for node in body if body is not None else []:
            if _local(node.tag) == "p":
                style = next((v for s in _all(node, "pStyle") for k, v in s.attrib.items() if _local(k) == "val"), "")
                text = _text(node).strip()
                if style.lower().startswith(("heading", "title")) and text:
                    flush()
                    heading = text
                elif text:
                    lines.append(("- " if _all(node, "numPr") else "") + text)
            elif _local(node.tag) == "tbl":
                flush()
                rows = [[_text(c).strip() for c in _all(r, "tc")] for r in _all(node, "tr")]
                if rows:
                    chunks.append("\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]))
        flush()
        notes = [t for n in _all(_part(z, "word/footnotes.xml"), "footnote") if (t := _text(n).strip())]
        if notes:
            chunks.append("Footnotes:\n" + "\n".join(notes))
    return list(enumerate(chunks))


def grouped_sections(items: list[tuple[str, str, str]], name: str, size: int = 1200) -> list[tuple[str, str]]:
    """(section, narrative) of items (section, kind, text): a section's paragraphs and list items are packed, its heading on top.

    Tables and other items stand alone, and so does a heading without a body.
    """
    out: list[tuple[str, str]] = []
    heading: tuple[str, str] | None = None
    body: list[str] = []
    section = ""

    def flush() -> None:
        nonlocal heading
        if body:
            top = [heading[1]] if heading and heading[0] == section else []
            if not top and heading:
                out.append(heading)
            out.append((section, f"[Document: {name} | Section: {section}]\n" + "\n".join(top + body)))
            body.clear()
        elif heading:
            out.append(heading)
        heading = None

    for where, kind, text in items:
        if kind == "heading":
            flush()
            heading = (where, text)
        elif kind in ("paragraph", "list_item"):
            if body and (where != section or sum(len(t) + 1 for t in body) + len(text) > size):
                flush()
            section = where
            body.append(text)
        else:
            flush()
            out.append((where, text))
    flush()
    return out


#: Names of streams in an old workbook, which are no text of it.
_STREAMS = {"Root Entry", "Workbook", "Book", "CompObj"}


def legacy_workbook(path: str, data: bytes) -> list[tuple[int, str]]:
    """An old binary workbook without a reader for it: its readable runs, five a row."""
    name = path.rsplit("/", 1)[-1]
    single = [m.decode("latin-1") for m in re.findall(rb"[ -~]{3,}", data)]
    double = [m.decode("utf-16-le") for m in re.findall(rb"(?:[ -~]\0){2,}", data)]
    found: list[str] = []
    for i, text in enumerate(single + double):
        text = text.strip()
        if len(text) > 1 and text[0] != "_" and text not in _STREAMS and not (i >= len(single) and text in found):
            found.append(text)
    rows = [found[i : i + 5] for i in range(0, len(found), 5)]
    return [(n, f"[Workbook: {name} | Sheet: Sheet1 | Row {n}] " + " | ".join(f"Col_{k}: {v}" for k, v in enumerate(r, 1))) for n, r in enumerate(rows, 1)]


def embedded_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the pictures inside an open XML file, by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(i.filename for i in z.infolist() if re.search(r"/media/[^/]+\.(?:png|jpe?g|bmp|gif|webp)$", i.filename, re.I) and i.file_size <= MAX_PART)
        return [(n, z.read(n)) for n in names]


def image_texts(data: bytes, read=None) -> list[str]:
    """A line an embedded picture: what ``read`` makes of its bytes, else its name and size."""
    out = []
    for name, image in embedded_images(data):
        text = (read(image) if read else None) or f"{len(image)} bytes"
        out.append(f"[Image: {name.rsplit('/', 1)[-1]}] {text.strip()}")
    return out


class _Plain(HTMLParser):
    HIDDEN, BREAKS = {"script", "style", "head"}, {"p", "br", "div", "li", "tr", *(f"h{n}" for n in range(1, 7))}

    def __init__(self) -> None:
        HTMLParser.__init__(self)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(html: str) -> str:
    """HTML without markup, a line a block, white space folded."""
    p = _Plain()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)
