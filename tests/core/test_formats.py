import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from orbweaver.sources.formats import audio, code, images, mail, office, pdf, video


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def test_office():
    book = zipped({
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><t>Ann</t></si></sst>",
        "xl/workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Age</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>',
    })
    assert office.workbook("d/b.xlsx", book) == [(0, "[Workbook: b.xlsx | Sheet: S1 | Row 2] Name: Ann | Age: 5")]
    assert [office.column_index(c) for c in ("A", "Z", "AA")] == [0, 25, 26]
    deck = zipped({"ppt/slides/slide1.xml": '<sld><sp><nvPr><ph type="title"/></nvPr><p><t>Plan</t></p></sp><sp><p><t>point</t></p></sp></sld>', "ppt/notesSlides/notesSlide1.xml": "<n><p><t>say it</t></p></n>"})
    assert office.slides("x", deck) == [(1, "[Slide 1] Plan\npoint\nNotes: say it")]
    doc = zipped({"word/document.xml": '<document xmlns:w="w"><body><p><pStyle w:val="Heading1"/><t>Intro</t></p><p><t>Hello</t></p><tbl><tr><tc><t>a</t></tc><tc><t>b</t></tc></tr><tr><tc><t>1</t></tc><tc><t>2</t></tc></tr></tbl></body></document>'})
    assert office.document("x", doc) == [(0, "Section: Intro\nHello"), (1, "| a | b |\n| --- | --- |\n| 1 | 2 |")]
    assert office.html_to_text("<p>a <b>b</b><script>x</script><p>c &amp; d") == "a b\nc & d"


def test_mail():
    raw = b"From: a@b.c\r\nSubject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nplain body\r\n> quoted\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--x--\r\n"
    assert mail.message("m.eml", raw) == [(0, "[Email From: a@b.c | Subject: Hi]\nplain body\n> quoted")]
    day = [{"user": "U1", "ts": "0.0", "text": "hi <@U2> &amp; <https://x.y|link>"}, {"user": "U2", "ts": "60.0", "text": "reply", "thread_ts": "0.0"}, {"user": "U1", "ts": "120", "text": "later"}, {"subtype": "channel_join", "text": "joined", "ts": "1"}]
    z = zipped({"users.json": json.dumps([{"id": "U1", "name": "ann"}, {"id": "U2", "name": "bob"}]), "general/1970-01-01.json": json.dumps(day)})
    assert mail.slack("x.zip", z) == [(0, "[Thread in #general]\nann: hi @bob & link (https://x.y)\nbob: reply"), (1, "[#general 1970-01-01]\n00:02 ann: later")]


def test_code():
    got = code.chunks("a.py", b"class A(B):\n    def f(self, x: int = 1) -> int:\n        return 1 if x and self else 2\n\ndef g(): pass\n")
    assert [t.split("]")[0] for _, t in got] == ["[Class: A(B) | Lines 1-3", "[Method: A.f | Lines 2-3 | Complexity 3", "[Function: g | Lines 5-5 | Complexity 1"]
    js = b'function f(a) { return "}" } // {\nclass X { m() { if (1) { } } }\n'
    assert [t.split("]")[0] for _, t in code.chunks("a.js", js)] == ["[Code: function f(a) | Line 1", "[Code: class X | Line 2"]
    api = json.dumps({"paths": {"/p": {"get": {"summary": "List", "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"description": "ok"}}}}}, "components": {"schemas": {"P": {"required": ["id"], "properties": {"id": {"type": "integer"}}}}}})
    assert [t for _, t in code.chunks("a.json", api.encode())] == ["[Operation: GET /p] List\nParameter q (query, required): string\nResponse 200: ok", "[Schema: P]\nid: integer (required)"]


def test_images():
    px = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    for kind in (0, 1, 2):
        rows = b""
        for y in range(4):
            line, up = px[y].reshape(5, 3), px[y - 1].reshape(5, 3) if y else np.zeros((5, 3), np.uint8)
            left = np.vstack([np.zeros((1, 3), np.uint8), line[:-1]])
            rows += bytes([kind]) + (line - (left if kind == 1 else up if kind == 2 else 0)).astype(np.uint8).tobytes()
        data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + part(b"tEXt", b"Title\0T") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
        got, text = images.png(data)
        assert (got == px).all() and text == {"Title": "T"}
    line = b"".join(px[y, :, ::-1].tobytes() + b"\0" for y in range(3, -1, -1))
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 4, 1, 24, 0, 0, 0, 0, 0, 0) + line
    assert (images.bmp(bmp) == px).all()
    f = images.describe(bmp)["features"]
    assert len(f) == 8 * 8 + 64 + 32 + 64 and abs(sum(x * x for x in f) - 1) < 1e-9
    assert images.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 10) == (40, 30)


def test_audio():
    t = np.arange(16000 * 2) / 16000
    x = (np.sin(2 * np.pi * 1000 * t) * 0.5 * 32767).astype("<i2").tobytes()
    w = b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(x)) + x
    rate, s = audio.wav(w)
    got = audio.windows(rate, s, 1.0)
    assert len(got) == 2 and got[0]["activity"] == "loud" and abs(got[0]["rms"] - 0.3535) < 1e-3 and abs(got[0]["zcr"] - 0.125) < 2e-3
    assert abs(got[0]["spectrum"][0] - 0.125) < 0.02
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"\0" * 65
    assert audio.id3(b"x" * 10 + tag) == {"title": "Song", "artist": "Who"}
    assert audio.voice_name("PTT-20260101-WA0007.opus") == {"kind": "PTT", "date": "20260101", "number": "0007"}


def test_video_and_pdf():
    box = lambda k, b: struct.pack(">I", 8 + len(b)) + k + b
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 12500) + b"\0" * 80)
    tkhd = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 480 << 16))
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + struct.pack(">I", 8) + b"avc1")
    mp4 = box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", tkhd + box(b"mdia", box(b"minf", box(b"stbl", stsd)))))
    assert video.describe(mp4) == {"duration": 12.5, "width": 640, "height": 480, "codecs": ["avc1"]}
    assert video.scenes(5, 10) == [(0.0, 2.5), (2.5, 5.0)]
    stream = zlib.compress(b"BT (Hello \\(w\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (x)] TJ <41> Tj ET")
    doc = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream endobj\n"
    assert pdf.pages("x", doc) == [(1, "[Page 1]\nHello (w)\nWorld xA")]
    with pytest.raises(ValueError):
        pdf.pages("x", b"no")


def test_scene_join_and_decode(spark):
    s = spark.createDataFrame([("v", 0, 0.0, 100.0), ("v", 1, 100.0, 200.0), ("w", 0, 0.0, 5.0)], "video string, scene int, start double, end double")
    t = spark.createDataFrame([("v", 10.0, 130.0, "both"), ("v", 150.0, 160.0, "late"), ("v", 100.0, 101.0, "edge")], "video string, start double, end double, text string")
    got = {(r.video, r.scene): r.transcript for r in video.transcript_by_scene(s, t).collect()}
    assert got == {("v", 0): "both", ("v", 1): "both edge late", ("w", 0): ""}
    from orbweaver.sources.formats import decode

    f = spark.createDataFrame([("a.py", b"def f(): pass"), ("b.py", b"def (")], "path string, content binary")
    rows = {r.path: r for r in decode(f, code.chunks).collect()}
    assert rows["a.py"].error is None and rows["b.py"]["index"] == -1 and "SyntaxError" in rows["b.py"].error


def test_mail_headers_are_parsed_once(monkeypatch):
    import email.headerregistry

    parsed, whole = [], email.headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(email.headerregistry.HeaderRegistry, "__call__", lambda self, name, value: parsed.append(name) or whole(self, name, value))
    raw = b"From: once@x.org\nSubject: once =?utf-8?q?=C3=A9?=\n folded\nContent-Type: text/plain; charset=utf-8; x=once\n\nbody"
    assert mail.message("m.eml", raw) == [(0, "[Email From: once@x.org | Subject: once \u00e9 folded]\nbody")]
    assert len(parsed) == len(set(parsed))
    long = b"From: a@b.c\nTo: " + b", ".join(b"u%d@x.org" % i for i in range(100)) + b"\n\nbody"
    assert mail.message("m.eml", long)[0][1].count("@x.org") == 100


@pytest.mark.parametrize("name", ["email_chunks", "masked_contacts", "pdf_pages"])
def test_decoders_of_parts_reach_every_core(spark, name):
    from orbweaver.plans import contents

    assert contents.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
