"""Operators that SQL can't express: services, addresses, providers, replication, feeds in Avro, office files."""

import io
import json
import struct
import zipfile

import pytest

from orbweaver import jobs, providers
from orbweaver.operators import chunking, intents, outbound, service, telemetry
from orbweaver.sources import pgoutput, replication
from orbweaver.sources.formats import office, pdf
from orbweaver.streaming import kafka

CHANNELS = {"web": {"capabilities": ["ask", "session"]}, "off": {"enabled": False}}
KEYS = [{"secret": "env:K", "user": "ann", "tenant": "t", "permissions": ["ask", "session"]}, {"secret": "plain", "user": "bo", "tenant": "u"}]


def test_service_admits_and_keeps_sessions():
    s = service.Service(service.fixed_gateway("yes"), CHANNELS, "t", most_chars=10, keep=3)
    ann = service.principal_of(KEYS, "key", {"K": "key"})
    assert s.status() == {"status": "ok", "tenant": "t", "channels": ["web"]}
    session = s.start_session(ann, "web")
    for _ in range(2):
        assert s.ask(ann, "why", "web", session)["answer"] == "yes"
    assert [m[0] for m in s.sessions[session]["messages"]] == ["assistant", "user", "assistant"]
    bo = service.principal_of(KEYS, "plain", {"K": "key"})
    for who, what, error in ((bo, ("why", "web"), "tenant"), (ann, ("w" * 11, "web"), "characters")):
        with pytest.raises(service.Refused, match=error):
            s.ask(who, *what)
    with pytest.raises(ValueError, match="disabled"):
        s.ask(ann, "why", "off")
    with pytest.raises(service.Refused, match="session"):
        s.ask(service.Principal("eve", "t", permissions=("ask",)), "why", "web", session)
    for presented in (None, "other"):
        with pytest.raises(service.Refused):
            service.principal_of(KEYS, presented, {"K": "key"})
    with pytest.raises(service.Refused, match="not set"):
        service.principal_of(KEYS, "key", {})
    assert service.anonymous("t", False).permissions == ()
    with pytest.raises(service.Refused):
        service.anonymous("t", True)


@pytest.mark.parametrize("address", ["127.0.0.1", "::1", "169.254.169.254", "10.1.2.3", "::ffff:10.0.0.1", "64:ff9b::7f00:1", "fe80::1%eth0", "100.64.0.1", "224.0.0.1", "fd00::1", "2002:7f00:1::"])
def test_addresses_that_are_blocked(address):
    with pytest.raises(outbound.Blocked):
        outbound.check_address(address)


def test_urls_are_pinned():
    assert outbound.pinned_address("https://a.example/x", lambda h, p: ["8.8.8.8", "8.8.4.4"]) == ("8.8.8.8", 443)
    with pytest.raises(outbound.Blocked):
        outbound.pinned_address("https://a.example", lambda h, p: ["8.8.8.8", "10.0.0.1"])
    assert outbound.pinned_address("https://in.example:8443", lambda h, p: ["10.0.0.1"], hosts=["IN.example"]) == ("10.0.0.1", 8443)
    assert outbound.pinned_address("http://here", lambda h, p: ["127.0.0.1"], loopback=True) == ("127.0.0.1", 80)
    for bad in ("http://a.example", "ftp://a", "https://"):
        with pytest.raises(ValueError):
            outbound.pinned_address(bad, lambda h, p: ["8.8.8.8"])


def test_exporters():
    e = {"a": {"type": "prometheus", "enabled": True, "endpoint": "x"}, "b": {"type": "odd", "enabled": True, "api_key_env": "NO"}, "c": {"type": "splunk", "enabled": False}}
    assert len(telemetry.exporter_issues(e, {})) == 3 and telemetry.exporter_issues({"a": e["a"]}, {}) == []
    assert telemetry.enabled(e) == ["a", "b"]


def test_unknown_severity(spark):
    df = spark.createDataFrame([("s", "loud", "m")], "service string, severity string, message string")
    with pytest.raises(Exception, match="no severity: loud"):
        telemetry.log_rows(df).collect()


def zigzag(n):
    n, out = n << 1 ^ n >> 63, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_registry_avro(spark):
    schema = {"type": "record", "name": "R", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "l", "type": {"type": "array", "items": "double"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "next", "type": ["null", "R"]}]}
    one = lambda i, s: zigzag(i) + (zigzag(0) if s is None else zigzag(1) + zigzag(len(s)) + s.encode()) + zigzag(-1) + zigzag(8) + struct.pack("<d", 0.5) + zigzag(0) + zigzag(1) + zigzag(1) + b"k\1" + zigzag(0) + zigzag(1)
    data = one(-3, "hé") if False else one(-3, "he") + zigzag(1) + one(70000, None) + zigzag(0)
    want = {"id": -3, "s": "he", "l": [0.5], "m": {"k": True}, "e": "B", "next": {"id": 70000, "s": None, "l": [0.5], "m": {"k": True}, "e": "B", "next": None}}
    assert kafka.AvroReader(schema).read(data) == want
    with pytest.raises(ValueError, match="early"):
        kafka.AvroReader(schema).read(data[:-1])
    df = spark.createDataFrame([(b"\0" + (7).to_bytes(4, "big") + data,), (b"plain",), (None,)], "value binary")
    schemas = {7: json.dumps(schema)}
    got = [r[0] for r in df.select(kafka.registry_avro(df.value, lambda n: schemas[n])).collect()]
    assert json.loads(got[0]) == want and got[1:] == ["plain", None]


def test_prerequisites():
    good = {"wal": [("logical",)], "roles": [(True,)], "pg_publication WHERE": [(1,)], "tables": []}
    ask = lambda answers: lambda sql, *args: next(v for k, v in answers.items() if k in sql)
    assert replication.prerequisite_problems(ask(good), "p") == []
    bad = {"wal": [("replica",)], "roles": [(False,)], "pg_publication WHERE": [(0,)]}
    assert len(replication.prerequisite_problems(ask(bad), "p")) == 3
    assert "a.b, a.c" in replication.prerequisite_problems(ask(good | {"tables": [("a", "b"), ("a", "c")]}), "p")[0]
    assert replication.snapshot_sql("s", 't"x', ["a", "b"], "a > 1", 5) == 'SELECT "a", "b" FROM "s"."t""x" WHERE a > 1 LIMIT 5'


def test_transactions_are_confirmed_after_they_are_applied():
    begin = b"B" + struct.pack(">QqI", 9, 0, 1)
    relation = b"R" + struct.pack(">I", 5) + b"s\0t\0d" + struct.pack(">H", 1) + b"\1id\0" + struct.pack(">Ii", 23, -1)
    insert = b"I" + struct.pack(">I", 5) + b"N" + struct.pack(">H", 1) + b"t" + struct.pack(">I", 1) + b"7"
    commit = b"C" + struct.pack(">BQQq", 0, 1, 2, 0)
    sent = []
    s = replication.TransactionStream([(1, begin), (2, relation), (3, insert), None, (4, commit), (5, begin), (6, commit)], sent.append)
    got = list(s.transactions())
    assert got[0] is None and [p for p, _ in got[1:]] == [4, 6]
    assert replication.transaction_rows(*got[1]) == [(4, 0, "INSERT", "s", "t", "7", {"id": 7})]
    s.keepalive()
    s.confirm(4)
    s.confirm(4)
    s.keepalive()
    assert sent == [0, 4, 4] and s.waiting == [6]
    with pytest.raises(ValueError):
        s.confirm(99)
    assert isinstance(got[1][1], pgoutput.Transaction)


def test_marks_and_batches(spark, tmp_path):
    marks = jobs.Marks(str(tmp_path / "marks"))
    assert marks.read("a") is None
    with pytest.raises(ValueError):
        marks.read("../a")
    rows = [(1, "x", "2026-01-01 00:00:00"), (2, None, "2026-01-02 00:00:00"), (1, "again", "2026-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "id long, v string, t string").selectExpr("id", "v", "cast(t as timestamp) as t")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    run = lambda d: jobs.run_batch(spark, "a", d, marks, ["id", "v"], "id", "t", "t", good, bad)
    assert run(df) == run(df) == "2026-01-03T00:00:00" == marks.read("a")  # the second run finds nothing new
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(bad).count() == 1


def test_job_settings():
    j = jobs.Job("j", "id")
    assert jobs.hydrated(j).chunking == (80, 12) and jobs.hydrated(jobs.Job("j", "id", chunking=(5, 1))).chunking == (5, 1)
    with pytest.raises(ValueError):
        jobs.documents_job(None, j)
    with pytest.raises(ValueError):
        jobs.Collection("c")


def test_providers(spark):
    df = spark.createDataFrame([(1, b"a", "", "q", "t"), (2, b"bc", "given", None, "t"), (3, None, None, "q", "tt")], "id int, content binary, given_text string, query string, text string")
    got = {r.id: (r.text, r.method) for r in providers.described(df.drop("text"), lambda: lambda xs: [f"{len(x)} bytes" for x in xs], "o").collect()}
    assert got == {1: ("1 bytes", "model"), 2: ("given", "given"), 3: (None, "none")}
    seg = providers.transcribed(df.select("id", "content"), lambda: lambda xs: [[(0.0, 1.0, "a"), (1.0, 2.0, "b")] for _ in xs], "s").collect()
    assert sorted((r.id, r.segment, r.text) for r in seg) == [(i, k, t) for i in (1, 2) for k, t in enumerate("ab")]
    ranked = {r.id: r.rerank_score for r in providers.reranked(df, lambda: lambda ps: [len(t) - 1 for _, t in ps]).collect()}
    assert ranked[1] == 0.5 and ranked[2] is None and 0.7 < ranked[3] < 0.74
    with pytest.raises(Exception, match="gave 0 results"):
        df.select(providers.applied("none", lambda: lambda xs: [], df.text, "string")).collect()
    for args in (("hashing", 0), ("other", 3), ("local", 3)):
        with pytest.raises(ValueError):
            providers.embedder(*args)
    e = providers.embedder("local", 2, lambda: lambda xs: [[1.0, float(len(x))] for x in xs])
    assert [r[0] for r in df.orderBy("id").select(e(df.text)).collect()] == [[1.0, 1.0], [1.0, 1.0], [1.0, 2.0]]
    post = lambda url, headers, body: {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
    assert providers.hosted_embedder("https://e.example/v1", "k", "m", post)(["a", "bcd"]) == [[1.0], [3.0]]
    assert providers.loaded("x", lambda: 5) == 5 and providers.release("x") and not providers.release("x")


def test_model_answers(spark):
    df = spark.createDataFrame([("pay 9876543210", "a", 0.4, True), ("sure", "a", 0.9, False), ("odd", "a", 0.3, True), ("boom", "a", 0.3, True)], "text string, intent string, confidence double, needs_review boolean")

    def ask(t):
        if t == "boom":
            raise OSError
        return {"intent": "b" if "[phone]" in t else "unknown", "confidence": 2}

    got = {r.text: (r.intent, r.confidence, r.method, r.needs_review) for r in intents.model_answers(df, ask, ["a", "b"]).collect()}
    assert got == {"pay 9876543210": ("b", 0.85, "model", False), "sure": ("a", 0.9, "rules", False), "odd": ("a", 0.3, "rules", True), "boom": ("a", 0.3, "rules", True)}


def test_evaluate_folds(spark):
    rows = [(f"i will pay {w} tomorrow", "pay") for w in "a b c d e f g h".split()] + [(f"please stop calling {w} now", "stop") for w in "a b c d e f g h".split()]
    df = spark.createDataFrame([*rows, ("", "pay"), (None, "pay"), ("x", None)], "text string, label string")
    confusion = intents.evaluate_folds(df)
    assert tuple(intents.accuracy(confusion).first()) == (16, 1.0)
    assert intents.evaluate_folds(df.limit(4)).count() == 0


def test_sections_and_old_workbooks():
    items = [("A", "heading", "A"), ("A", "paragraph", "one"), ("A", "list_item", "two"), ("A", "table", "| t |"), ("B", "heading", "B"), ("C", "heading", "C"), ("C", "paragraph", "x" * 9), ("C", "paragraph", "y" * 9)]
    assert office.grouped_sections(items, "f", 12) == [
        ("A", "[Document: f | Section: A]\nA\none\ntwo"), ("A", "| t |"), ("B", "B"), ("C", "[Document: f | Section: C]\nC\n" + "x" * 9), ("C", "[Document: f | Section: C]\n" + "y" * 9),
    ]
    data = b"\xd0\xcf\x11\xe0Workbook\0Alpha\x01Beta\x02_skip\x03" + "Gamma".encode("utf-16-le") + b"\x01\x02Delta\0Eps\0Zeta\0"
    rows = office.legacy_workbook("d/f.xls", data)
    assert rows[0][1].startswith("[Workbook: f.xls | Sheet: Sheet1 | Row 1] Col_1: Alpha | Col_2: Beta | Col_3: Delta") and "Gamma" in rows[1][1] + rows[0][1]


def test_pictures():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/media/image1.png", b"12345")
        z.writestr("word/document.xml", "<x/>")
    assert office.image_texts(b.getvalue()) == ["[Image: image1.png] 5 bytes"]
    assert office.image_texts(b.getvalue(), lambda x: " read ") == ["[Image: image1.png] read"]
    body = b"%PDF-1.4\n1 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nstream\n\xff\xd8\xffabc\nendstream\nendobj\n2 0 obj\n<< >>\nendobj\n"
    assert pdf.images(body) == [(1, "jpeg", b"\xff\xd8\xffabc")]


def test_flattened():
    many = {"a": [{"b": i} for i in range(12)], "c": {}, "d": {"e": None}, "f": [], "g": [1, {"h": 2}]}
    flat = chunking.flattened(many)
    assert len([k for k in flat if k.startswith("a[")]) == 10 and flat["a._truncated"] == "2 more items"
    assert flat["c"] == {} and flat["d.e"] is None and flat["f"] == "[]" and json.loads(flat["g"]) == [1, {"h": 2}]
    assert chunking.document_narrative('{"_id": {"$oid": "5f"}, "n": {"$numberLong": "7"}, "t": "a\\nb"}', "c") == "[Collection: c | ID: 5f] n: 7 | t: a b"
    assert chunking.document_narrative('{"id": 1, "n": 2}', "c", flat=False) == '[Collection: c | ID: 1] {"id": 1, "n": 2}'
    assert chunking.document_narrative("nope", "c") is None and chunking.document_narrative(None, "c") is None
