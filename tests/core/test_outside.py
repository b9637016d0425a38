"""Senders, the HTTP adapter and diagrams in slides."""

import io
import json
import threading
import urllib.error
import urllib.request
import zipfile

from orbweaver import senders, web
from orbweaver.functions import crypto
from orbweaver.operators import service
from orbweaver.sources.formats import office


def test_webhook_outcomes():
    seen = []

    def answer(status):
        def send(url, headers, body):
            seen.append((headers, body))
            if isinstance(status, Exception):
                raise status
            return status

        return senders.webhook("https://h.example/x", b"k", send)({"key": "a", "n": 1})

    assert [answer(s) for s in (200, 204, 302, 404, 408, 429, 500, 503)] == ["sent", "sent", "failed", "failed", "retry", "retry", "retry", "retry"]
    assert answer(OSError()) == "retry" and answer(senders.Blocked("no")) == "failed"
    headers, body = seen[0]
    assert json.loads(body) == {"key": "a", "n": 1} and headers["Idempotency-Key"] == "a" and crypto.verify(body, headers["X-Signature"], b"k")
    send = senders.by_channel({"sms": lambda row: "failed"})
    assert send({"channel": "sms"}) == "failed" and send({"channel": "fax"}) == "sent"
    assert senders.reference({"key": "a"}) == senders.reference({"key": "a"}) != senders.reference({"key": "b"})


def test_post_is_pinned_and_checked():
    assert senders.webhook("https://127.0.0.1/x", b"k")({"key": 1}) == "failed"  # a loopback address is not called
    assert senders.webhook("http://h.example/x", b"k")({"key": 1}) == "failed"


def test_http_adapter():
    s = service.Service(service.fixed_gateway("yes"), {"web": {"capabilities": ["ask", "session"]}}, "t")
    keys = [{"secret": "k", "user": "ann", "tenant": "t", "permissions": ["ask", "session"]}]
    server = web.server(s, keys, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, key="k"):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), {"X-API-Key": key})
        try:
            with urllib.request.urlopen(r, timeout=10) as got:
                return got.status, json.load(got)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/health") == (200, {"status": "ok", "tenant": "t", "channels": ["web"]})
        session = call("/v1/sessions", {})[1]["session"]
        assert call("/v1/ask", {"query": "q", "session": session})[1]["answer"] == "yes"
        assert [call(*x)[0] for x in (("/v1/ask", {"query": "q"}, "no"), ("/v1/ask", {}), ("/v1/ask", {"query": "q", "channel": "fax"}), ("/odd", {}), ("/odd",), ("/v1/ask", {"query": "q", "session": "no"}))] == [403, 400, 400, 404, 404, 400]
    finally:
        server.shutdown()
        server.server_close()


def test_diagrams_in_slides():
    a = 'xmlns:a="a" xmlns:p="p"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {a}><p:sp><p:ph type="title"/><a:p><a:t>Plan</a:t></a:p></p:sp></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Target="../diagrams/data1.xml"/><Relationship Target="../media/x.png"/></Relationships>')
        z.writestr("ppt/diagrams/data1.xml", f"<d {a}><a:p><a:t>Step one</a:t></a:p><a:p><a:t>Step two</a:t></a:p></d>")
    assert office.slides("f.pptx", b.getvalue()) == [(1, "[Slide 1] Plan\nStep one\nStep two")]
