"""The question service over HTTP: GET /health, POST /v1/sessions, POST /v1/ask."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from orbweaver.operators import service

MAX_BODY = 1 << 20


def server(s: service.Service, keys: list[dict], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server to run with serve_forever(); callers give their key as X-API-Key while auth is on."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict[str, Any]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self._answer(200, s.status())
            else:
                self._answer(404, {"error": "no such path"})

        def do_POST(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MAX_BODY:
                    return self._answer(413, {"error": "the body is too large"})
                body = json.loads(self.rfile.read(size) or b"{}")
                who = service.principal_of(keys, self.headers.get("X-API-Key")) if s.auth else service.anonymous(s.tenant, s.auth)
                if self.path == "/v1/sessions":
                    self._answer(200, {"session": s.start_session(who, body.get("channel", "web"))})
                elif self.path == "/v1/ask":
                    self._answer(200, s.ask(who, str(body["query"]), body.get("channel", "web"), body.get("session")))
                else:
                    self._answer(404, {"error": "no such path"})
            except service.Refused as e:
                self._answer(403, {"error": str(e)})
            except (KeyError, ValueError) as e:
                self._answer(400, {"error": str(e)})

        def log_message(self, *args: Any) -> None:
            """Requests are not written to the error stream."""

    return ThreadingHTTPServer((host, port), Handler)
