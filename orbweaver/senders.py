"""Senders of messages and tickets, as functions of a row that answer sent, failed or retry (see streaming.monitor.dispatch)."""

from __future__ import annotations

import hashlib
import http.client
import json
import ssl
from collections.abc import Callable
from typing import Any
from urllib.parse import urlsplit

from orbweaver.functions.crypto import sign
from orbweaver.operators.outbound import Blocked, pinned_address

#: Answers after which the same request may do better later; so may those from 500 on, and a network that fails.
LATER = frozenset({408, 425, 429})
Post = Callable[[str, dict[str, str], bytes], int]


def post(url: str, headers: dict[str, str], body: bytes, timeout: float = 15.0, **allow: Any) -> int:
    """The status of a POST to the address that was checked, under the host's own name; redirects are not followed."""
    u = urlsplit(url)
    address, port = pinned_address(url, **allow)
    if u.scheme == "https":
        connection: http.client.HTTPConnection = _Pinned(u.hostname, port, address, timeout)
    else:
        connection = http.client.HTTPConnection(address, port, timeout=timeout)
    try:
        connection.request("POST", (u.path or "/") + (f"?{u.query}" if u.query else ""), body, headers | {"Host": u.netloc.rpartition("@")[2]})
        return connection.getresponse().status
    finally:
        connection.close()


class _Pinned(http.client.HTTPSConnection):
    """TLS to a fixed address, with the certificate checked against the host's name."""

    def __init__(self, host: str, port: int, address: str, timeout: float) -> None:
        super().__init__(host, port, timeout=timeout, context=ssl.create_default_context())
        self.address = address

    def connect(self) -> None:
        raw = self._create_connection((self.address, self.port), self.timeout)
        self.sock = self._context.wrap_socket(raw, server_hostname=self.host)


def outcome(status: int) -> str:
    return "sent" if 200 <= status < 300 else "retry" if status >= 500 or status in LATER else "failed"


def dry_run(row: dict[str, Any]) -> str:
    """Sends nothing."""
    return "sent"


def reference(row: dict[str, Any]) -> str:
    """The reference that a dry run gives a ticket, the same each time."""
    return "DRY-" + hashlib.sha256(str(row["key"]).encode()).hexdigest()[:10].upper()


def webhook(url: str, secret: bytes, send: Post = post) -> Callable[[dict[str, Any]], str]:
    """A sender that posts rows as signed JSON, with their key so that the receiver knows a repeat."""

    def run(row: dict[str, Any]) -> str:
        body = json.dumps(row, sort_keys=True, default=str).encode()
        try:
            return outcome(send(url, {"Content-Type": "application/json", "Idempotency-Key": str(row.get("key", "")), "X-Signature": sign(body, secret)}, body))
        except (Blocked, ValueError):
            return "failed"
        except OSError:
            return "retry"

    return run


def by_channel(senders: dict[str, Callable[[dict[str, Any]], str]], channel: str = "channel") -> Callable[[dict[str, Any]], str]:
    """The sender of a row's channel; a channel without one is a dry run."""
    return lambda row: senders.get(row.get(channel, ""), dry_run)(row)
