"""E-mail messages and chat exports."""

from __future__ import annotations

import email
import email.headerregistry
import email.policy
import functools
import html
import io
import json
import re
import zipfile
from datetime import UTC, datetime
from typing import Any

from orbweaver.operators.chunking import pack
from orbweaver.sources.formats.office import html_to_text

NOISE = {"channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "bot_add", "bot_remove", "pinned_item"}


class _Registry(email.headerregistry.HeaderRegistry):
    """The library's headers, but no class is made anew a header, and short ones are parsed once and not at every look."""

    @functools.lru_cache(maxsize=256)  # noqa: B019  one registry a process
    def __getitem__(self, name: str) -> type:
        return super().__getitem__(name)

    def __call__(self, name: str, value: str) -> Any:
        return self._short(name, value) if len(value) <= 1000 else super().__call__(name, value)

    @functools.lru_cache(maxsize=256)  # noqa: B019
    def _short(self, name: str, value: str) -> Any:
        return super().__call__(name, value)


_POLICY = email.policy.default.clone(header_factory=_Registry())


def _bodies(message) -> list[str]:
    kind = message.get_content_type()
    if message.is_multipart():
        parts = list(message.iter_parts())
        if kind == "multipart/alternative":
            plain = [p for p in parts if p.get_content_type() == "text/plain"]
            parts = plain or parts[-1:]
        return [b for p in parts for b in _bodies(p)]
    if message.get_content_disposition() == "attachment":
        return [f"[Attachment: {message.get_filename() or kind}]"]
    if kind == "text/plain":
        return [message.get_content()]
    if kind == "text/html":
        return [html_to_text(message.get_content())]
    if kind == "text/calendar":
        found = re.findall(r"^(SUMMARY|DTSTART|DTEND|LOCATION)[^:\n]*:(.*)$", message.get_content(), re.M)
        return ["[Event] " + " | ".join(k.title() + ": " + v.strip() for k, v in found)]
    return []


def message(path: str, data: bytes, size: int = 3000) -> list[tuple[int, str]]:
    """Chunks of a message, each under its sender, subject and date; quoted lines are kept as quotes."""
    m = email.message_from_bytes(data, policy=_POLICY)
    head = " | ".join(f"{k}: {v}" for k in ("From", "To", "Date", "Subject") if (v := m[k]))
    lines = [line for b in _bodies(m) for line in b.splitlines()]
    cut = [line[i : i + size - 500] for line in lines for i in range(0, max(1, len(line)), size - 500)]
    return list(enumerate(pack(cut, f"[Email {head}]", size)))


def slack_text(text: str, users: dict) -> str:
    """A message's text with mentions, channels, links and entities resolved."""
    text = re.sub(r"<@(\w+)(?:[|]([^>]*))?>", lambda m: "@" + (m[2] or users.get(m[1], m[1])), text)
    text = re.sub(r"<#[A-Z0-9]+\|([^>]*)>", r"#\1", text)
    text = re.sub(r"<!(\w+)[^>]*>", r"@\1", text)
    text = re.sub(r"<((?:https?|mailto):[^|>]+)\|([^>]*)>", r"\2 (\1)", text)
    return html.unescape(re.sub(r"<((?:https?|mailto):[^>]+)>", r"\1", text))


def speaker(m: dict[str, Any], users: dict) -> str:
    profile = m.get("user_profile") or {}
    names = users.get(m.get("user", "")), *map(profile.get, ("display_name", "real_name")), m.get("username"), m.get("user")
    return next(filter(None, names), "unknown")


def _slack_messages(data: bytes) -> tuple[dict[str, str], list[tuple[str, dict]]]:
    users, found = {}, []
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if "users.json" in z.namelist():
                users = {u["id"]: (u.get("profile") or {}).get("display_name") or next(filter(None, map(u.get, ("real_name", "name", "id")))) for u in json.loads(z.read("users.json"))}
            for n in sorted(z.namelist()):
                if re.fullmatch(r"[^/]+/\d{4}-\d\d-\d\d\.json", n):
                    found += [(n.split("/")[0], m) for m in json.loads(z.read(n))]
    else:
        body = json.loads(data)
        found = [(m.get("channel", "chat"), m) for m in (body if isinstance(body, list) else body.get("messages", []))]
    return users, [(c, m) for c, m in found if m.get("subtype") not in NOISE and m.get("text")]


def slack(path: str, data: bytes, size: int = 1500) -> list[tuple[int, str]]:
    """Threads as one chunk each, other messages by channel and day, packed to ``size`` characters."""
    users, found = _slack_messages(data)
    threads: dict[tuple[str, str], list[dict]] = {}
    days: dict[tuple[str, str], list[str]] = {}
    replied = {(c, m["thread_ts"]) for c, m in found if m.get("thread_ts") and m["thread_ts"] != m.get("ts")}
    for c, m in sorted(found, key=lambda x: (x[0], float(x[1].get("ts") or 0))):
        key = (c, m.get("thread_ts") or m.get("ts") or "")
        if key in replied:
            threads.setdefault(key, []).append(m)
        else:
            t = datetime.fromtimestamp(float(m.get("ts") or 0), UTC)
            days.setdefault((c, f"{t:%Y-%m-%d}"), []).append(f"{t:%H:%M} {speaker(m, users)}: {slack_text(m['text'], users)}")
    out = []
    for (c, _), ms in threads.items():
        out.append(f"[Thread in #{c}]\n" + "\n".join(f"{speaker(m, users)}: {slack_text(m['text'], users)}" for m in ms))
    for (c, day), lines in days.items():
        out += pack(lines, f"[#{c} {day}]", size)
    return list(enumerate(out))
