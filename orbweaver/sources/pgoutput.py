"""Decoder of the logical replication stream of a PostgreSQL publication (protocol version 1)."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from decimal import Decimal, InvalidOperation
from typing import Any

EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
BOOL, JSON_TYPES, NUMERIC = {16}, {114, 3802}, {1700}
INTS, FLOATS = {20, 21, 23, 26}, {700, 701}


def convert(oid: int, text: str) -> Any:
    """A column's text as a value of its type; what does not fit stays text."""
    try:
        if oid in BOOL:
            return text == "t"
        if oid in INTS:
            return int(text)
        if oid in FLOATS:
            return float(text)
        if oid in NUMERIC:
            return Decimal(text)
        if oid in JSON_TYPES:
            return json.loads(text)
    except (ValueError, InvalidOperation):
        pass
    return text


@dataclass
class Relation:
    oid: int
    schema: str
    name: str
    columns: list[tuple[str, int, bool]]  # name, type, part of the key


@dataclass
class Transaction:
    """The changes between a begin and its commit, in order."""

    xid: int
    commit_lsn: int
    at: datetime
    events: list[dict[str, Any]] = field(default_factory=list)


class Reader:
    """Big-endian fields with bounds checked."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        n = size
        if len(self.data) < self.at + n:
            raise ValueError("the message ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.take(struct.calcsize(code)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("a text has no end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


class Decoder:
    """feed() takes messages one by one and returns a transaction when it commits."""

    def __init__(self) -> None:
        self.relations: dict[int, Relation] = {}
        self.open: Transaction | None = None

    def feed(self, message: bytes) -> Transaction | None:
        r = Reader(message)
        kind = r.take(1).decode("latin-1")
        if kind == "B":
            lsn, micros, xid = r.number("Q"), r.number("q"), r.number("I")
            self.open = Transaction(xid, lsn, EPOCH + timedelta(microseconds=micros))
        elif kind == "C":
            done, self.open = self.open, None
            return done
        elif kind == "R":
            oid, schema, name, _ = r.number("I"), r.text(), r.text(), r.take(1)
            columns = []
            for _ in range(r.number("H")):
                key, column, type_, _mod = r.number("B"), r.text(), r.number("I"), r.number("i")
                columns.append((column, type_, bool(key & 1)))
            self.relations[oid] = Relation(oid, schema, name, columns)
        elif kind in "IUD":
            self._change(kind, r)
        elif kind == "T":
            n, _ = r.number("I"), r.number("B")
            for oid in [r.number("I") for _ in range(n)]:
                self._add(self.relations[oid], "TRUNCATE", "*", {})
        elif kind not in "OYM":
            raise ValueError(f"a message of kind {kind!r} is not of version 1")
        return None

    def _tuple(self, r: Reader, rel: Relation) -> tuple[dict[str, Any], bool]:
        row, whole = {}, True
        for i in range(r.number("H")):
            name, oid, _ = rel.columns[i]
            kind = r.take(1)
            if kind == b"n":
                row[name] = None
            elif kind == b"u":
                whole = False  # a large value that did not change is not sent
            else:
                row[name] = convert(oid, r.take(r.number("I")).decode())
        return row, whole

    def _change(self, kind: str, r: Reader) -> None:
        rel = self.relations[r.number("I")]
        old: dict[str, Any] | None = None
        tag = r.take(1)
        if tag in (b"K", b"O"):
            old, _ = self._tuple(r, rel)
            tag = r.take(1) if kind == "U" else b""
        if kind == "D":
            self._add(rel, "DELETE", self._key(rel, old or {}), old or {})
            return
        row, whole = self._tuple(r, rel)
        key = self._key(rel, row)
        before = self._key(rel, old) if old is not None else key
        if kind == "U" and before != key:
            self._add(rel, "DELETE", before, old or {})
            self._add(rel, "INSERT", key, row, not whole)
        else:
            self._add(rel, "INSERT" if kind == "I" else "UPDATE", key, row, not whole)

    @staticmethod
    def _key(rel: Relation, row: dict[str, Any]) -> str:
        names = [c for c, _, key in rel.columns if key] or [c for c, _, _ in rel.columns]
        return "|".join(str(row.get(c)) for c in names)

    def _add(self, rel: Relation, operation: str, key: str, record: dict[str, Any], partial: bool = False) -> None:
        if self.open is None:
            raise ValueError("a change stands outside a transaction")
        self.open.events.append({"operation": operation, "schema": rel.schema, "table": rel.name, "key": key, "record": record, "partial": partial})
