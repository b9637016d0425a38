"""SQLite files: a chunk of each table's definition and its rows as text."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"SQLite format 3\0"


def valid(data: bytes) -> bool:
    """Whether bytes begin as an SQLite file with a possible page size."""
    if len(data) < 100 or data[:16] != MAGIC:
        return False
    size = struct.unpack(">H", data[16:18])[0]
    return size == 1 or (512 <= size <= 32768 and size & (size - 1) == 0)


def chunks(data: bytes, most: int = 500) -> Iterator[tuple[str, str, int, str]]:
    """(table, kind, index, text): the definition of every table and view, and up to ``most`` rows of tables."""
    if not valid(data):
        raise ValueError("no SQLite file")
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        for kind, name, sql in db.execute("SELECT type, name, sql FROM sqlite_master WHERE name NOT LIKE 'sqlite_%' AND type IN ('view', 'table') ORDER BY type, name").fetchall():
            quoted = '"{}"'.format('""'.join(name.split('"')))
            info = db.execute(f"PRAGMA table_info({quoted})").fetchall()
            yield name, "schema", 0, f"[Schema: {name}] {sql}"
            if kind == "view":
                continue
            keys = [c[1] for c in sorted(info, key=lambda c: c[5]) if c[5]]
            cursor = db.execute(f"SELECT * FROM {quoted} LIMIT {int(most)}")
            names = [c[0] for c in cursor.description]
            for i, row in enumerate(cursor, 1):
                values = {n: "NULL" if v is None else f"<Binary:{len(v)}B>" if isinstance(v, bytes) else str(v) for n, v in zip(names, row, strict=True)}
                pk = "-".join(values[k] for k in keys) or str(i)
                yield name, "row", i, f"[Table: {name} | PK: {pk}] " + " | ".join(f"{n}: {v}" for n, v in values.items())
    finally:
        db.close()


def read(files: DataFrame, most: int = 500) -> DataFrame:
    """(path, table, kind, index, text) of binary files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, *c) for c in chunks(bytes(data), most)]
                yield pd.DataFrame(rows, columns=["path", "table", "kind", "index", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, table string, kind string, index int, text string")
