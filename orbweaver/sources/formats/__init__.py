"""Decoders of document formats: each turns bytes or text into rows, and runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def decode(files: DataFrame, f: Callable[[str, bytes], list[tuple[int, str]]]) -> DataFrame:
    """(path, index, text, error) of binary files (path, content) by a decoder of (path, bytes).

    A file that can't be decoded gives one row with its error, so one bad file stops no job. Files are
    independent and nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, t, None) for i, t in f(path, bytes(data or b""))]
                except Exception as e:  # whatever a broken file makes a decoder raise
                    rows.append((path, -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "index", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, index int, text string, error string")
