"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is read in overlapping chunks. Each chunk is pre-tokenised by itself, from a place that
need not be a pre-token boundary. Going left to right, the boundaries of one chunk, known to be
those of the whole text, are compared with those of the next in their overlap: the pattern never
looks back, so from the first boundary they share the next chunk's are those of the whole text too.
There the text is cut, and the pieces are encoded by themselves. A cut never follows white space,
which at the end of a piece would match otherwise than before more text. Where no such boundary is
shared (a run longer than the overlap) the left chunk reads on until one is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A match this near the end of a chunk may be another one when more text follows ('re, 've, 'll).
LOOKAHEAD = 3


class ChunkedBpe:
    """A rank file and its pattern, with chunked encoding and concatenating decoding."""

    def __init__(self, path: str, pattern: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> None:
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be positive and smaller than a chunk")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap

    def bounds(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of the pre-tokens of no white space met when reading from ``start``; near ``stop`` only sure ones."""
        sure = stop if stop >= len(text) else stop - LOOKAHEAD - 1
        return [e for m in self.pattern.finditer(text, start, stop) if (e := m.end()) <= sure and not text[e - 1].isspace()]

    def pieces(self, text: str) -> list[str]:
        """The text, cut at pre-token boundaries about a chunk apart."""
        n, cuts, at = len(text), [0], self.chunk
        while at < n:
            width, stop = self.overlap, min(n, at + self.overlap)
            left = self.bounds(text, cuts[-1], stop)
            right = set(self.bounds(text, max(cuts[-1], at - width), stop))
            shared = next((x for x in left if x >= at - width and x in right), None)
            while shared is None and stop < n:  # a run longer than the overlap: read on
                width *= 4
                stop = min(n, at + width)
                left = self.bounds(text, left[-1] if left else cuts[-1], stop)
                right = set(self.bounds(text, at, stop))
                shared = next((x for x in left if x in right), None)
            if shared is None or shared >= n:
                break
            cuts.append(shared)
            at = max(at, shared) + self.chunk
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, as encoding it at once would give; none for null."""
        if not text:
            return []
        if len(text) <= self.chunk:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, joined."""
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def load_bpe(path: str, pattern: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> ChunkedBpe:
    """One table a worker, not one a batch."""
    return ChunkedBpe(path, pattern, chunk, overlap)


def _fields(df: DataFrame, id_col: str, value: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(value).alias("value"))


def _slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(id_col, ids array<int>) for each row; a null or empty text has no ids.

    Rows are independent: nothing is shuffled, repeated rows stay, and other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path, pattern, chunk, overlap)
        for batch in batches:
            for part in _slices(batch):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return _fields(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data binary): the decoded bytes of each row; a null list decodes to none."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                data = [bpe.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return _fields(tokens, id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """Encode and decode every text in one pass: (id_col, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the decoded bytes. Null and
    empty texts have no ids and the digests of nothing; texts beyond a chunk are read chunk by chunk;
    repeated rows and null ids stay; an empty table has no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path, pattern, chunk, overlap)
        for batch in batches:
            count, sha, back = [], [], []
            for part in _slices(batch):
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text)
                    count.append(len(ids))
                    sha.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(count, np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _fields(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
