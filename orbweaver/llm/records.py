"""Token ids in length-delimited binary records, with an offset index beside each file.

A record is framed as: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of
the payload (4), all little-endian. The payload is one document: its id (8 bytes, signed), the bytes
an id takes (1: 2 or 4), then the ids. The index holds (document id, offset of the record, number of
ids) as three 8-byte integers a record, so records can be read in any order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweaver.session import cut

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

LANE = 64
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])


# == checksums ==


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(the byte table of CRC-32C, the four byte tables that append LANE zero bytes)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0x82F63B78), t >> 1)
    zero = np.zeros((4, 256), np.uint32)
    for k in range(4):
        s = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(LANE):
            s = t[s & 0xFF] ^ s >> 8
        zero[k] = s
    return t, zero


def crc32c(items: list[bytes]) -> np.ndarray:
    """The CRC-32C of each item (4 bytes or more each), all at once.

    Items are padded in front to whole lanes; leading zeros leave a zero register as it is, and the
    usual start value is the same as flipping the first four bytes. Lanes are summed side by side,
    then folded from left to right for all items together.
    """
    table, zero = _tables()
    n = np.array([len(x) for x in items], np.int64)
    if not len(n):
        return np.zeros(0, np.uint32)
    if n.min() < 4:
        raise ValueError("items must have 4 bytes or more")
    lanes = -(-n // LANE)
    end = np.cumsum(lanes)
    flat = np.zeros(int(end[-1]) * LANE, np.uint8)
    first = end * LANE - n
    for x, a in zip(items, first.tolist(), strict=True):
        flat[a : a + len(x)] = np.frombuffer(x, np.uint8)
    for k in range(4):
        flat[first + k] ^= 0xFF
    data = np.ascontiguousarray(flat.reshape(-1, LANE).T)
    lane = np.zeros(data.shape[1], np.uint32)
    for row in data:
        lane = table[(lane ^ row) & 0xFF] ^ lane >> np.uint32(8)
    order = np.argsort(-lanes, kind="stable")  # longest first: those at work are a growing front part
    left, last = lanes[order], end[order]
    state, most = np.zeros(len(n), np.uint32), int(left[0])
    active = np.searchsorted(-left, -np.arange(most, 0, -1), side="right")
    for step, k in enumerate(active.tolist()):
        s = state[:k]
        s = zero[0, s & 0xFF] ^ zero[1, s >> 8 & 0xFF] ^ zero[2, s >> 16 & 0xFF] ^ zero[3, s >> 24]
        state[:k] = s ^ lane[last[:k] - (most - step)]
    out = np.empty(len(n), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums rotated and shifted, as they are stored."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


# == encoding ==


class _Generations:
    """A bounded memo: when the young half is full it becomes the old one; what is used again moves back."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def lacking(self, keys: set[str]) -> list[str]:
        """Which keys the memo lacks; the others are in the young half afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
        return out


class WordMemo:
    """A tokenizer file with bounded memos of the ids of space-led stretches and of pre-tokens.

    A space whose next character is a sure non-space always starts a pre-token, so a text may be cut
    there and the stretches encoded by themselves. A stretch that the memo lacks is cut into its
    pre-tokens, and only pre-tokens not seen lately go to the tokenizer, all of a batch together.
    """

    SAFE = re.compile(" (?=[!-~\u00a1-\u167f\u3041-\ud7ff])")
    UNSAFE = re.compile(" (?![!-~\u00a1-\u167f\u3041-\ud7ff])")

    def __init__(self, path: str, most: int = 400_000, special_as_text: bool = True) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.stretches, self.tokens = _Generations(most), _Generations(3 * most // 4)
        # Stretches of letters and a few marks are one or two pre-tokens. Where the tokenizer is byte-level
        # and changes nothing before that, these go to its merges without its look at the text.
        letters, marks = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+", r"[^\w\s']*"
        self.simple = re.compile(rf"( {letters})({marks})(?:(\n)({letters})({marks}))?")
        first = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and isinstance(first, pre_tokenizers.ByteLevel) and not first.add_prefix_space
        self.merges = self.tokenizer.model
        self.shown = {b: ord(x) for b, x in byte_letters().items()}

    def _merge(self, items: list[str]) -> list[bytes]:
        if not self.plain:
            return self._encode(items)
        merged, shown = self.merges.tokenize, self.shown
        return [np.array([t.id for t in merged(x.encode().decode("latin-1").translate(shown))], self.dtype).tobytes() for x in items]

    def _encode(self, items: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(items), 4096):
            found = self.tokenizer.encode_batch_fast(items[at : at + 4096], add_special_tokens=False)
            out += [np.array(x.ids, self.dtype).tobytes() for x in found]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian."""
        return whole_where(texts, self.special, self._encode, self._by_words)

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        cut = [[""] if not t else self.SAFE.split(t) if self.UNSAFE.search(t) else t.split(" ") for t in texts]
        need: set[str] = set()
        for p in cut:
            need.update(p[1:])
        fresh = self.stretches.lacking(need)
        words = {s: [x for x in m.groups() if x] for s in fresh if (m := self.simple.fullmatch(f" {s}"))}
        unseen = self.tokens.lacking({x for p in words.values() for x in p})
        self.tokens.young.update(zip(unseen, self._merge(unseen), strict=True))
        token = self.tokens.young.__getitem__
        known = self.stretches.young
        known.update((s, b"".join(map(token, p))) for s, p in words.items())
        others = [s for s in fresh if s not in words]
        known.update(zip(others, self._encode([f" {s}" for s in others]), strict=True))
        first = self._encode([p[0] for p in cut])
        return [f + b"".join(map(known.__getitem__, p[1:])) for f, p in zip(first, cut, strict=True)]


def whole_where(texts: list[str | None], special: list[str], whole, other) -> list[bytes]:
    """``other`` of all texts, but ``whole`` of those that hold one of the special strings."""
    marked = [i for i, t in enumerate(texts) if t and any(x in t for x in special)] if special else []
    if not marked:
        return other(texts)
    out = other([None if i in set(marked) else t for i, t in enumerate(texts)])
    for i, ids in zip(marked, whole([texts[i] for i in marked]), strict=True):
        out[i] = ids
    return out


class RankBpe:
    """A tokenizer file whose merges are read as ranks, which a faster library applies with the same result.

    Merging by pairs and merging by the rank of the joined token part ways only where two tokens meet that
    join to a token of another pair. Then that token's own bytes, merged by pairs, would stop at these two,
    so if every token's bytes merge to that token, and ids rise with the order of the merges, the results are
    equal. ``of`` checks that for the whole vocabulary and gives None where it does not hold.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer, ranks: dict[bytes, int], special_as_text: bool) -> None:
        import tiktoken

        self.tokenizer = tokenizer
        tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ordinary = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str, special_as_text: bool) -> RankBpe | None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = json.loads(tokenizer.to_str())
        model, first = kind["model"], kind["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or kind["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            return None
        letters = {x: b for b, x in byte_letters().items()}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        places = [vocab.get(a + b, -1) for a, b in merges]
        if len(vocab) != 256 + len(merges) or any(a >= b for a, b in zip(places, places[1:])) or any(x not in letters for t in vocab for x in t):  # noqa: B905
            return None
        merge = tokenizer.model.tokenize
        if min(places, default=256) < 256 or any(len(found := merge(t)) != 1 or found[0].id != i for t, i in vocab.items()):
            return None
        return cls(tokenizer, {bytes(letters[x] for x in t): i for t, i in vocab.items()}, special_as_text)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ranked(self, texts: list[str | None]) -> list[bytes]:
        kind, ordinary = ("H", "I")[self.dtype.itemsize // 4], self.ordinary
        out = [array(kind, ordinary(t) if t else ()) for t in texts]
        if sys.byteorder != "little":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian."""
        return whole_where(texts, self.special, self._whole, self._ranked)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for a byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def load_encoder(path: str, special_as_text: bool = True) -> RankBpe | WordMemo:
    """The encoder of a tokenizer file: by ranks where that is sure to be equal, else the library with a memo."""
    return RankBpe.of(path, special_as_text) or WordMemo(path, special_as_text=special_as_text)


# == files ==


def _frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", x) + p + struct.pack("<I", y) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def _names(path: str, shard: int) -> tuple[fs.FileSystem, str, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, f"{root}/shard-{shard:06d}.rec", f"{root}/shard-{shard:06d}.idx"


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """Encode every text and write the records in ascending id order; returns the manifest.

    The manifest has one row a shard: shard, records, tokens, bytes, start (ids of all shards before).
    Shard k holds smaller ids than shard k + 1. ``path`` must be one that executors can write
    (the shared folder). A shard is written under a name of its attempt and then renamed, so a task
    that runs again leaves one whole file. Null and empty texts give a record of ``end_id`` alone
    (of no ids, where that is None); a null id is stored as the smallest integer, before all others;
    repeated rows give a record each, in the order of their texts. Other columns are not read. Long texts
    are encoded whole; an empty table gives empty shards. The strings of special tokens in a text are
    ordinary text, or (``special_as_text`` false, the library's own default) those tokens.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest).cast("long")).alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        memo = load_encoder(tokenizer, special_as_text)
        tail = b"" if end_id is None else np.array([end_id], memo.dtype).tobytes()
        system, rec, idx = _names(path, shard)
        system.create_dir(os.path.dirname(rec), recursive=True)
        mark = f".{context.taskAttemptId()}.tmp"
        records = tokens = offset = 0
        with system.open_output_stream(rec + mark) as out, system.open_output_stream(idx + mark) as index:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = part.column(0).to_pylist()
                    coded = [x + tail for x in memo.encode(part.column(1).to_pylist())]
                    framed = _frame([struct.pack("<qB", i, memo.dtype.itemsize) + x for i, x in zip(ids, coded, strict=True)])
                    entry = np.zeros(len(ids), INDEX)
                    sizes = np.array([len(x) for x in framed], np.int64)
                    entry["doc_id"] = ids
                    entry["offset"] = offset + np.cumsum(sizes) - sizes
                    entry["n_tokens"] = [len(x) // memo.dtype.itemsize for x in coded]
                    out.write(b"".join(framed))
                    index.write(entry.tobytes())
                    records, tokens, offset = records + len(ids), tokens + int(entry["n_tokens"].sum()), offset + int(sizes.sum())
        system.move(rec + mark, rec)
        system.move(idx + mark, idx)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, records, tokens, offset)], ["shard", "records", "tokens", "bytes"])

    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    manifest = cut(ordered.mapInArrow(write, "shard long, records long, tokens long, bytes long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_shard(path: str, shard: int, rows: int = 256) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Blocks of (document id, ids before it in the shard, ids), every length and checksum verified."""
    system, rec, idx = _names(path, shard)
    with system.open_input_stream(idx) as f:
        index = np.frombuffer(f.read(), INDEX)
    local = np.cumsum(index["n_tokens"]) - index["n_tokens"]
    with system.open_input_file(rec) as f:
        for at in range(0, len(index), rows):
            part = index[at : at + rows]
            begin = int(part["offset"][0])
            end = int(index["offset"][at + rows]) if at + rows < len(index) else f.size()
            f.seek(begin)
            data = f.read(end - begin)
            heads, payloads, sums = [], [], []
            for k, offset in enumerate((part["offset"].astype(np.int64) - begin).tolist()):
                (size,) = struct.unpack_from("<Q", data, offset)
                stop = int(part["offset"][k + 1]) - begin if k + 1 < len(part) else len(data)
                if offset + 12 + size + 4 != stop:
                    raise ValueError(f"{rec}: the record at {begin + offset} does not end where the next begins")
                heads.append(data[offset : offset + 8])
                payloads.append(data[offset + 12 : offset + 12 + size])
                sums.append((struct.unpack_from("<I", data, offset + 8)[0], struct.unpack_from("<I", data, offset + 12 + size)[0]))
            want = np.array(sums, np.uint32)
            if (masked(crc32c(heads)) != want[:, 0]).any() or (masked(crc32c(payloads)) != want[:, 1]).any():
                raise ValueError(f"{rec}: a checksum is wrong")
            out = []
            for k, p in enumerate(payloads):
                doc, width = struct.unpack_from("<qB", p)
                ids = np.frombuffer(p, "<u2" if width == 2 else "<u4", offset=9)
                if doc != part["doc_id"][k] or len(ids) != part["n_tokens"][k]:
                    raise ValueError(f"{rec}: the index and the records differ")
                out.append((doc, int(local[at + k]), ids))
            yield out


def read_records(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """One row a record, read back from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all records before; ids_crc32 is over the ids as 32-bit integers.
    Every length and checksum is verified; a damaged file raises.
    """
    lowest = -(1 << 63)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in _read_shard(path, shard):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if d == lowest else d for d, _, _ in block], pa.int64()),
                            pa.array([start + a for _, a, _ in block], pa.int64()),
                            pa.array([len(ids) for _, _, ids in block], pa.int64()),
                            pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in block], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = manifest.filter("records > 0").select("shard", "start")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(path: str, shard: int, row: int) -> tuple[int, np.ndarray]:
    """One record by its place: (document id, ids)."""
    system, rec, idx = _names(path, shard)
    with system.open_input_file(idx) as f:
        f.seek(row * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    with system.open_input_file(rec) as f:
        f.seek(int(entry["offset"]))
        (size,) = struct.unpack("<Q", f.read(8))
        f.read(4)
        payload = f.read(size)
        (crc,) = struct.unpack("<I", f.read(4))
    if masked(crc32c([payload]))[0] != crc:
        raise ValueError(f"{rec}: a checksum is wrong")
    doc, width = struct.unpack_from("<qB", payload)
    return doc, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=9)
