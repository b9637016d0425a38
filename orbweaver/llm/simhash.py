"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits), each read as a word of the
perfect [23,12,7] Golay code. Every word decodes to one codeword index, and the words next to it
decode to at most six, so a segment that differs in one bit shares an index with its partner.
With at most three differing bits over three segments, two segments always carry (0,0), (0,1) or
(1,1) errors; the families of keys below cover each case:

* segments 1 and 2, both fuzzy (any (<=1, <=1));
* segment 3 exact with 1 or 2 fuzzy, and segment 3 fuzzy with 1 or 2 exact (the (0, <=1) cases).

Fingerprints that share a key meet in one bucket, where their true distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.llm.components import components
from orbweaver.session import cut

GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
WIDTHS = (22, 21, 21)
#: The segment that the keys of each family say nothing of.
LEFT_OUT = (2, 1, 1, 0, 0)
SEED = 42


# == fingerprints ==


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; zero where it has no word (or is null).

    A bit is 1 if it is set in over half the XXH64 hashes of the word shingles. Fewer words than
    ``shingle`` make one shingle of them all.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = [0, *ends[: len(words) - shingle].tolist()]
        last = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    ones, n = np.zeros(64, np.int64), len(hashes)
    h = np.array(hashes, np.uint64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of each text, as a signed long with the same 64 bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


# == Golay keys ==


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the three bytes of a word, error pattern by syndrome, the <=6 masks by syndrome).

    A mask turns a word into one of the codewords that it or a word one bit away decodes to.
    """
    one = [_remainder(1 << i) for i in range(23)]
    parts = np.zeros((3, 256), np.int32)
    for k in range(3):
        for b in range(256):
            s = 0
            for i in range(8):
                if b >> i & 1 and 8 * k + i < 23:
                    s ^= one[8 * k + i]
            parts[k, b] = s
    error = np.full(2048, -1, np.int32)
    error[0] = 0
    for i in range(23):
        error[one[i]] = 1 << i
        for j in range(i):
            error[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                error[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    assert (error >= 0).all()  # the code is perfect
    masks = np.zeros((2048, 6), np.int32)
    for s in range(2048):
        found = dict.fromkeys([int(error[s]), *(int(error[s ^ one[i]]) ^ 1 << i for i in range(23))])
        assert len(found) <= 6
        masks[s] = [*found, *[int(error[s])] * (6 - len(found))]
    return parts, error, masks


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): the codeword indices (12 bits) of each word and of the words one bit away, repeats filling up."""
    parts, _, masks = golay_tables()
    w = words.astype(np.int32)
    syndrome = parts[0, w & 255] ^ parts[1, w >> 8 & 255] ^ parts[2, w >> 16 & 255]
    return (w[:, None] ^ masks[syndrome]) >> 11


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for all fuzzy keys of the fingerprints (uint64), each key once a row."""
    n = len(fps)
    raw, fuzzy, at = [], [], 0
    for width in WIDTHS:
        seg = (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        raw.append(seg)
        fuzzy.append(golay_indices(seg).astype(np.int64))
        at += width
    out = [(fuzzy[0][:, :, None] << 12 | fuzzy[1][:, None, :]).reshape(n, 36)]
    for family, (f, r) in enumerate(((0, 2), (2, 0), (1, 2), (2, 1)), 1):
        out.append(family << 40 | fuzzy[f] << 22 | raw[r][:, None])
    keys = np.sort(np.concatenate(out, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


# == links in a bucket ==


def _forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is joined by links of at most ``distance`` bits, at most one for each fingerprint.

    Walks from one fingerprint to all it reaches; what has been reached leaves the search, so a
    dense bucket takes few passes and none lists all its pairs.
    """
    a, b, left = [], [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(np.full(len(got), x, np.uint64))
                b.append(got)
                todo.extend(got)
    return a, b


def bucket_links(key: np.ndarray, fps: np.ndarray, distance: int = 3, small: int = 24, large: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets, given rows sorted by key.

    Buckets of up to ``small`` rows are compared pair by pair, all at once; larger ones by a walk
    that yields a spanning forest. Beyond ``large`` rows a bucket is parted before that: by the fuzzy
    keys of the segment its key leaves out, which find up to two errors there, and by the other two
    segments as they are, which find the rest (three errors in the one leave none for them).
    """
    out_a, out_b = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size = np.repeat(sizes, sizes)
    for s in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.flatnonzero((size[:-s] > s) & (size[:-s] <= small) & (key[:-s] == key[s:]))
        near = np.bitwise_count(fps[i] ^ fps[i + s]) <= distance
        out_a.append(fps[i[near]])
        out_b.append(fps[i[near] + s])
    for k in np.flatnonzero(sizes > small):
        group = fps[starts[k] : starts[k] + sizes[k]]
        if len(group) > large:
            out = LEFT_OUT[int(key[starts[k]] >> 40)]
            low, width = sum(WIDTHS[:out]), WIDTHS[out]
            mask = np.uint64((1 << width) - 1) << np.uint64(low)
            sub = golay_indices(((group & mask) >> np.uint64(low)).astype(np.int64))
            rows = np.repeat(np.arange(len(group)), 6)
            order = np.argsort(sub.ravel(), kind="stable")
            cuts = np.flatnonzero(np.diff(sub.ravel()[order])) + 1
            parts = [np.unique(group[r]) for r in np.split(rows[order], cuts)]
            rest = group & ~mask
            order = np.argsort(rest, kind="stable")
            parts += np.split(group[order], np.flatnonzero(np.diff(rest[order])) + 1)
        else:
            parts = [group]
        for part in parts:
            a, b = _forest(part, distance)
            out_a += a
            out_b += b
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return cat(out_a), cat(out_b)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEY = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that connect the fingerprints (column fp, each once) at ``distance`` bits or fewer.

    ``distance`` is 3 at most: the keys guarantee no more. The links' components are those of all
    such pairs; within large buckets only a spanning forest of them is returned.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the Golay keys guarantee distances from 0 to 3")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 4096):
                part = f[at : at + 4096]
                rows, keys = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], schema=_KEY)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_k, hold_f = [], []

        def flush(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k) > 1:
                a, b = bucket_links(k, f.view(np.uint64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_LINK)

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            if hold_k and hold_k[-1][-1] == k[0] == k[-1]:
                hold_k.append(k)
                hold_f.append(f)
                continue
            k, f = np.concatenate([*hold_k, k]), np.concatenate([*hold_f, f])
            end = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            yield from flush(k[:end], f[:end])
            hold_k, hold_f = [k[end:]], [f[end:]]
        if hold_k:
            yield from flush(np.concatenate(hold_k), np.concatenate(hold_f))

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_keys.mapInArrow(linked, "a long, b long").distinct()


# == documents ==


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp (long), component_id (smallest id of its component), component_size.

    Fingerprints are grouped before any search, so copies meet as one row; components are found
    among distinct fingerprints. Null texts and texts without words have fingerprint zero and link
    like any other. Repeated rows stay rows of their own. A null id never is a component's id; a
    component of null ids only has null. Texts of any length are read whole. An empty table gives an
    empty result. Columns of other names are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp"))
    base = cut(base)
    reps = base.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    comps = components(links(reps.select("fp"), distance))
    placed = reps.join(comps, reps.fp == comps.node, "left").select("fp", "rep", "copies", F.coalesce("component", "fp").alias("label"))
    placed = cut(placed)  # both sides of the join below are then plain shuffles, and a large component can be split
    roots = cut(placed.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("component_size")))
    named = cut(placed.join(roots, "label").select("fp", "component_id", "component_size"))
    return base.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id of each; of repeated rows one.

    Rows without an id stay. All columns of ``docs`` are returned as they are.
    """
    found = near_duplicates(docs, shingle, distance, id_col, text_col)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    out = docs.join(kept, docs[id_col].cast("long") == F.col("__kept"), "left_semi")
    return out.dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
