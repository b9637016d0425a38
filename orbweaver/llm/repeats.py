"""Exact removal of long repeated byte strings, by prefix-free parsing.

Rolling-hash triggers cut every text into phrases (see parsing). What a suffix array of the corpus
would place side by side, suffixes that agree in their first ``length`` bytes, is found in three
rounds over ever fewer rows:

1. the dictionary: runs of window starts with one trigger are parted into zones; all windows of a
   zone hold one core string, and a core that occurs once in the corpus rules its windows out;
2. the parse: of the rest, zones whose whole string (all their windows together) occurs again are
   repeated as they stand;
3. ties within a core between unequal zones: those zones, and one representative of each repeated zone
   of the same core, are parted again, into narrow zones; where their cores occur again, single windows
   are hashed (128 bits).

Ranks within the suffix order are not needed for the result, only which suffixes agree, so classes
of equal strings take the place of sorted ranks. All counting is aggregation with map-side partial
sums and joins, so no phrase, however frequent, is gathered by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.llm.parsing import GRAM, Hashes, phrase_windows, split_zones
from orbweaver.session import cut, drop_path, scratch_path

#: Widths of the zones of window starts in the first and second round, and the places a trigger is chosen from,
#: for lengths of 400 bytes or more; see widths.
ZONE, FINE, REACH = 128, 8, 320
#: Bytes hashed at a time; texts beyond are read in overlapping blocks.
BLOCK = 1 << 19


def widths(length: int) -> tuple[int, int, int, int]:
    """(zone, fine, reach, gram) for strings of ``length`` bytes: below 400 all four shrink with the length."""
    if length < 1:
        raise ValueError("length must be 1 byte or more")
    zone, reach = max(1, min(ZONE, length * 8 // 25)), max(1, min(REACH, length * 4 // 5))
    return zone, min(FINE, zone), reach, max(1, min(GRAM, length // 10))


def text_id(text: Column) -> Column:
    """A 128-bit id of a text's bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(row, offset, bytes) of blocks of whole texts, or of overlapping parts of a long one."""
    rows, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, BLOCK):
            part = t[at : at + BLOCK + length - 1]
            if size and size + len(part) > BLOCK:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def packed(first: np.ndarray, last: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """One integer for a zone: its first window start, its width (up to 256) and the trigger's distance (up to 1024)."""
    return first << 18 | (last - first) << 10 | (trigger - last)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = at >> 18
    last = first + (at >> 10 & 255)
    return first, last, last + (at & 1023)


def zones(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, core, first, last, trigger) of all zones of the texts; first and last are window starts."""
    zone, _, reach, gram = widths(length)
    for rows, offsets, parts in _blocks(texts, length):
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - np.array([len(p) for p in parts])
        hashes = Hashes(data, 0)
        first, last, trigger, z = split_zones(*phrase_windows(hashes, starts, ends, length, reach, gram), zone)
        core = hashes.of(trigger - z * zone, length - zone + 1)
        where = np.searchsorted(ends, first, side="right")
        shift = np.array(offsets)[where] - starts[where]
        yield np.array(rows)[where], core, first + shift, last + shift, trigger + shift


def _stretches(text: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, bytes, zones) of parts of a text that hold the zones; neighbours together, BLOCK or so at most."""
    at = np.unique(at)
    first, last, trigger = unpacked(at)
    begin = 0
    while begin < len(at):
        end = begin + 1
        while end < len(at) and first[end] <= last[end - 1] + length and last[end] - first[begin] < BLOCK:
            end += 1
        low = int(first[begin])
        yield low, text[low : int(max(last[begin:end].max() + length, trigger[begin:end].max()))], at[begin:end]
        begin = end


_DISTINCT = pa.schema([("tid", pa.binary()), ("z", pa.binary())])


def _distinct_texts(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """(tid, z): each distinct text once, compressed. Copies are dropped in each task before the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, squeeze = set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                tids, keep, out = part.column(0).to_pylist(), [], []
                for i, (tid, text) in enumerate(zip(tids, part.column(1), strict=True)):
                    if tid not in seen:
                        seen.add(tid)
                        keep.append(tid)
                        out.append(squeeze.compress((text.as_py() or "").encode("utf-8", "surrogatepass")))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(out, pa.binary())], schema=_DISTINCT)

    packed = docs.select(text_id(F.col(text_col)).alias("tid"), F.col(text_col).alias("text")).mapInArrow(pack, "tid binary, z binary")
    return packed.repartition(parts, "tid").dropDuplicates(["tid"])  # in place: later joins on tid need no shuffle of texts


def _zone_rows(texts: DataFrame, length: int) -> DataFrame:
    """(core, tid, at) of every zone of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tids = part.column(0)
                for row, core, *place in zones([expand.decompress(z) for z in part.column(1).to_pylist()], length):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), tids.take(pa.array(row)), pa.array(packed(*place))], ["core", "tid", "at"])

    return texts.mapInArrow(run, "core long, tid binary, at long")


def _per_text(texts: DataFrame, zone_table: DataFrame, length: int, schema: str, make) -> DataFrame:
    """Rows made from the zones of each text; the texts stay where they are, the zones come to them."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            tids = batch.column(0)
            for i, (z, ats) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                text = np.frombuffer(expand.decompress(z.as_py()), np.uint8)
                out = [make(low, data, at, length) for low, data, at in _stretches(text, ats.values.to_numpy(zero_copy_only=False), length)]
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                arrays = [tids.take(pa.array(np.full(len(cols[0]), i))), *(pa.array(c.view(np.int64)) for c in cols)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    grouped = zone_table.groupBy("tid").agg(F.collect_list("at").alias("ats"))  # the zones of one text
    return texts.join(grouped, "tid").select("tid", "z", "ats").mapInArrow(run, schema)


def _whole_zones(low: int, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(core, f1, f2, at): the hash of the core and the 128-bit hash of all of each zone."""
    first, last, trigger = unpacked(at)
    one, two = Hashes(data, 0), Hashes(data, 1)
    size, zone = last - first + length, widths(length)[0]
    core = one.of(trigger - low - (trigger - first) // zone * zone, length - zone + 1)
    return core, one.of(first - low, size), two.of(first - low, size), at


def _fine_zones(low: int, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(core, at): the zones parted into narrow ones."""
    fine = widths(length)[1]
    first, last, trigger, z = split_zones(*unpacked(at), fine)
    return Hashes(data, 0).of(trigger - low - z * fine, length - fine + 1), packed(first, last, trigger)


def _single_windows(low: int, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(f1, f2, first): the 128-bit hash of every window of the zones."""
    first, last, _ = unpacked(at)
    n = last - first + 1
    p = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return Hashes(data, 0).of(p - low, length), Hashes(data, 1).of(p - low, length), p


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _again(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once.

    Counts aggregate before their shuffle. The keys are written before the join: adaptive execution
    only splits the rows of a hot key where both sides of the join are plain shuffles.
    """
    return rows.join(cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)), keys)


def _repeats(texts: DataFrame, copies: DataFrame, length: int, paths: list[str]) -> DataFrame:
    """(tid, whole, spans): texts with repeats; spans are runs of window starts, whole if the text has copies."""
    shared = _again(_zone_rows(texts, length), ["core"]).select("tid", "at")  # made twice rather than stored: most rows go
    rows = _staged(_per_text(texts, shared, length, "tid binary, core long, f1 long, f2 long, at long", _whole_zones), paths[0])
    classes = _staged(rows.groupBy("core", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at")).alias("rep")), paths[1])
    again = rows.join(classes.filter("n > 1").select("core", "f1", "f2"), ["core", "f1", "f2"]).select("tid", "at")
    tied = cut(classes.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"))
    segments = classes.join(tied, "core").select("rep.*")
    fine = _again(_staged(_per_text(texts, segments, length, "tid binary, core long, at long", _fine_zones), paths[2]), ["core"])
    windows = _staged(_per_text(texts, fine.select("tid", "at"), length, "tid binary, f1 long, f2 long, first long", _single_windows), paths[3])
    single = _again(windows, ["f1", "f2"]).select("tid", "first", F.col("first").alias("last"))
    first = F.shiftright("at", 18)
    wide = again.select("tid", first.alias("first"), (first + F.shiftright("at", 10).bitwiseAND(255)).alias("last"))
    spans = wide.unionByName(single).groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # of one text
    whole = copies.filter("n > 1").select("tid", F.lit(True).alias("whole"))
    return spans.join(whole, "tid", "full_outer").select("tid", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def merge(spans: list[tuple[int, int]], size: int, length: int, whole: bool) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) from runs of window starts."""
    if whole and size >= length:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text, joined."""
    at, out = 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _find(docs: DataFrame, length: int, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    widths(length)  # raises where there is none
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _distinct_texts(docs, text_col, parts).persist(StorageLevel.DISK_ONLY)
    paths = [scratch_path(spark, "repeats") for _ in range(4)]
    try:
        copies = docs.select(text_id(F.col(text_col)).alias("tid")).groupBy("tid").agg(F.count("*").alias("n"))
        found = _repeats(texts, copies, length, paths)
        if not digest:
            return cut(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expand = zstandard.ZstdDecompressor()
            for batch in batches:
                out = []
                for z, whole, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    data = expand.decompress(z.as_py())
                    runs = merge([(s["first"], s["last"]) for s in spans or ()], len(data), length, bool(whole))
                    out.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        schema = "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        return cut(texts.join(found, "tid", "left").select("tid", "z", "whole", "spans").mapInArrow(run, schema))
    finally:
        texts.unpersist()
        for p in paths:
            drop_path(spark, p)


def repeats_report(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else (the same
    document included, overlaps too) counts as removed, judged on the input. Null is the empty text.
    Repeated rows are documents of their own, so each repeats the other. Matches never cross
    documents. Null ids and other columns do no harm; an empty table has no rows.
    """
    found = _find(docs, length, text_col, digest=True)
    return docs.select(id_col, text_id(F.col(text_col)).alias("tid")).join(found, "tid").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with repeated strings removed from ``text_col``, as repeats_report counts them.

    A character of which some bytes go goes as a whole. ``size_col``, if given, is set to the number
    of characters left. A null text stays null; rows without repeats stay as they are.
    """
    found = _find(docs, length, text_col, digest=False)

    @F.pandas_udf("string")
    def left(texts: pd.Series, whole: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, w, s in zip(texts, whole, spans, strict=True):
            if t is None or w is None or pd.isna(w):
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            runs = merge([(x["first"], x["last"]) for x in s], len(data), length, bool(w))
            out.append(kept_bytes(data, runs).decode("utf-8", "ignore") if runs else t)
        return pd.Series(out, dtype=object)

    names = docs.columns
    out = docs.withColumn("__tid", text_id(F.col(text_col))).join(found.select(F.col("tid").alias("__tid"), F.col("whole").alias("__whole"), F.col("spans").alias("__spans")), "__tid", "left")
    out = out.withColumn(text_col, left(F.col(text_col), F.col("__whole"), F.col("__spans")))
    if size_col:
        out = out.withColumn(size_col, F.when(F.col("__whole").isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out.select(*names)
