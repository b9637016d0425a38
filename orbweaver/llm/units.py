"""Substring dedup by hashing lines or paragraphs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.session import cut

GAPS = {"line": "\n", "paragraph": "\n\n"}
#: The pieces of a text where units are sentences: a run up to its end marks, or a line break or mark on its own.
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?\n]")
SPACE = re.compile("[\x09-\x0d\x20\x85\xa0  -     　]+")


def normalise(unit: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return SPACE.sub(" ", unit.lower()).strip(" ")


def split_units(text: str | None, by: str) -> list[tuple[int, str]]:
    """(start, unit) of every unit of a text; starts count characters. Null has none."""
    if text is None:
        return []
    if by == "sentence":
        return [(m.start(), m[0]) for m in SENTENCE.finditer(text)]
    gap = GAPS[by]
    out, at = [], 0
    for unit in text.split(gap):
        out.append((at, unit))
        at += len(unit) + len(gap)
    return out


_UNITS = "id {kind}, th long, pos int, start int, size int, digest binary"


def units(docs: DataFrame, id_col: str, text_col: str, by: str, min_words: int) -> DataFrame:
    """(id, th, pos, start, size, digest): the units of ``min_words`` words or more, with their places.

    th is a hash of the whole text, which tells apart texts that share an id.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, out = [], []
                for i, text in enumerate(part.column(2)):
                    for pos, (start, unit) in enumerate(split_units(text.as_py(), by)):
                        norm = normalise(unit)
                        if norm and norm.count(" ") + 1 >= min_words:
                            rows.append(i)
                            out.append((pos, start, len(unit), hashlib.md5(norm.encode("utf-8", "surrogatepass")).digest()))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                place = pa.array(np.array(rows, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), part.column(1).take(place), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "th", "pos", "start", "size", "digest"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, _UNITS.format(kind=kind))


def duplicate_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "line", min_words: int = 1) -> DataFrame:
    """(id, th, pos, start, size): every unit whose normalised form has an earlier occurrence.

    Earlier is by id, then by place in the text; null ids come last. Only digests and places are
    shuffled: their least place aggregates before the shuffle, and a frequent line is a skewed join,
    which adaptive execution splits.
    """
    u = units(docs, id_col, text_col, by, min_words)
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("pos").alias("pos"))
    # written before the join, so that both its sides are plain shuffles, which adaptive execution can split
    first = cut(u.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    return u.join(first, "digest").filter(~same).select("id", "th", "pos", "start", "size")


def _keep(by: str):
    gap = GAPS.get(by, "")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(texts, gone, strict=True):
            if text is None or places is None or not len(places):
                out.append(text or "")
                continue
            drop = set(places)
            out.append(gap.join(u for i, (_, u) in enumerate(split_units(text, by)) if i not in drop))
        return pd.Series(out, dtype=object)

    return kept


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "line", min_words: int = 1) -> DataFrame:
    """One row a document: id, n_units, n_removed, removed (array of start, size), kept_text.

    Units are lines, paragraphs or sentences; those whose normalised form occurs earlier (a smaller id, or
    before in the same text) go, and what stays is joined by the separator again (sentences by nothing, as
    their pieces are the whole text). Offsets count characters of
    the original text. Units without words, or of fewer than ``min_words``, always stay. A null text
    has an empty kept_text and no units. Rows that repeat both id and text are one document, and each
    gets its result; rows without an id come after all others. Texts of any length are read whole; an
    empty table gives no rows. Other columns do no harm.
    """
    n_units = F.size(F.split("__text", GAPS[by])) if by in GAPS else F.size(F.regexp_extract_all("__text", F.lit(SENTENCE.pattern), F.lit(0)))
    gone = duplicate_units(docs, id_col, text_col, by, min_words)
    gone = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "start", "size"))).alias("gone"))  # units of one text
    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text"))
    joined = own.join(gone, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th")), "left")
    places: Column = F.transform("gone", lambda g: g["pos"])
    return joined.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__text").isNull(), 0).otherwise(n_units).cast("long").alias("n_units"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.transform("gone", lambda g: F.struct(g["start"].alias("start"), g["size"].alias("size"))), F.array().cast("array<struct<start:int,size:int>>")).alias("removed"),
        _keep(by)(F.col("__text"), places).alias("kept_text"),
    )
