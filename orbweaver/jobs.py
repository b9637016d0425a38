"""Configured jobs over tables of records and documents, with the marks up to which sources were read."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import chunking, enrich, records


@dataclass(frozen=True)
class Job:
    """A job: key, fields of its text, transforms (arguments of records.transform), chunking (words, overlap), tags."""

    name: str
    key: str
    text_fields: tuple[str, ...] = ()
    text_field: str | None = None
    title_field: str | None = None
    transforms: dict = field(default_factory=dict)
    chunking: tuple[int, int] | None = None
    tags: dict[str, list[str]] | None = None


def hydrated(job: Job, chunk: tuple[int, int] = (80, 12), tags: dict[str, list[str]] | None = None) -> Job:
    """A job with the defaults where it has nothing of its own."""
    return replace(job, chunking=job.chunking or chunk, tags=job.tags if job.tags is not None else tags)


def records_job(df: DataFrame, job: Job) -> DataFrame:
    """(record_id, source_job, the transformed record, metadata of its text): one projection, nothing is shuffled."""
    payload = records.transform(df, **job.transforms)
    meta = enrich.metadata(records.joined_text(list(job.text_fields)), job.tags)
    return payload.select(F.col(job.key).cast("string").alias("record_id"), F.lit(job.name).alias("source_job"), F.struct(*payload.columns).alias("payload"), meta.alias("metadata"))


def documents_job(df: DataFrame, job: Job) -> DataFrame:
    """(chunk_id, document_id, source_job, chunk_index, text, title, content_hash, metadata).

    Metadata is of title and chunk together; the hash is of the whole text, the same on all its chunks.
    """
    if not job.text_field:
        raise ValueError(f"job {job.name} of documents needs a text field")
    size, overlap = hydrated(job).chunking
    d = records.transform(df, **job.transforms)
    title = F.coalesce(F.col(job.title_field).cast("string"), F.lit("")) if job.title_field else F.lit("")
    d = d.select(F.col(job.key).cast("string").alias("document_id"), title.alias("title"), F.md5(F.col(job.text_field).cast("binary")).alias("content_hash"), F.posexplode(chunking.word_chunks(F.col(job.text_field), size, overlap)).alias("chunk_index", "text"))
    about = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("text"), F.lit("")))
    return d.select(F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "document_id", F.lit(job.name).alias("source_job"), "chunk_index", "text", "title", "content_hash", enrich.metadata(about, job.tags).alias("metadata"))


@dataclass(frozen=True)
class Collection:
    """What of a record is indexed: its id, one text field or several, and its metadata, each a dotted path."""

    name: str
    id_field: str = "id"
    text_field: str | None = None
    text_fields: tuple[str, ...] = ()
    metadata_field: str = "metadata"

    def __post_init__(self) -> None:
        if not self.text_field and not self.text_fields:
            raise ValueError(f"collection {self.name} needs a text field")


def indexed_documents(df: DataFrame, c: Collection, record: str = "record") -> DataFrame:
    """(id, collection, text, metadata) of JSON records; metadata that is missing is {}."""
    at = lambda p: records.path(F.col(record), p)
    text = F.coalesce(at(c.text_field), F.lit("")) if c.text_field else F.concat_ws(" ", *[F.nullif(at(f), F.lit("")) for f in c.text_fields])
    return df.select(at(c.id_field).alias("id"), F.lit(c.name).alias("collection"), text.alias("text"), F.coalesce(at(c.metadata_field), F.lit("{}")).alias("metadata"))


class Marks:
    """The latest event time read from each source, a small text file a source in a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _file(self, source: str) -> str:
        if not source or os.path.basename(source) != source or source.startswith("."):
            raise ValueError(f"{source!r} is no name of a source")
        return os.path.join(self.folder, f"{source}.mark")

    def read(self, source: str) -> str | None:
        try:
            with open(self._file(source), encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def write(self, source: str, mark: str) -> None:
        """Replaces the mark in one step, so that a crash leaves the old one or the new one."""
        os.makedirs(self.folder, exist_ok=True)
        path = self._file(source)
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write(mark)
        os.replace(path + ".new", path)


def run_batch(spark: SparkSession, source: str, df: DataFrame, marks: Marks, required: list[str], key: str, order: str, time: str, valid_path: str, invalid_path: str) -> str | None:
    """Validate what is newer than the source's mark, append valid and invalid rows, then move the mark; returns it."""
    seen = marks.read(source)
    rows = df.filter(F.col(time) > F.lit(seen).cast("timestamp")) if seen else df
    good, bad = records.validate(rows, required, key, order)
    good.write.mode("append").parquet(valid_path)
    bad.write.mode("append").parquet(invalid_path)
    latest = records.high_water_mark(rows, time).first()[0]
    if latest:
        marks.write(source, latest)
    return latest or seen
