"""File sources and sinks: JSON lines, mixed folders, binary documents, append logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, strictly: blank lines are skipped, a line that is no JSON fails the read."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The same for logs that may not exist yet: a missing path is an empty table."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def title_of(name: Column) -> Column:
    """A file's title: its name without extension, underscores as blanks, words capitalised."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_", " "))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Text files of a folder, one row each: document_id, title, body, filename. Other schemes than the session's are refused by Spark."""
    t = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    t = t.select(F.col("value").alias("body"), F.url_decode(name).alias("filename"))
    return t.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("document_id"), title_of(F.col("filename")).alias("title"), "body", "filename")


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """json (array or object), jsonl, csv (header, all text) or txt/md, by ``kind`` or the path's ending."""
    kind = (kind or path.rstrip("/").rpartition(".")[2]).lower()
    if kind == "jsonl":
        return read_jsonl(spark, path)
    if kind == "json":
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("txt", "md"):
        return read_documents(spark, path)
    raise ValueError(f"no reader for {kind}")


#: First bytes, as hex, and what they mean.
MAGIC = [
    ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("424D", "bmp"), ("474946383761", "gif"), ("474946383961", "gif"), ("25504446", "pdf"), ("504B0304", "zip"),
    ("D0CF11E0A1B11AE1", "ole2"), ("53514C69746520666F726D6174203300", "sqlite"), ("494433", "mp3"), ("FFFB", "mp3"),
]


def sniff(content: Column) -> Column:
    """The kind of a binary document by its first bytes; null where none is known."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    inner = F.hex(F.substring(content, 9, 4))
    out = F.when(head.startswith("52494646") & (inner == "57415645"), "wav").when(head.startswith("52494646") & (inner == "57454250"), "webp").when(head.startswith("464F524D") & inner.startswith("414946"), "aiff").otherwise(out)
    return F.when(F.hex(F.substring(content, 5, 4)) == "66747970", "mp4").otherwise(out)


def read_binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Binary documents with path, kind (what the bytes say goes before the name), length and content."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return b.select("path", F.coalesce(sniff(F.col("content")), F.nullif(ending, F.lit(""))).alias("kind"), "length", "content")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with sorted keys; nulls are written too."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")
