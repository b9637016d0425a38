"""Kafka records: keys and values decoded, registry Avro, lag and committed offsets. The source itself is Spark's."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from orbweaver.operators import cdc
from orbweaver.streaming.monitor import kafka_options


def open_stream(spark: SparkSession, bootstrap: str, topics: list[str], **settings: object) -> DataFrame:
    """A stream of the topics' records. Needs Spark's Kafka package on the class path; options are those of kafka_options."""
    reader: DataStreamReader = spark.readStream.format("kafka")
    return reader.options(**kafka_options(bootstrap, topics, **settings)).load()


def decoded_key(key: Column) -> Column:
    """A record's key as text: the payload of a JSON object that has one, else the text itself; null for none."""
    text = F.nullif(key.cast("string"), F.lit(""))
    return F.coalesce(F.get_json_object(text, "$.payload"), text)


def decode(records: DataFrame, form: str = "changes") -> DataFrame:
    """Records (topic, key, value, ...) as documents, or as change events in the form of cdc.normalise.

    ``documents``: a row for each item of a JSON array, else one; records without a value are left out.
    ``changes``: the record's own key counts before the one in its event, and a record without a value
    is a delete of its key in the table that its topic names last.
    """
    df = records.withColumn("record_key", decoded_key(F.col("key"))).withColumn("text", F.col("value").cast("string"))
    if form == "documents":
        items = F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")), F.array("text"))
        return df.filter("text IS NOT NULL").withColumn("document", F.explode(items)).drop("text")
    if form != "changes":
        raise ValueError(f"the form is documents or changes, not {form}")
    parts = F.split("topic", r"\.")
    listed = F.to_json(F.array("record_key"))  # ["key"]: the key as a JSON text stands between the brackets
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    before = F.when(F.ltrim("record_key").startswith("{"), F.col("record_key")).otherwise(F.concat(F.lit('{"id":'), quoted, F.lit("}")))
    source = F.to_json(F.struct(F.element_at(parts, -1).alias("table"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("db")))
    gone = F.concat(F.lit('{"op":"d","before":'), before, F.lit(',"source":'), source, F.lit("}"))
    payload = F.when(F.col("text").isNull(), F.when(F.col("record_key").isNotNull(), gone)).otherwise(F.col("text"))
    events = cdc.explode_payloads(df.withColumn("payload", payload).filter("payload IS NOT NULL").drop("text", "key", "value"))
    own = F.coalesce(F.get_json_object("record_key", "$.id"), F.col("record_key"))
    return cdc.normalise(events).withColumn("key", F.coalesce(own, F.col("key")))


def lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """(topic, lag, partitions, uncommitted) from ends (topic, partition, low, high) and commits (topic, partition, offset).

    A partition without a commit is behind by all that it holds; a commit past the end is no lag.
    """
    j = ends.join(committed, ["topic", "partition"], "left")
    none = F.col("offset").isNull() | (F.col("offset") < 0)
    behind = F.when(none, F.col("high") - F.col("low")).otherwise(F.greatest(F.lit(0), F.col("high") - F.col("offset")))
    return j.groupBy("topic").agg(F.sum(behind).alias("lag"), F.count("*").alias("partitions"), F.sum(none.cast("long")).alias("uncommitted"))


def next_offsets(processed: DataFrame, committed: DataFrame, owned: DataFrame) -> DataFrame:
    """(topic, partition, offset): what to commit after ``processed`` (topic, partition, offset) was applied.

    One past the last of each partition that is still owned; a commit never goes back.
    """
    done = processed.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))
    mine = done.join(owned.select("topic", "partition").distinct(), ["topic", "partition"], "left_semi")
    j = mine.join(committed, ["topic", "partition"], "left")
    return j.select("topic", "partition", F.greatest("next", F.coalesce("offset", F.lit(0))).alias("offset"))


class AvroReader:
    """Values of Avro's binary form by a schema: records, enums, arrays, maps, unions, fixed and plain types."""

    def __init__(self, schema: str | dict | list) -> None:
        self.schema = json.loads(schema) if isinstance(schema, str) else schema
        self.named: dict[str, dict] = {}
        self._names(self.schema)

    def _names(self, s: object) -> None:
        if isinstance(s, list):
            for x in s:
                self._names(x)
        elif isinstance(s, dict):
            if s.get("name") and s.get("type") in ("record", "enum", "fixed"):
                self.named[s["name"]] = s
                self.named[f"{s.get('namespace', '')}.{s['name']}".lstrip(".")] = s
            for x in s.get("fields", ()):
                self._names(x["type"])
            for k in ("items", "values"):
                if k in s:
                    self._names(s[k])
            if isinstance(s.get("type"), (dict, list)):
                self._names(s["type"])

    def read(self, data: bytes) -> object:
        return self._value(self.schema, io.BytesIO(data))

    @staticmethod
    def _take(f: io.BytesIO, n: int) -> bytes:
        out = f.read(n)
        if len(out) != n:
            raise ValueError("the value ends too early")
        return out

    def _long(self, f: io.BytesIO) -> int:
        n = shift = 0
        while True:
            b = self._take(f, 1)[0]
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (n >> 1) ^ -(n & 1)

    def _blocks(self, f: io.BytesIO):
        while count := self._long(f):
            if count < 0:
                count = -count
                self._long(f)  # the block's size in bytes
            yield from range(count)

    def _value(self, s: object, f: io.BytesIO) -> object:
        if isinstance(s, list):
            return self._value(s[self._long(f)], f)
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self._value(kind, f)
        if kind == "record":
            return {x["name"]: self._value(x["type"], f) for x in s["fields"]}
        if kind == "enum":
            return s["symbols"][self._long(f)]
        if kind == "array":
            return [self._value(s["items"], f) for _ in self._blocks(f)]
        if kind == "map":
            return {self._value("string", f): self._value(s["values"], f) for _ in self._blocks(f)}
        if kind == "fixed":
            return self._take(f, s["size"]).hex()
        if kind in ("int", "long"):
            return self._long(f)
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self._take(f, 4 if kind == "float" else 8))[0]
        if kind == "boolean":
            return self._take(f, 1) != b"\0"
        if kind == "null":
            return None
        if kind in ("string", "bytes"):
            data = self._take(f, self._long(f))
            return data.decode() if kind == "string" else data.hex()
        return self._value(self.named[kind], f)


def registry_avro(value: Column, schema_of: Callable[[int], str]) -> Column:
    """JSON of values that start with a zero byte and a schema's number; other values as text.

    ``schema_of`` gives a schema by its number (from a registry, or a table sent along); each worker asks once a number.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        readers: dict[int, AvroReader] = {}
        out = []
        for v in values:
            if v is None:
                out.append(None)
            elif len(v) >= 5 and v[0] == 0:
                number = int.from_bytes(v[1:5], "big")
                if number not in readers:
                    readers[number] = AvroReader(schema_of(number))
                out.append(json.dumps(readers[number].read(bytes(v[5:]))))
            else:
                out.append(bytes(v).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return run(value)
