"""Streaming: replayed and validated events, windows with late data, current state, sensor monitors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbweaver.operators.records import validate
from orbweaver.operators.timeseries import ASSESSMENT, Series, Signal, assess


def replay(spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream over a folder of JSON lines; a bounded number of files a batch bounds each batch's state."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def run_validated(stream: DataFrame, required: list[str], key: str, order: str, valid_path: str, invalid_path: str, checkpoint: str) -> StreamingQuery:
    """Validate each micro-batch: valid rows and invalid ones, with reasons, go to Parquet folders.

    A batch's folders are named by its number, so a batch that runs again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = validate(batch, required, key, order)
        good.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, keys: list[str], time: str, value: str, size: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Window statistics of a stream; windows close ``late`` after their end, which bounds the state."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = stream.withWatermark(time, late).groupBy(*keys, w.alias("w"))
    return g.agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "min", "max")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows closer than ``gap``."""
    g = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_to_table(changes: DataFrame, key: str, order: list[str], path: str, checkpoint: str, operation_col: str = "operation") -> StreamingQuery:
    """Keep the current state of each key as a Parquet table, one version a batch; deletes stay as marks.

    A batch merges with the version before by one aggregation on the key. ``path`` holds version=N folders;
    a batch that runs again rewrites its own version from the one before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place, rest = F.struct(*order), [c for c in batch.columns if c != key]
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{path}/version={number - 1}").select(*batch.columns).unionByName(batch)
        rows.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor(readings: DataFrame, signals: dict[str, Signal], asset: str = "asset", metric: str = "metric", time: str = "ts", value: str = "value", seq: str = "seq", late: str = "1 day") -> DataFrame:
    """An assessment of each asset after every batch that brings it readings.

    The state of an asset is its bounded series, written as JSON with whole seconds and four decimals.
    Readings of a batch are taken in time order; a reading older than the last counts as no time passed.
    """
    kind = next(f.dataType.simpleString() for f in readings.schema if f.name == asset)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = {m: Series.load(d) for m, d in json.loads(state.get[0]).items()} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["t", "s"], kind="stable")
        now = 0.0
        for m, t, v in zip(rows["metric"], rows["t"], rows["v"], strict=True):
            now = max(now, t)
            if m in signals:
                series.setdefault(m, Series()).add(t, None if pd.isna(v) else float(v), signals[m])
        state.update((json.dumps({m: s.dump() for m, s in series.items()}),))
        yield pd.DataFrame([{asset: key[0]} | assess(series, signals, now)])

    r = readings.withWatermark(time, late).select(F.col(asset).alias("asset"), F.col(metric).alias("metric"), F.col(time), (F.unix_micros(F.col(time)) / 1e6).alias("t"), F.col(value).cast("double").alias("v"), F.col(seq).alias("s"))
    return r.groupBy("asset").applyInPandasWithState(update, f"`{asset}` {kind}, {ASSESSMENT}", "series string", "append", GroupStateTimeout.NoTimeout)


def dispatch(actions: DataFrame, send: Callable[[dict], str], outbox: str, checkpoint: str) -> StreamingQuery:
    """Send actions with their batch: results land in ``outbox`` by batch; a retryable failure is tried again with the next.

    ``send`` runs on executors for one row and returns sent, failed or retry; use a dry run where nothing may leave.
    A key that was sent or has failed is not sent again. A task or batch that runs again may send again, so
    receivers have to know a key that they have seen.
    """

    def run(batch: DataFrame, number: int) -> None:
        names, fields = batch.columns, batch.schema.fields
        todo = batch
        if number:
            past = batch.sparkSession.read.schema(T.StructType([*fields, T.StructField("result", T.StringType()), T.StructField("status", T.StringType()), T.StructField("batch", T.LongType())])).parquet(outbox).filter(F.col("batch") < number)
            last = past.groupBy("key").agg(F.max_by(F.struct(*names, "status"), "batch").alias("r"))
            waiting = last.filter("r.status = 'pending'").select("r.*").select(*names)
            todo = batch.unionByName(waiting).join(last.filter("r.status <> 'pending'").select("key"), "key", "left_anti").select(*names)
        todo = todo.dropDuplicates(["key"])

        def deliver(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pdf.drop(columns="__row").assign(result=[send(json.loads(r)) for r in pdf["__row"]])

        sent = todo.withColumn("__row", F.to_json(F.struct(*names))).mapInPandas(deliver, T.StructType([*fields, T.StructField("result", T.StringType())]))
        sent.withColumn("status", F.when(F.col("result") == "retry", "pending").otherwise(F.col("result"))).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return actions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kafka_options(bootstrap: str, topics: list[str], security: str = "SASL_SSL", allow_plaintext: bool = False, username=None, password=None, keystore=None, keystore_password=None, starting: str = "earliest", max_records: int = 500) -> dict[str, str]:
    """Checked options for the Kafka source; connections without TLS are refused unless asked for.

    Spark's own checkpoint takes the place of committed offsets.
    """
    if security == "PLAINTEXT" and not allow_plaintext:
        raise ValueError("a connection without TLS has to be asked for")
    if bool(keystore) != bool(keystore_password):
        raise ValueError("a key store and its password go together")
    if not topics or not bootstrap:
        raise ValueError("bootstrap servers and topics are needed")
    out = {"kafka.bootstrap.servers": bootstrap, "subscribe": ",".join(topics), "startingOffsets": starting, "maxOffsetsPerTrigger": str(max_records), "kafka.security.protocol": security, "kafka.isolation.level": "read_committed", "failOnDataLoss": "true"}
    if security.startswith("SASL"):
        if not (username and password):
            raise ValueError("SASL needs a user and a password")
        out |= {"kafka.sasl.mechanism": "SCRAM-SHA-512", "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.scram.ScramLoginModule required username="{username}" password="{password}";'}
    if keystore:
        out |= {"kafka.ssl.keystore.location": keystore, "kafka.ssl.keystore.password": keystore_password or ""}
    return out
