import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweaver.operators.timeseries import Signal, assess_batch
from orbweaver.streaming import monitor as m

import pytest

SCHEMA = T.StructType([T.StructField("asset", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("seq", T.LongType())])
SIGNALS = {"vibration": Signal("vibration", warn_high=4.5, alarm_high=7.1, valid_min=0, valid_max=50), "temp": Signal("temp", warn_high=80, alarm_high=90)}


def write(folder, n=240, fault=True):
    rng, rows = random.Random(1), []
    for i in range(n):
        t = f"2026-01-01T{i // 60:02d}:{i % 60:02d}:00Z"
        rows.append({"asset": "p1", "metric": "vibration", "ts": t, "value": 2 + rng.gauss(0, 0.1) + (max(0, i - 180) * 0.12 if fault else 0), "seq": 2 * i})
        rows.append({"asset": "p2", "metric": "temp", "ts": t, "value": 60 + rng.gauss(0, 0.5), "seq": 2 * i + 1})
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        (folder / f"part-{k}.json").write_text("\n".join(map(json.dumps, part)))
    return rows


def test_monitor_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src)
    stream = m.replay(spark, str(src), SCHEMA, 1)
    out = m.monitor(stream, SIGNALS)
    q = out.writeStream.format("memory").queryName("assessed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("assessed").collect():
        got[r.asset] = r  # the last of each
    batch = {r.asset: r for r in assess_batch(spark.read.schema(SCHEMA).json(str(src)), SIGNALS).collect()}
    assert batch["p1"].anomaly_score > 0.9 and batch["p1"].failure_risk > 0.7 and batch["p1"].top_signal == "vibration"
    assert batch["p2"].anomaly_score < 0.1 and batch["p2"].data_quality == "valid"
    last = max((r for r in spark.table("assessed").collect() if r.asset == "p1"), key=lambda r: r.anomaly_score)
    assert last.anomaly_score == pytest.approx(batch["p1"].anomaly_score, abs=0.01)


def test_windows_and_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = write(src, 60)
    q = m.windowed(m.replay(spark, str(src), SCHEMA), ["metric"], "ts", "value").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("wins").collect()) == len(rows)
    changes = m.replay(spark, str(src), SCHEMA, 1).select(F.col("asset").alias("key"), "seq", "value", F.lit("UPDATE").alias("operation"))
    m.latest_to_table(changes, "key", ["seq"], str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination(120)
    got = {r.key: r.seq for r in spark.read.parquet(str(tmp_path / "t" / "version=2")).collect()}
    assert got == {"p1": 118, "p2": 119}


def test_validated_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"asset":"a","metric":"x","seq":1,"value":1.0}\n{"asset":"a","metric":"x","seq":2,"value":2.0}\n{"metric":"x","seq":3}')
    m.run_validated(m.replay(spark, str(src), SCHEMA), ["asset", "value"], "asset", "seq", str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [r.error for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["missing required fields: asset, value"]


def test_kafka_options():
    with pytest.raises(ValueError):
        m.kafka_options("h:9092", ["t"], "PLAINTEXT")
    got = m.kafka_options("h:9093", ["a", "b"], username="u", password="p")
    assert got["subscribe"] == "a,b" and got["kafka.isolation.level"] == "read_committed"
