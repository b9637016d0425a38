"""MP4 containers: boxes, duration, size and codecs; scenes and their transcripts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of every box's body, nested ones after their parent; sizes of 64 bits and to the end are read."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        stop = end if size == 0 else at + size
        if stop > end or stop < at + head:
            return
        yield kind, at + head, stop
        if kind in NESTED:
            yield from boxes(data, at + head, stop)
        at = stop


def describe(data: bytes) -> dict:
    """duration (seconds), width, height and codecs of an MP4."""
    out: dict = {"duration": None, "width": None, "height": None, "codecs": []}
    for kind, a, b in boxes(data):
        body = data[a:b]
        if kind == b"mvhd":
            scale, length = struct.unpack(">IQ", body[20:32]) if body[0] == 1 else struct.unpack(">II", body[12:20])
            out["duration"] = length / scale if scale else None
        elif kind == b"tkhd":
            w, h = struct.unpack(">II", body[-8:])
            if w and h:
                out["width"], out["height"] = w >> 16, h >> 16
        elif kind == b"stsd" and len(body) >= 16:
            out["codecs"].append(body[12:16].decode("latin-1"))
    return out


def scenes(duration: float, n: int, least: float = 2.0) -> list[tuple[float, float]]:
    """At most n scenes of equal length, none shorter than ``least`` seconds."""
    n = max(1, min(n, int(duration // least)))
    return [(duration * i / n, duration * (i + 1) / n) for i in range(n)]


def transcript_by_scene(scene_table: DataFrame, segments: DataFrame, bucket: float = 60.0) -> DataFrame:
    """(video, scene, start, end, transcript): segments that overlap each scene, in order.

    Both sides are dealt into buckets of time, so the interval join is an equi-join on (video, bucket)
    with the overlap as a filter, and each pair is kept in its first common bucket only.
    """
    b = lambda a, z: F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(z) / bucket))
    s = scene_table.withColumn("__b", F.explode(b("start", "end")))
    t = segments.select("video", F.col("start").alias("__s"), F.col("end").alias("__e"), "text").withColumn("__b", F.explode(b("__s", "__e")))
    first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("__s") / bucket)) == F.col("__b")
    j = s.join(t, ["video", "__b"]).filter((F.col("__s") < F.col("end")) & (F.col("__e") > F.col("start")) & first)
    g = j.groupBy("video", "scene").agg(F.array_sort(F.collect_list(F.struct("__s", "text"))).alias("x"))
    return scene_table.join(g, ["video", "scene"], "left").select("video", "scene", "start", "end", F.coalesce(F.array_join(F.transform("x", lambda y: y["text"]), " "), F.lit("")).alias("transcript"))
