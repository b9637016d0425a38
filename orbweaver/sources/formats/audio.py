"""Audio: WAV and AIFF samples, ID3 tags, windows of loudness and spectrum, voice file names."""

from __future__ import annotations

import math
import re
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CENTRES = (60, 120, 200, 300, 450, 700, 1000, 1500, 2200, 3200, 4500, 6000, 8000, 11000)


def _pcm(raw: bytes, bits: int, channels: int, order: str, real: bool = False, unsigned8: bool = True) -> np.ndarray:
    if real:
        x = np.frombuffer(raw[: len(raw) // (bits // 8) * (bits // 8)], f"{order}f{bits // 8}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128 if unsigned8 else np.frombuffer(raw, np.int8) / 128
    elif bits == 24:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if order == "<" else b[:, ::-1]
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v & 0x800000) << 1)) / float(1 << 23)
    else:
        n = bits // 8
        x = np.frombuffer(raw[: len(raw) // n * n], f"{order}i{n}") / float(1 << (bits - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)


def wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples from -1 to 1) of a WAV file; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
        elif kind == b"data" and form:
            code, channels, rate, _, _, bits = form
            return rate, _pcm(body, bits, channels, "<", code == 3)
        at += 8 + size + size % 2
    raise ValueError("the WAV has no samples")


def aiff(data: bytes) -> tuple[int, np.ndarray]:
    """The same of an AIFF file."""
    if data[:4] != b"FORM" or data[8:11] != b"AIF":
        raise ValueError("no AIFF")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack(">4sI", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"COMM":
            channels, _, bits = struct.unpack(">hIh", body[:8])
            exponent, mantissa = struct.unpack(">HQ", body[8:18])
            form = channels, bits, int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))
        elif kind == b"SSND" and form:
            return form[2], _pcm(body[8:], form[1], form[0], ">", unsigned8=False)
        at += 8 + size + size % 2
    raise ValueError("the AIFF has no samples")


def id3(data: bytes) -> dict[str, str]:
    """title, artist, album and year from ID3 tags, version 2 before version 1."""
    out: dict[str, str] = {}
    names = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TYER": "year", b"TDRC": "year"}
    if data[:3] == b"ID3":
        seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        at, end = 10, 10 + seven(data[6:10])
        while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
            size = seven(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            body = data[at + 10 : at + 10 + size]
            if (key := names.get(data[at : at + 4])) and body:
                out.setdefault(key, body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").strip("\0 "))
            at += 10 + size
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        tail = data[-125:]
        for key, a, b in (("title", 0, 30), ("artist", 30, 60), ("album", 60, 90), ("year", 90, 94)):
            if v := tail[a:b].split(b"\0")[0].decode("latin-1").strip():
                out.setdefault(key, v)
    return out


def spectrum(x: np.ndarray, rate: int) -> list[float]:
    """Centroid (of the half rate) and the shares of 7 pairs of bands, from the power near 14 frequencies."""
    x = x[: min(len(x), 4096)]
    if not len(x):
        return [0.0] * 8
    t = np.arange(len(x)) / rate
    power = np.array([abs(np.exp(-2j * math.pi * f * t) @ x) ** 2 if f < rate / 2 else 0.0 for f in CENTRES])
    total = power.sum()
    if total <= 0:
        return [0.0] * 8
    return [float(power @ np.array(CENTRES) / total / (rate / 2)), *(power.reshape(7, 2).sum(1) / total).tolist()]


def windows(rate: int, x: np.ndarray, seconds: float = 10.0) -> list[dict]:
    """Windows of a recording: start, end, rms, zero-crossing rate, activity and spectrum."""
    out, n = [], max(1, int(rate * seconds))
    for at in range(0, len(x), n):
        w = x[at : at + n]
        rms = float(np.sqrt((w**2).mean()))
        activity = "silence" if rms < 0.01 else "quiet" if rms < 0.08 else "speech" if rms < 0.22 else "loud"
        zcr = float((np.signbit(w[1:]) != np.signbit(w[:-1])).mean()) if len(w) > 1 else 0.0
        out.append({"start": at / rate, "end": (at + len(w)) / rate, "rms": rms, "zcr": zcr, "activity": activity, "spectrum": spectrum(w, rate)})
    return out


def describe(path: str, data: bytes) -> list[tuple[int, str]]:
    """A line a window."""
    rate, x = wav(data) if data[:4] == b"RIFF" else aiff(data)
    label = lambda s: f"{int(s) // 60:02d}:{int(s) % 60:02d}"
    return [(i, f"[Audio {label(w['start'])}-{label(w['end'])}] {w['activity']}, rms {w['rms']:.3f}, zero crossings {w['zcr']:.3f}") for i, w in enumerate(windows(rate, x))]


_VOICE_SQL = r"(?i)(PTT|AUD|voice|call)[-_](\d{8})[-_](?:WA)?(\d+)"
VOICE = re.compile(r"(?P<kind>PTT|AUD|voice|call)[-_](?P<date>\d{8})[-_](?:WA)?(?P<number>\d+)", re.I)


def voice_fields(name: Column) -> Column:
    """The same of a column, without Python: null where a name is no voice message's."""
    part = lambda i: F.regexp_extract(name, _VOICE_SQL, i)
    return F.when(name.rlike(_VOICE_SQL), F.struct(part(1).alias("kind"), part(2).alias("date"), part(3).alias("number")))


def voice_name(name: str) -> dict[str, str] | None:
    """kind, date and number of a voice message's file name."""
    m = VOICE.search(name)
    return None if m is None else m.groupdict()
