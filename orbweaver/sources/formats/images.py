"""Images: PNG and BMP pixels, JPEG sizes, and feature vectors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_PIXELS = 64_000_000


def png(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(height, width, 3) pixels and the text chunks of a PNG of 8 bits a channel, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, idat, text, palette, head = 8, b"", {}, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        elif kind == b"tEXt" and b"\0" in body:
            k, _, v = body.partition(b"\0")
            text[k.decode("latin-1")] = v.decode("latin-1")
        at += 12 + size
    if head is None:
        raise ValueError("the PNG has no header")
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or interlace or width * height > MAX_PIXELS:
        raise ValueError("only PNGs of 8 bits, not interlaced, and of a bounded size are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        up = out[y - 1] if y else np.zeros(width * n, np.uint8)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).ravel()
        else:
            row, above = [0] * n, [0] * n + up.tolist()
            for i, v in enumerate(line.tolist()):
                a, b, c = row[i], above[i + n], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row.append((v + guess) & 255)
            out[y] = row[n:]
    px = out.reshape(height, width, n)
    if color == 3:
        px = palette[px[..., 0]]
    return (np.repeat(px[..., :1], 3, axis=2) if n < 3 and color != 3 else px[..., :3]), text


def bmp(data: bytes) -> np.ndarray:
    """Pixels of an uncompressed BMP of 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    offset, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3) or abs(width * height) > MAX_PIXELS:
        raise ValueError("only plain BMPs of 24 or 32 bits are read")
    n, line = bits // 8, -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), offset).reshape(abs(height), line)[:, : width * n].reshape(abs(height), width, n)
    return (rows[::-1] if height > 0 else rows)[..., 2::-1]


def jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) of a JPEG from its frame header. Pixels are not decoded."""
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("the JPEG has no frame header")


def _shrunk(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    ys, xs = np.linspace(0, gray.shape[0], h + 1), np.linspace(0, gray.shape[1], w + 1)
    cell = lambda a, b, k: slice(int(a), max(int(a) + 1, int(b)))
    return np.array([[gray[cell(ys[i], ys[i + 1], i), cell(xs[j], xs[j + 1], j)].mean() for j in range(w)] for i in range(h)])


def features(px: np.ndarray) -> list[float]:
    """8 x 8 luminance, 64 colour bins, 32 luminance bins, and 64 bits of horizontal differences; scaled to length one."""
    gray = px @ np.array([0.299, 0.587, 0.114]) / 255
    color = np.bincount((px // 64 @ np.array([16, 4, 1])).ravel(), minlength=64) / gray.size
    light = np.histogram(gray, 32, (0, 1))[0] / gray.size
    small = _shrunk(gray, 8, 9)
    v = np.concatenate([_shrunk(gray, 8, 8).ravel(), color, light, (small[:, 1:] > small[:, :-1]).ravel()])
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def describe(data: bytes) -> dict:
    """kind, width, height, features (null for kinds whose pixels are not decoded) and text."""
    if data[:2] == b"\xff\xd8":
        w, h = jpeg_size(data)
        return {"kind": "jpeg", "width": w, "height": h, "features": None, "text": None}
    if data[:2] == b"BM":
        px, text = bmp(data), {}
        kind = "bmp"
    else:
        (px, text), kind = png(data), "png"
    return {"kind": kind, "width": px.shape[1], "height": px.shape[0], "features": features(px.astype(np.float64).astype(np.int64)), "text": "; ".join(map(": ".join, text.items())) or None}


def read(files: DataFrame) -> DataFrame:
    """(path, kind, width, height, features, text, error) of image files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append({"path": path, **describe(bytes(data)), "error": None})
                except Exception as e:  # a broken file is a row with an error
                    rows.append({"path": path, "kind": None, "width": None, "height": None, "features": None, "text": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=["path", "kind", "width", "height", "features", "text", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, kind string, width int, height int, features array<double>, text string, error string")
