"""Image hashes of encoded images: decode, luma, resize to 17x16, hash.

Files are decoded by the JVM, through Spark's ``image`` reader (PNG, JPEG and
others).  Images in a BINARY column are decoded here, as there is no JVM function
for that: PNG, and sequential JPEG (``jpeg``); anything else has an error instead of a hash.
Hashes of decoded images need not equal those of another decoder or resampler;
the hash of given gray pixels is exact.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import HASH_SIZE, ROW_STRIDE
from .jpeg import decode_jpeg


@lru_cache(maxsize=256)
def _weights(source: int, target: int) -> np.ndarray:
    """[target, source] weights of a Lanczos filter of three lobes, widened when the image shrinks."""
    ratio = source / target
    width = max(1.0, ratio)
    center = (np.arange(target) + 0.5) * ratio - 0.5
    x = (np.arange(source)[None] - center[:, None]) / width
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def gray_grid(pixels: np.ndarray) -> bytes:
    """The 17x16 gray grid of an image [y, x, channel] in blue, green, red(, alpha) order, or of one channel."""
    p = pixels.astype(np.float64)
    luma = p[:, :, 0] if p.shape[2] == 1 else p[:, :, 2] * 0.2126 + p[:, :, 1] * 0.7152 + p[:, :, 0] * 0.0722
    luma = np.floor(luma + 1e-6)
    small = _weights(luma.shape[0], HASH_SIZE) @ luma @ _weights(luma.shape[1], ROW_STRIDE).T
    # even areas stay even: what the filter's sums leave behind the comma is no gradient
    return np.clip(np.rint(small), 0, 255).astype(np.uint8).tobytes()


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line without its filter. Kinds are fixed: none, sub, up, average, Paeth."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = line.astype(np.int64).tolist(), above.astype(np.int64).tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            by = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(by - v))
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


#: First column and row, and steps, of the passes of an interlaced PNG.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def decode_png(data: bytes) -> np.ndarray:
    """Pixels [y, x, channel], in blue, green, red(, alpha) order or of one channel."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if per is None or depth not in (1, 2, 4, 8, 16) or not width or not height or (colour == 3 and palette is None):
        raise ValueError("unsupported PNG")
    raw, pixels = np.frombuffer(zlib.decompress(body), np.uint8), np.empty((height, width, per), np.uint8)
    at = 0
    # seven pictures of some rows and columns each where it is interlaced
    for x0, y0, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            size = (-(-w * per * depth // 8) + 1) * h
            pixels[y0::dy, x0::dx] = _png_rows(raw[at : at + size], w, h, per, depth, colour)
            at += size
    if colour == 3:
        return palette[pixels[:, :, 0]][:, :, ::-1]
    return pixels[:, :, [2, 1, 0, 3][:per]] if per >= 3 else pixels[:, :, :1]


def _png_rows(raw: np.ndarray, width: int, height: int, per: int, depth: int, colour: int) -> np.ndarray:
    """Samples [y, x, channel] as bytes."""
    line, step = -(-width * per * depth // 8), max(1, per * depth // 8)
    raw = raw.reshape(height, line + 1)
    rows, above = np.empty((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        rows = rows if colour == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return rows[:, : width * per].reshape(height, width, per)


def decode(data: bytes) -> np.ndarray:
    """Pixels of a PNG or JPEG, told apart by their first bytes."""
    return decode_jpeg(data) if data[:2] == b"\xff\xd8" else decode_png(data)


def _hash(pixels: np.ndarray) -> str:
    grid = np.frombuffer(gray_grid(pixels), np.uint8).reshape(HASH_SIZE, ROW_STRIDE)
    return np.packbits((grid[:, :-1] > grid[:, 1:]).ravel()).tobytes().hex()


def hash_image_bytes(images: DataFrame, content_col: str = "content") -> DataFrame:
    """images with a column ``image``: struct<hash, error> of encoded images in a BINARY column. Null has neither."""

    @F.pandas_udf("hash string, error string")
    def hashed(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                out.append((None if data is None else _hash(decode(bytes(data))), None))
            except (ValueError, zlib.error, struct.error, IndexError, KeyError, OverflowError) as e:
                out.append((None, f"image load/decode failed: {e}"))
        return pd.DataFrame(out, columns=["hash", "error"])

    return images.withColumn("image", hashed(content_col))


def read_image_hashes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, hash, error): 64 hex digits, or what kept the file from being decoded."""
    rows = spark.read.format("image").load(paths).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, errors = [], []
            for h, w, n, data in zip(pdf.height, pdf.width, pdf.nChannels, pdf.data, strict=True):
                if h is None or h <= 0 or w <= 0:
                    hashes.append(None)
                    errors.append("image load/decode failed: not an image")
                    continue
                hashes.append(_hash(np.frombuffer(data, np.uint8).reshape(h, w, n)))
                errors.append(None)
            yield pd.DataFrame({"path": pdf.origin, "hash": hashes, "error": errors})

    return rows.mapInPandas(run, "path string, hash string, error string")
