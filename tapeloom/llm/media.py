"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized, tiled and hashed.

Defined cases: null and empty texts become one padding block; bytes that are no supported
image decode to null features instead of failing the job; repeated rows give repeated rows;
columns other than the id and the text or media column are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

BLOCK = 576
PAD = 255
TAIL = 32


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Smaller frames, so that a task holds the copies of few rows at a time."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary greyscale Netpbm of a (height, width) uint8 array."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary colour Netpbm of a (height, width, 3) uint8 array."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 24 bits for (height, width, 3), 8 bits with a grey palette for (height, width)."""
    high, wide = pixels.shape[:2]
    grey = pixels.ndim == 2
    body = pixels[::-1] if grey else pixels[::-1, :, ::-1]
    line = wide * (1 if grey else 3)
    rows = np.zeros((high, -(-line // 4) * 4), np.uint8)
    rows[:, :line] = body.reshape(high, line)
    palette = (np.arange(256, dtype="<u4") * 0x010101).tobytes() if grey else b""
    start = 54 + len(palette)
    head = np.array([40, wide, high], "<i4").tobytes() + np.array([1, 8 if grey else 24], "<u2").tobytes()
    head += np.array([0, rows.size, 2835, 2835, 256 if grey else 0, 0], "<i4").tobytes()
    return b"BM" + np.array([start + rows.size, 0, start], "<u4").tobytes() + head + palette + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    at, fields = 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if m is None:
            raise ValueError("damaged header")
        fields.append(int(m[1]))
        at = m.end()
    wide, high = fields[:2]
    depth = fields[2] if len(fields) > 2 else 1
    planes = 3 if kind in (3, 6) else 1
    n = wide * high * planes
    if not 0 < depth < 65536:
        raise ValueError("damaged header")
    if kind == 1:
        got = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", data[at:])), np.uint8)[:n] - 48
    elif kind in (2, 3):
        got = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, offset=at + 1, count=-(-wide // 8) * high)
        got = np.unpackbits(packed.reshape(high, -1), axis=1)[:, :wide].ravel()
    else:
        got = np.frombuffer(data, np.uint8 if depth < 256 else ">u2", offset=at + 1, count=n)
    if got.size != n:
        raise ValueError("too few samples")
    if kind in (1, 4):
        got = (1 - got.astype(np.int64)) * 255
    elif depth != 255:
        got = (got.astype(np.int64) * 255 + depth // 2) // depth
    return got.astype(np.uint8).reshape((high, wide, 3) if planes == 3 else (high, wide))


def _bmp(data: bytes) -> np.ndarray:
    start, head = np.frombuffer(data, "<u4", 2, 10)
    wide, high = np.frombuffer(data, "<i4", 2, 18)
    bits = int(np.frombuffer(data, "<u2", 1, 28)[0])
    if int(np.frombuffer(data, "<u4", 1, 30)[0]) or bits not in (8, 24, 32) or wide <= 0 or high == 0:
        raise ValueError("unsupported BMP")
    wide, rows = int(wide), abs(int(high))
    stride = -(-wide * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, stride * rows, int(start)).reshape(rows, stride)[:, : wide * bits // 8]
    if high > 0:
        body = body[::-1]
    if bits == 8:
        n = (int(start) - 14 - int(head)) // 4
        colours = np.frombuffer(data, np.uint8, n * 4, 14 + int(head)).reshape(n, 4)[:, 2::-1]
        grey = (colours == colours[:, :1]).all()
        return colours[body][:, :, 0] if grey else colours[body]
    return body.reshape(rows, wide, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """uint8 array (height, width) or (height, width, 3) of Netpbm P1 to P6 or uncompressed BMP."""
    if re.match(rb"P[1-6]\s", data):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Exact mean over each target cell, fractional borders included, from an integral image."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)
    rows, cols = grey.shape
    total = np.zeros((rows + 1, cols + 1))
    total[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)

    def cut(n, m):
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (r, fr), (c, fc) = cut(rows, high), cut(cols, wide)
    lines = total[r] * (1 - fr)[:, None] + total[r + 1] * fr[:, None]
    grid = lines[:, c] * (1 - fc) + lines[:, c + 1] * fc
    sums = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return sums / ((rows / high) * (cols / wide))


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: each cell of an 8 by 9 reduction against its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 24) -> bytes:
    """The image reduced to a square uint8 tile, as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BLOCK) -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes as a lossless greyscale Netpbm image.

    Padded with 255 to a positive multiple of the width, one image row per ``width`` bytes.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            raw = [(t or "").encode() for t in b["text"]]
            media = []
            for x in raw:
                rows = max(1, -(-len(x) // width))
                media.append(encode_pgm(np.frombuffer(x.ljust(rows * width, bytes([PAD])), np.uint8).reshape(rows, width)))
            yield pd.DataFrame({"id": b["id"].array, "n_bytes": [len(x) for x in raw], "media": media})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(encode, f"id {dict(src.dtypes)['id']}, n_bytes long, media binary")


def media_features(media: DataFrame, media_col: str = "media", side: int = 24, keep: tuple[str, ...] = ("id", "n_bytes")) -> DataFrame:
    """The ``keep`` columns with digests, difference hash and NPY tile of the decoded bytes.

    Media that are null or cannot be decoded have null payload and feature columns.
    """
    src = media.select(*keep, F.col(media_col).alias("_media"))
    types = ", ".join(f"`{k}` {t}" for k, t in src.select(*keep).dtypes)

    def one(data):
        if data is None:
            return (None,) * 9
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            pixels = decode(bytes(data))
        except (ValueError, IndexError, TypeError):
            return (None, None, None, *stored, None, None, None, None)
        payload = pixels.tobytes()
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), *stored,
            difference_hash(pixels), npy_tile(pixels, side), pixels.shape[0], pixels.shape[1],
        )

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "height", "width"]

    def decode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            got = pd.DataFrame([one(x) for x in b["_media"]], columns=names, dtype=object, index=b.index)
            yield pd.concat([b.drop(columns="_media"), got], axis=1)

    made = (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, tile binary, height long, width long"
    )
    return src.mapInPandas(decode_all, f"{types}, {made}")


def stored_text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BLOCK) -> DataFrame:
    """Texts written as media to the shared folder; the features come from the bytes read back."""
    return media_features(staged(text_media(docs, id_col, text_col, width)))
