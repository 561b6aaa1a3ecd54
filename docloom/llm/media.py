"""Media columns: texts as greyscale PNG in binary columns, read back with checksum
tests, unfiltered with numpy, and hashed by their low cosine frequencies.

Each row of an image is stored with the filter (none, left or upper neighbour) whose
residuals sum to least; readers undo all five filters.  Nulls count as empty texts; every
input row gives one output row, equal texts give equal values, and columns other than the id
and the text are left behind, whatever their names.  An empty table gives no row.  Very long
texts become tall images as a whole; their hash is made a few thousand rows at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table, text_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 576
PAD = b"\xff"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filter_rows(pixels: np.ndarray, kind: int, bpp: int = 1) -> np.ndarray:
    """PNG filter ``kind`` (0-4) of whole rows; ``pixels`` is (height, bytes per row)."""
    x = pixels.astype(np.int16)
    left = np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    corner = np.zeros_like(x)
    corner[1:, bpp:] = x[:-1, :-bpp]
    guess = [0, left, up, (left + up) >> 1, _paeth(left, up, corner)][kind]
    return (x - guess).astype(np.uint8)


def _paeth(a, b, c):
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def best_rows(pixels: np.ndarray) -> np.ndarray:
    """Scan lines of a greyscale image, each with that of the filters 0-2 whose residuals,
    as signed bytes, have the least sum."""
    height, width = pixels.shape
    left, up = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, 1:], up[1:] = pixels[:, :-1], pixels[:-1]
    options = [pixels, pixels - left, pixels - up]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in options])
    kinds = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kinds
    for k, x in enumerate(options):
        rows[kinds == k, 1:] = x[kinds == k]
    return rows


def encode_png(pixels: np.ndarray, kind: int | None = None, level: int = 3, idat: int = 1 << 20) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array, all rows with one filter, or each
    (None) with its best."""
    height, width = pixels.shape
    if kind is None:
        rows = best_rows(np.ascontiguousarray(pixels))
    else:
        rows = np.empty((height, width + 1), np.uint8)
        rows[:, 0], rows[:, 1:] = kind, filter_rows(pixels, kind)
    packed = zlib.compress(rows.tobytes(), level)
    body = [_chunk(b"IDAT", packed[i : i + idat]) for i in range(0, len(packed), idat)]
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    return b"".join([SIGNATURE, head, *body, _chunk(b"IEND", b"")])


def _wave(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Average and Paeth rows undone along diagonals: a pixel needs its left, upper and upper
    left neighbours, which lie on the two diagonals before."""
    n, m = len(rows), rows.shape[1] // bpp
    done = np.zeros((n + 1, m + 1, bpp), np.int16)
    done[0, 1:] = above.reshape(m, bpp)
    residual, average = rows.reshape(n, m, bpp).astype(np.int16), (kinds == 3)[:, None]
    for t in range(n + m - 1):
        y = np.arange(max(0, t - m + 1), min(n - 1, t) + 1)
        x = t - y
        a, b, c = done[y + 1, x], done[y, x + 1], done[y, x]
        done[y + 1, x + 1] = (residual[y, x] + np.where(average[y], (a + b) >> 1, _paeth(a, b, c))) & 255
    return done[1:, 1:].reshape(n, m * bpp).astype(np.uint8)


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Pixels of filtered scan lines (first byte: the filter): sums along rows (left) or down
    them (upper neighbour), diagonals for average and Paeth."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(out[sub].reshape(int(sub.sum()), -1, bpp), axis=1, dtype=np.uint8).reshape(int(sub.sum()), -1)
    group = np.where(kinds < 2, 0, np.where(kinds == 2, 1, 2))
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(rows)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b or group[a] == 0:
            continue
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        out[a:b] = np.cumsum(np.concatenate([above[None], out[a:b]]), axis=0, dtype=np.uint8)[1:] if group[a] == 1 else _wave(out[a:b], kinds[a:b], above, bpp)
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """(height, width) or (height, width, channels) samples of an 8-bit PNG without
    interlacing.  A wrong signature, checksum, order or size raises ValueError."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while at + 12 <= len(blob) and not ended:
        (n,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if len(body) < n or len(blob) < at + 12 + n or struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if head is None and kind != b"IHDR":
            raise ValueError("IHDR must come first")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32 and kind != b"PLTE":
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise ValueError("truncated PNG")
    width, height, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in CHANNELS or method or filters or interlace:
        raise ValueError("only 8-bit PNG without palette or interlacing")
    bpp = CHANNELS[colour]
    stride = width * bpp + 1
    inflater = zlib.decompressobj()
    raw = inflater.decompress(b"".join(packed), height * stride + 1)
    if len(raw) != height * stride or not inflater.eof and inflater.decompress(inflater.unconsumed_tail, 1):
        raise ValueError("image data of the wrong size")
    pixels = unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride), bpp)
    return pixels if bpp == 1 else pixels.reshape(height, width, bpp)


def _cosines(n: int, keep: int) -> np.ndarray:
    k = np.arange(keep)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


def _areas(n: int, m: int) -> np.ndarray:
    """(m, n) weights that average n samples into m equal areas, fractional edges included."""
    edges = np.arange(m + 1) * (n / m)
    i = np.arange(n)
    w = np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i)
    return np.clip(w, 0, None) * (m / n)


_WIDE = _areas(WIDTH, 32)
_DCT = _cosines(32, 8)


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest cosine coefficients of the 32x32 area
    averages exceed the median of those without the constant one."""
    if pixels.ndim == 3:
        pixels = pixels.mean(axis=2)
    height, width = pixels.shape
    if width == WIDTH:  # 18 whole samples an area
        across = pixels.reshape(height, 32, WIDTH // 32).sum(axis=2, dtype=np.float64) / (WIDTH // 32)
    else:
        across = pixels @ _areas(width, 32).T
    step = 4096  # rows at a time, so that the weights stay small for tall images
    small = np.zeros((32, 32))
    edges = np.arange(33) * (height / 32)
    for y in range(0, height, step):
        i = np.arange(y, min(height, y + step))
        w = np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None) * (32 / height)
        small += w @ across[y : y + step]
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of the image's width."""
    return text + PAD * (-len(text) % WIDTH or (0 if text else WIDTH))


def _encode(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = text_bytes(batch.column(1))
        for lo in range(0, len(texts), 512):
            part = texts[lo : lo + 512]
            media = [encode_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH), level=level) for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"]
            )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for v in batch.column(2):
            blob = v.as_py()
            pixels = decode_png(blob)
            data = pixels.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(pixels)))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n_bytes", *names])


def text_to_png(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """(id, n_bytes, media): each text as a lossless PNG in a binary column."""
    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lambda it: _encode(it, level), f"id {kind}, n_bytes long, media binary")


def png_features(media: DataFrame) -> DataFrame:
    """Digests and cosine hash of (id, n_bytes, media), from the decoded samples."""
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(
        _features, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as PNG in a written binary column, read back and hashed."""
    stored = Scratch(spark, "png").keep(text_to_png(table(spark, sf_dir, "documents")), compression="none")
    return png_features(stored).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_png_media": op6_png_media}
ORACLE_SQL: dict[str, str] = {}
