"""Media columns: PNG images in binary columns, and cosine-transform hashes of them.

A payload is stored as a greyscale image of 8-bit samples, WIDTH wide. The writer uses the row filters None and Up (Up
where at least a third of a row repeats the row above); the reader tests every chunk's checksum and undoes all five
filters with numpy. The feature is a 64-bit hash: the image is averaged to 32 x 32, and the 8 x 8 lowest frequencies of
its cosine transform are compared with their median.

Nulls: a null text is an empty one; its payload is one row of spaces. Repeated rows and ties give equal values. Very
long texts are one image, whose height follows the length. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import returning_memory, slices, staged

MAGIC = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
LEVEL = 6
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), width + 1), np.uint8)
    out[:, 1:] = rows
    up = rows[1:] - rows[:-1]
    use = (up == 0).sum(1) * 3 >= width
    out[1:, 0] = 2 * use
    out[1:, 1:][use] = up[use]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered lines (a filter byte and the line's bytes). Runs of rows with the filters None, Sub or Up are
    undone at once; Average and Paeth depend on the byte before and go byte by byte."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind = kinds[lo] if len(kinds) else 0
        if kind == 1:
            part = out[lo:hi].reshape(hi - lo, -1, bpp)
            out[lo:hi] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(hi - lo, -1)
        elif kind == 2:
            first = out[lo - 1 : lo] if lo else np.zeros((1, out.shape[1]), np.uint8)
            out[lo:hi] = np.cumsum(np.concatenate([first, out[lo:hi]]), axis=0, dtype=np.uint8)[1:]
        elif kind >= 3:
            for y in range(lo, hi):
                row, above = out[y].tolist(), out[y - 1].tolist() if y else [0] * out.shape[1]
                for x in range(len(row)):
                    a, b, c = (row[x - bpp] if x >= bpp else 0), above[x], (above[x - bpp] if x >= bpp else 0)
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    row[x] = (row[x] + guess) & 255
                out[y] = row
    return out


def read_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit greyscale or RGB image; a damaged chunk raises ValueError."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    width, height, depth, colour, *rest = head
    if depth != 8 or colour not in (0, 2) or any(rest):
        raise ValueError("only 8-bit greyscale and RGB, not interlaced")
    bpp = 3 if colour == 2 else 1
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * bpp + 1)
    return unfilter(lines, bpp)


_BASIS = np.cos(np.pi / SIDE * (np.arange(SIDE)[None] + 0.5) * np.arange(LOW)[:, None])


def _averaged(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x averaged into n bands of equal height, with fractions of rows."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    edge = np.linspace(0, len(x), n + 1)
    low = np.minimum(edge.astype(int), len(x) - 1)
    at = total[low] + (edge - low)[:, None] * x[low]
    return (at[1:] - at[:-1]) * (n / len(x))


def cosine_hash(rows: np.ndarray) -> bytes:
    small = _averaged(rows.astype(np.float64), SIDE)
    small = _averaged(np.ascontiguousarray(small.T), SIDE).T
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        png = [write_png(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH)) for x in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(png, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[list] = [[] for _ in range(7)]
        for data in b.column(2).to_pylist():
            rows = read_png(data)
            payload, phash = rows.tobytes(), cosine_hash(rows)
            for c, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), phash.hex(), phash), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "phash")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (PNG), as a table in the shared folder."""
    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning_memory(_store), "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Of stored media: sizes and digests of payload and image, and the hash, as text and as a binary column."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        returning_memory(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"
    )


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
