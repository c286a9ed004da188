"""Netpbm and BMP images as numpy arrays, area-resized by integral images, with NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import written

UNIT = 192  # bytes of one image row: 64 pixels of three samples
TILE = 16


# --- formats ---


def write_netpbm(pixels: np.ndarray) -> bytes:
    """P5 of (height, width) or P6 of (height, width, 3) uint8 samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _fields(data: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """n decimal numbers after white space and comments; where the last ends."""
    out = []
    while len(out) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.find(b"\n", at) + 1 if data[at] == 35 else at + 1
            if at == 0:
                raise ValueError("the header ends in a comment")
        first = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if first == at:
            raise ValueError("a number is missing in the header")
        out.append(int(data[first:at]))
    return out, at


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, plain or raw, up to 16 bits a sample, as uint8 or uint16; bitmaps as 0 (black) and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    (width, height, *most), at = _fields(data, 2 if bitmap else 3)
    most = 1 if bitmap else most[0]
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if not 0 < most < 65536:
        raise ValueError("largest sample out of range")
    if kind == b"P1":
        bits = np.frombuffer(data[at:], np.uint8)
        a = bits[(bits == 48) | (bits == 49)][:n] - 48
    elif kind in (b"P2", b"P3"):
        a = np.array(data[at:].split()[:n], np.int64).astype(np.uint8 if most < 256 else np.uint16)
    elif kind == b"P4":
        row = -(-width // 8)
        a = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        a = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(a) != n:
        raise ValueError("samples are missing")
    if bitmap:
        a = np.where(a, 0, 255).astype(np.uint8)
    a = a.astype(np.uint8 if most < 256 or bitmap else np.uint16)
    return a.reshape(height, width, 3) if channels == 3 else a.reshape(height, width)


def write_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3) uint8 samples."""
    height, width, _ = pixels.shape
    row = -(-width * 3 // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 bits with a palette, or 24 or 32 bits, either way up, as (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head = struct.unpack_from("<II", data, 10)
    width, height = struct.unpack_from("<ii", data, 18)
    depth, packing = struct.unpack_from("<HI", data, 28)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a kind of BMP that is not read")
    rows, size = abs(height), -(-width * depth // 32) * 4
    raw = np.frombuffer(data, np.uint8, size * rows, start).reshape(rows, size)
    if depth >= 24:
        a = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        bits = np.unpackbits(raw, axis=1)[:, : width * depth].reshape(rows, width, depth)
        a = palette[bits @ (1 << np.arange(depth - 1, -1, -1))]
    return np.ascontiguousarray(a[::-1] if height > 0 else a)


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


# --- features ---


def grey(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64) if a.ndim == 2 else a.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new pixel covers, fractions of pixels included, from the integral image."""
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    total[1:, 1:] = a.cumsum(0).cumsum(1)

    def between(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        low = np.minimum(x.astype(np.int64), len(t) - 2)
        part = (x - low).reshape(-1, 1)
        return t[low] * (1 - part) + t[low + 1] * part

    y, x = np.linspace(0, a.shape[0], height + 1), np.linspace(0, a.shape[1], width + 1)
    corner = between(between(total, y).T, x).T
    area = (a.shape[0] / height) * (a.shape[1] / width)
    return (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]) / area


def difference_hash(a: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a pixel of the 8 x 9 grey image darker than the one to its right? Differences under a
    millionth count as none, so that rounding decides nothing."""
    small = area_resized(grey(a), 8, 9)
    return np.packbits(small[:, 1:] - small[:, :-1] > 1e-6).tobytes().hex()


def tile(a: np.ndarray, size: int = TILE) -> np.ndarray:
    return np.clip(np.rint(area_resized(grey(a), size, size)), 0, 255).astype(np.uint8)


# --- text as media ---


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes (null: none) and these padded with spaces to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row, written to the shared folder: the payload as a P6 image, 64 pixels wide. Null and
    empty texts are one row of spaces, texts of any length as many rows as they need; repeated rows are stored each, ids may be of any type and null,
    an empty table gives an empty one, other columns are not read."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                found = [payload(x.as_py()) for x in part.column(1)]
                media = [write_netpbm(np.frombuffer(p, np.uint8).reshape(-1, UNIT // 3, 3)) for _, p in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return written(own.mapInArrow(run, schema), "media")


def features(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): what the stored bytes hold, their digests, the difference hash and the NPY tile. A null
    or unreadable image has null features, one without pixels has a null hash and tile. Repeated rows have a row each; an empty table gives an empty one."""
    schema = T.StructType(
        [
            media.schema["doc_id"], media.schema["n_bytes"], T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("tile_npy", T.BinaryType()),
        ]
    )

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        try:
            a = decode(data)
        except (ValueError, struct.error):
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None
        p = a.tobytes()
        if not a.size:
            return 0, hashlib.sha256(p).hexdigest(), zlib.crc32(p), len(data), hashlib.sha256(data).hexdigest(), None, None
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(a), npy(tile(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows = [one(x.as_py()) for x in part.column(2)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def write_tiles(featured: DataFrame, folder: str) -> None:
    """The NPY tiles of features() as a Parquet table (doc_id, tile_npy) in `folder`; images without a tile have no row."""
    featured.where("tile_npy is not null").select("doc_id", "tile_npy").write.option("compression", "zstd").mode("overwrite").parquet(folder)
