"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays.

Images are resized by area with integral images, so that the cost of a resize does not depend on the scale, and written
as NPY tiles next to a 64-bit difference hash.

The registered query stores each text as the samples of a grey image 64 pixels wide in a Parquet table of media, reads that
table back, stores hashes and tiles next to it, and reads those back too; everything comes from what it has read.

Defined cases: a null text is empty, and an empty payload is padded to one row of zeros; texts of any length are one image
each; equal texts give equal values and repeated rows stay; an empty table gives an empty result; other columns are not read
and may have any name. A file that is no
image of these formats raises ValueError.
"""

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

from codeloom.llm.common import materialize, slices

WIDTH = 64
#: Side of the NPY tile.
TILE = 16


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Uncompressed BMP, 8-bit with a grey palette or 24-bit; rows from the bottom up, padded to 4 bytes."""
    h, w = samples.shape[:2]
    colour = samples.ndim == 3
    row = np.ascontiguousarray(samples[::-1, :, ::-1] if colour else samples[::-1]).reshape(h, -1)
    body = np.pad(row, ((0, 0), (0, -row.shape[1] % 4))).tobytes()
    palette = b"" if colour else b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if colour else 8, 0, len(body), 2835, 2835, 0 if colour else 256, 0) + palette + body


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    need = 2 if kind in (1, 4) else 3
    while len(fields) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h = fields[:2]
    top = fields[2] if need == 3 else 1
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = int(np.prod(shape))
    if kind == 1:
        flat = np.frombuffer(bytes(x for x in data[at:] if x in b"01"), np.uint8)[:n] - 48
    elif kind in (2, 3):
        flat = np.array(data[at:].split()[:n], dtype=np.uint16)
    elif kind == 4:
        bits = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        flat = np.unpackbits(bits, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if kind in (1, 4):
        flat = 1 - flat  # 1 is black there
    if flat.size != n:
        raise ValueError("Netpbm samples are missing")
    return flat.reshape(shape).astype(np.uint8 if top < 256 else np.uint16, copy=False)


def _bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * step, start).reshape(abs(h), step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return np.ascontiguousarray(rows.reshape(abs(h), w, 3)[:, :, ::-1])
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if len(palette) == 256 and (palette == np.arange(256)[:, None]).all():
        return np.ascontiguousarray(rows)
    if len(palette) and (palette == palette[:, :1]).all():
        return palette[rows, 0]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm (P1 to P6) or BMP file: rows by columns, and by 3 for colour."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where m equal cells begin and end on an axis of n samples: whole sample and fraction."""
    x = np.arange(m + 1) * (n / m)
    i = np.minimum(x.astype(np.int64), n - 1)
    return i, x - i


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell of a height by width grid, from the integral image read at fractional places by interpolation.

    Of the integral image only the rows at the edges of cells are made, so memory does not grow with the image.
    """
    h, w = image.shape[:2]
    flat = image.reshape(h, -1)
    i, f = _edges(h, height)
    begin = np.unique(np.append(i, 0))
    above = np.zeros((len(begin), flat.shape[1]))
    np.cumsum(np.add.reduceat(flat, begin, axis=0, dtype=np.float64)[:-1], axis=0, out=above[1:])
    rows = above[np.searchsorted(begin, i)] + flat[i] * f[:, None]
    if image.ndim == 3:
        rows = rows.reshape(len(rows), w, -1).mean(axis=2)
    rows = np.cumsum(np.pad(rows, ((0, 0), (1, 0))), axis=1)
    i, f = _edges(w, width)
    both = rows[:, i] * (1 - f) + rows[:, i + 1] * f
    cells = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return cells * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: whether each of 8 by 8 cells is darker than its right neighbour."""
    small = np.rint(resize_area(image, 8, 9) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    tile = np.clip(np.rint(resize_area(image, side, side)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, allow_pickle=False)
    return out.getvalue()


def to_image(text: bytes, kind: str = "pgm", width: int = WIDTH) -> bytes:
    """A grey image whose samples are the bytes, padded with zeros to whole rows, one row at least."""
    padded = text + bytes(-len(text) % width if text else width)
    samples = np.frombuffer(padded, np.uint8).reshape(-1, width)
    return {"pgm": encode_pgm, "bmp": encode_bmp}[kind](samples)


def store(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and media: each text as an image file in a binary column."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_image(x, kind) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(make, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """stored plus samples digests, tile (NPY) and hash, all from the decoded image; media itself is left out."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for data in b.column(2):
                data = data.as_buffer()
                raw = data.to_pybytes()
                image = decode(raw)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), npy_tile(image), difference_hash(image)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    media = materialize(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd")
    got = materialize(features(media), "media-tiles", "zstd")
    feature = F.concat_ws(":", "dhash", F.sha2("tile", 256))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
