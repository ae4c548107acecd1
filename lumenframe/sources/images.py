"""Image sources: bytes in a column (PNG, baseline JPEG, BMP and PPM through zlib and numpy) and Spark's own image files.

Pixels come as rows of blue, green, red bytes. Undecodable bytes give a row with an error, not a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.cluster import ship
from lumenframe.sources.jpeg import decode_jpeg


def read_images(spark: SparkSession, path: str, keep_bad: bool = True) -> DataFrame:
    """(origin, height, width, nChannels, mode, data); an undecodable file has height -1."""
    return spark.read.format("image").option("dropInvalid", not keep_bad).load(path).select("image.*")


#: First column and row, and the steps, of the seven passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _unfilter(raw: np.ndarray, height: int, stride: int, lag: int) -> np.ndarray:
    """Rows of bytes from filtered rows; ``lag`` bytes are one pixel. All pixels of a row step together where the filter lets them."""
    out = np.zeros((height + 1, stride + lag), np.uint8)
    for y in range(height):
        kind, line, up = raw[y * (stride + 1)], raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)], out[y, lag:]
        if kind == 0:
            row = line
        elif kind == 1:
            padded = np.pad(line, (0, -stride % lag)).reshape(-1, lag)
            row = np.cumsum(padded, 0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            row = line + up
        elif kind in (3, 4):
            row = _by_pixel(int(kind), line.tolist(), up.tolist(), out[y, :stride].tolist(), lag)
        else:
            raise ValueError("a PNG row with an unknown filter")
        out[y + 1, lag:] = row
    return out[1:, lag:]


def _by_pixel(kind: int, line: list[int], up: list[int], corner: list[int], lag: int) -> list[int]:
    """The two filters whose bytes depend on the one a pixel before: plain integers, several times as fast as numpy scalars."""
    row = [0] * lag
    if kind == 3:
        for i, v in enumerate(line):
            row.append((v + (row[i] + up[i] >> 1)) & 255)
        return row[lag:]
    for i, v in enumerate(line):
        a, b, c = row[i], up[i], corner[i]
        p, q = b - c, a - c
        r = abs(p + q)
        p, q = abs(p), abs(q)
        row.append((v + (a if p <= q and p <= r else b if q <= r else c)) & 255)
    return row[lag:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """height x width x channels samples from rows of bytes; of 16 bits the upper 8."""
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, :, None].astype(np.uint8)


def decode_png(blob: bytes) -> np.ndarray:
    """Any PNG to height x width x 3, in blue, green, red; transparency is left out."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette, header = 8, [], None, None
    while at + 8 <= len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(blob[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None or not packed:
        raise ValueError("a PNG without a header or pixels")
    width, height, depth, color, _, _, interlace = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color, 0)
    if not channels or depth not in (1, 2, 4, 8, 16) or depth < 8 and channels > 1 or interlace > 1 or not width or not height:
        raise ValueError("a PNG header that means nothing")
    raw, used = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    px = np.zeros((height, width, channels), np.uint8)
    for x, y, step_x, step_y in PASSES if interlace else [(0, 0, 1, 1)]:
        part = px[y::step_y, x::step_x]
        if not part.size:
            continue
        stride = -(-part.shape[1] * channels * depth // 8)
        size = part.shape[0] * (stride + 1)
        if used + size > len(raw):
            raise ValueError("a PNG with too few pixels")
        rows = _unfilter(raw[used : used + size], part.shape[0], stride, max(1, channels * depth // 8))
        part[:] = _samples(rows, part.shape[1], channels, depth)
        used += size
    if color == 3:
        if palette is None or px.max() >= len(palette):
            raise ValueError("a PNG pixel without a palette entry")
        px = palette[px[:, :, 0]]
    elif channels < 3:
        grey = px[:, :, :1]
        px = np.repeat(grey if depth >= 8 else grey * (255 // ((1 << depth) - 1)), 3, 2)
    return np.ascontiguousarray(px[:, :, 2::-1])


def decode_bmp(blob: bytes) -> np.ndarray:
    """An uncompressed BMP of 24 or 32 bits."""
    if len(blob) < 54:
        raise ValueError("a BMP without a header")
    start, = struct.unpack("<I", blob[10:14])
    width, height, _, bits, packing = struct.unpack("<iiHHI", blob[18:34])
    if bits not in (24, 32) or packing not in (0, 3) or width <= 0 or not height:
        raise ValueError("a kind of BMP that is not read")
    stride = -(-width * bits // 32) * 4
    if start + stride * abs(height) > len(blob):
        raise ValueError("a BMP with too few pixels")
    rows = np.frombuffer(blob, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    px = rows.reshape(abs(height), width, bits // 8)[:, :, :3]
    return np.ascontiguousarray(px[::-1] if height > 0 else px)


def encode_png(pixels: np.ndarray) -> bytes:
    """Blue, green, red rows to PNG, for fixtures and annotated frames."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + pixels[y, :, ::-1].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_ppm(blob: bytes) -> np.ndarray:
    parts = blob.split(maxsplit=3)
    if len(parts) < 4 or parts[0] != b"P6":
        raise ValueError("not a binary PPM file")
    w, h = int(parts[1]), int(parts[2])
    body = blob[len(blob) - w * h * 3 :]
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(h, w, 3)[:, :, ::-1])


def decode_image(blob: bytes) -> np.ndarray:
    """PNG, BMP, binary PPM and baseline JPEG by their first bytes."""
    for magic, decode in ((b"P6", decode_ppm), (b"BM", decode_bmp), (b"\xff\xd8", decode_jpeg)):
        if blob[: len(magic)] == magic:
            return decode(blob)
    return decode_png(blob)


DECODED = "height int, width int, data binary, error string"


def decode_images(rows: DataFrame, column: str = "content", decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Adds height, width, data and error; bad or missing bytes give -1, -1, NULL and the reason.

    ``decoder`` takes the place of ``decode_image`` where workers have a library for more formats: bytes to height x width x 3
    in blue, green, red, or ValueError.
    """
    ship(rows.sparkSession)
    decode = decoder or decode_image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for blob in batch.column(column).to_pylist():
                try:
                    px = decode(blob or b"")
                    row = (px.shape[0], px.shape[1], px.tobytes(), None)
                except (ValueError, zlib.error, struct.error) as e:
                    row = (-1, -1, None, f"kParameterError: {e}")
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            extra = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "height", "width", "data", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {DECODED}")


def guard_empty(rows: DataFrame) -> DataFrame:
    """Detection refuses images without rows or columns."""
    bad = (F.col("height") <= 0) | (F.col("width") <= 0)
    return rows.withColumn("error", F.when(bad, F.coalesce("error", F.lit("kParameterError: empty image"))).otherwise(F.col("error")))


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, rounded; other libraries may differ by one."""
    h, w = px.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = px.astype(np.float64)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def letterboxed(px: np.ndarray, target_w: int, target_h: int) -> np.ndarray:
    """The image scaled by the smaller ratio in the middle of zeros."""
    h, w = px.shape[:2]
    scale = min(np.float32(target_w) / np.float32(w), np.float32(target_h) / np.float32(h))
    nw, nh = int(np.float32(w) * scale), int(np.float32(h) * scale)
    out = np.zeros((target_h, target_w, 3), np.uint8)
    if nw and nh:
        top, left = (target_h - nh) // 2, (target_w - nw) // 2
        out[top : top + nh, left : left + nw] = resize(px, nw, nh)
    return out


def input_tensor(px: np.ndarray, half: bool = False) -> np.ndarray:
    """Red, green and blue planes in [0, 1], in single or half precision."""
    planes = px[:, :, ::-1].transpose(2, 0, 1).astype(np.float32) / np.float32(255)
    return planes.astype(np.float16) if half else planes
