"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles and difference hashes.

Images live in a binary column of a Parquet table. ``tile_images`` reads the
stored bytes back, decodes them, resizes by integral images, and returns each
image's tile as NPY bytes with its difference hash.

``text_payload`` turns a text column into images that hold its UTF-8 bytes
without loss: rows of 64 samples, padded with bytes 0. A null or empty text is
one row of zeros. ``tile_images`` lets all other columns pass, but those called like
its own results; ``text_media`` reads doc_id and text alone.

An image that is null, corrupt, of no size or of an unknown form has a row whose
results are null but for the size and digest of its bytes. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.storage import materialize, ref

WIDTH = 64
TILES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\S+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, 8 or 16 bits: an array of height x width, or height x width x 3."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("truncated Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = (*numbers, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * channels
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:count]
        flat = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:count], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if len(flat) != count or not count:
        raise ValueError("truncated or empty Netpbm samples")
    flat = flat.astype(np.uint16 if top > 255 else np.uint8, copy=False)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey image, uncompressed, with its palette; rows bottom up, padded to 4 bytes."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 bits (through its palette), 24 or 32 bits; grey palettes give one channel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, info = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported or empty BMP")
    used = struct.unpack_from("<I", data, 46)[0] or 1 << min(depth, 8)
    step = depth // 8
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)
    if depth < 8:  # several samples a byte, the highest bits first
        rows = np.unpackbits(rows, axis=1).reshape(abs(height), -1, depth) @ (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))
    rows = rows[:, : width * max(step, 1)]
    rows = rows[::-1] if height > 0 else rows
    if depth <= 8:
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + info).reshape(-1, 4)[:, :3]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][rows]
        return palette[:, ::-1][rows]
    return rows.reshape(abs(height), width, step)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target sample covers, from the integral image.

    The integral image is wanted at the rows that hold a target edge alone, so
    it is summed between those rows: memory follows the target, not the source.
    """
    h, w = samples.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    rows = np.unique(np.concatenate(([0], y0, y0 + 1)))
    inner = rows[rows < h]
    sums = np.add.reduceat(samples, inner, axis=0, dtype=np.int64)
    integral = np.zeros((len(rows) if rows[-1] == h else len(rows) + 1, w + 1))
    integral[1:, 1:] = np.cumsum(np.cumsum(sums, axis=0), axis=1)[: len(integral) - 1]
    at = np.searchsorted(rows, y0)
    fy = (ys - y0)[:, None]
    lines = integral[at] * (1 - fy) + integral[at + 1] * fy
    fx = xs - x0
    points = lines[:, x0] * (1 - fx) + lines[:, x0 + 1] * fx
    cell = np.diff(np.diff(points, axis=0), axis=1)
    return cell / (np.diff(ys)[:, None] * np.diff(xs)[None, :])


def grey(samples: np.ndarray) -> np.ndarray:
    if samples.ndim == 2:
        return samples
    return (samples.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def difference_hash(samples: np.ndarray, side: int = 8) -> str:
    """side*side bits: is a sample of the resized grey image darker than its right neighbour?"""
    small = np.rint(area_resize(grey(samples), side, side + 1) * 256).astype(np.int64)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def text_payload(text: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """(UTF-8 length, binary PGM image of ``width`` columns) of a text column; native."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw).cast("long")
    rows = F.greatest(F.ceil(n / F.lit(width)), F.lit(1)).cast("long")
    head = F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n"))
    body = F.call_function("rpad", raw, (rows * width).cast("int"), F.lit(b"\x00"))
    return n, F.concat(F.encode(head, "UTF-8"), body)


def tiled(media: bytes | None, side: int) -> tuple:
    """TILES of one image but its n_bytes."""
    if media is None:
        return (None,) * 7
    stored = (len(media), hashlib.sha256(media).hexdigest())
    try:
        samples = decode(media)
        tile = np.clip(np.rint(area_resize(grey(samples), side, side)), 0, 255).astype(np.uint8)
    except (ValueError, IndexError, OverflowError, struct.error):  # no image that can be read
        return (None, None, None, *stored, None, None)
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, difference_hash(samples), npy(tile))


def tile_images(images: DataFrame, side: int = 16) -> DataFrame:
    """images: key columns, then n_bytes and media. Adds TILES to the key columns; media itself is dropped."""
    tiles = [x.split()[0] for x in TILES.split(", ")]
    keys = [f for f in images.schema.fields if f.name not in (*tiles, "media")]
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, out = batch.column("n_bytes").to_pylist(), []
            for n, media in zip(lengths, batch.column("media")):
                out.append((n, *tiled(media.as_py(), side)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.record_batch([*(batch.column(c) for c in plain), *columns], [*plain, *tiles])

    plain = [f"key{i}" for i in range(len(names))]  # Arrow functions do not take names with dots
    schema = ", ".join([*(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, keys)), TILES])
    rows = images.select(*[F.col(ref(n)).alias(p) for n, p in zip(names, plain)], "n_bytes", "media")
    return rows.mapInArrow(run, schema).toDF(*names, *tiles)


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as an image, read it back, and tile it: doc_id and TILES."""
    n, media = text_payload(F.col("text"))
    stored = materialize(docs.select("doc_id", n.alias("n_bytes"), media.alias("media")), "media")
    return materialize(tile_images(stored), "tiles")
