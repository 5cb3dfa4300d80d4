import struct
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import media


def pgm(a, kind="P5"):
    h, w = a.shape[:2]
    head = f"{kind}\n# a comment\n{w} {h}\n"
    if kind not in ("P1", "P4"):
        head += "255\n"
    if kind in ("P5", "P6"):
        return head.encode() + a.astype(np.uint8).tobytes()
    if kind == "P4":
        return head.encode() + np.packbits(1 - a, axis=1).tobytes()
    if kind == "P1":
        return head.encode() + " ".join(str(1 - x) for x in a.ravel()).encode()
    return head.encode() + " ".join(map(str, a.ravel())).encode()


@pytest.mark.parametrize("kind", ["P1", "P2", "P3", "P4", "P5", "P6"])
def test_netpbm(kind):
    rng = np.random.default_rng(1)
    shape = (5, 11, 3) if kind in ("P3", "P6") else (5, 11)
    a = rng.integers(0, 2 if kind in ("P1", "P4") else 256, shape)
    assert np.array_equal(media.decode(pgm(a, kind)), a)


@pytest.mark.parametrize("width", [1, 3, 4, 64])
def test_bmp_round_trip(width):
    a = np.random.default_rng(2).integers(0, 256, (7, width), dtype=np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(a)), a)


def test_bad_images():
    for data in (b"", b"P5\n4 4\n255\nxx", b"GIF89a", b"BM"):
        with pytest.raises(Exception):
            media.decode(data)


@pytest.mark.parametrize("shape", [(1, 64), (2, 64), (9, 64), (100, 64), (7, 5)])
def test_area_resize_against_supersampling(shape):
    a = np.random.default_rng(3).integers(0, 256, shape, dtype=np.uint8)
    h, w = 8, 9
    big = np.kron(a.astype(float), np.ones((h, w)))  # every target cell is whole samples of this
    want = big.reshape(h, shape[0], w, shape[1]).mean((1, 3))
    assert np.allclose(media.area_resize(a, h, w), want)


def test_text_media(hard, clashing):
    texts = {}
    for r in hard.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    rows = media.text_media(clashing).collect()
    assert len(rows) == hard.count()
    features = {}
    for r in rows:
        raws = {t.encode() for t in texts[r["doc_id"]]}
        raw = next(x for x in raws if len(x) == r["n_bytes"])
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        image = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
        assert r["media_bytes"] == len(image) and r["media_sha256"] == hashlib.sha256(image).hexdigest()
        assert np.load(io.BytesIO(r["tile"])).shape == (16, 16)
        assert features.setdefault(raw, r["feature"]) == r["feature"] and len(r["feature"]) == 16


def test_tiles_keep_other_columns(spark):
    a = np.arange(256, dtype=np.uint8).reshape(16, 16)
    df = spark.createDataFrame([("x", 256, bytearray(media.encode_bmp(a))), ("y", 256, bytearray(pgm(a)))], "name string, n_bytes long, media binary")
    one, two = media.tile_images(df).orderBy("name").collect()
    assert (one["payload_sha256"], one["feature"], one["tile"]) == (two["payload_sha256"], two["feature"], two["tile"])
    assert np.array_equal(np.load(io.BytesIO(one["tile"])), a)


def test_empty(empty):
    assert media.text_media(empty).count() == 0
    assert media.text_media(empty.select("doc_id", F.col("text"))).columns[0] == "doc_id"


def test_unreadable_images_have_null_results(spark):
    good = media.encode_bmp(np.arange(48, dtype=np.uint8).reshape(6, 8))
    bad = [None, b"", b"P5", b"P5 4 4 255\n123", b"BM" + b"x" * 20, b"P5 0 0 255\n", b"P2 2 2 255 a b c d", b"P5 9999999 9999999 255\n1", good[:60], b"\x89PNG...."]
    rows = [(i, "own", x) for i, x in enumerate([good, *bad])]
    df = spark.createDataFrame(rows, "id long, `a.b` string, media binary").withColumn("n_bytes", F.lit(3).cast("long"))
    got = {r["id"]: r for r in media.tile_images(df).collect()}
    assert got[0]["payload_bytes"] == 48 and got[0]["feature"] and got[0]["a.b"] == "own"
    for i, x in enumerate(bad, 1):
        assert got[i]["payload_bytes"] is got[i]["feature"] is got[i]["tile"] is None
        assert got[i]["media_bytes"] == (None if x is None else len(x))


@pytest.mark.parametrize("depth", [1, 4])
def test_bmp_of_few_bits(depth):
    rng = np.random.default_rng(depth)
    samples = rng.integers(0, 1 << depth, (5, 13))
    bits = np.unpackbits(samples.astype(np.uint8)[..., None], axis=2)[..., 8 - depth :].reshape(5, -1)
    stride = (13 * depth + 31) // 32 * 4
    rows = np.packbits(np.pad(bits, ((0, 0), (0, stride * 8 - bits.shape[1]))), axis=1)[::-1]
    palette = b"".join(bytes([v * 15, v * 15, v * 15, 0]) for v in range(1 << depth))
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, 13, 5, 1, depth, 0, rows.size, 0, 0, 0, 0)
    assert (media.decode(head + palette + rows.tobytes()) == samples * 15).all()
