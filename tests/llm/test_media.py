import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loomline.llm import media as M


def brute_unfilter(kind, rows):
    out = []
    for y, k in enumerate(kind.tolist()):
        row = []
        for x, v in enumerate(rows[y].tolist()):
            a = row[x - 1] if x else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - 1] if x and y else 0
            p = a + b - c
            near = min(((abs(p - a), 0), (abs(p - b), 1), (abs(p - c), 2)))[1]
            row.append((v + [0, a, b, (a + b) // 2, (a, b, c)[near]][k]) % 256)
        out.append(row)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("top", [3, 5])
def test_unfilter_equals_the_definition(top):
    g = np.random.default_rng(top)
    kind, rows = g.integers(0, top, 60), g.integers(0, 256, (60, 17), dtype=np.uint8)
    assert (M.unfilter(kind.astype(np.uint8), rows) == brute_unfilter(kind, rows)).all()


def test_round_trip_and_checksums():
    g = np.random.default_rng(1)
    for samples in (g.integers(0, 256, (9, 64), dtype=np.uint8), np.cumsum(np.ones((70, 64), np.uint8), 0, np.uint8)):
        data = M.write_png(samples)
        assert (M.read_png(data) == samples).all()
        for bad in (data[:-1], data[:40] + bytes((data[40] ^ 1,)) + data[41:], b"x" + data[1:], data[:-12]):
            with pytest.raises((ValueError, zlib.error, struct.error)):
                M.read_png(bad)


def test_hash_follows_the_picture():
    y, x = np.mgrid[0:64, 0:64]
    a = (128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 13)).astype(np.uint8)
    b = np.clip(a.astype(int) + 4, 0, 255).astype(np.uint8)
    other = (128 + 100 * np.sin(x / 3 + y / 5)).astype(np.uint8)
    bits = lambda p: int(M.cosine_hash(p), 16)
    assert bin(bits(a) ^ bits(b)).count("1") <= 4 < bin(bits(a) ^ bits(other)).count("1")


def test_columns_of_documents(spark):
    r = random.Random(1)
    texts = [None, "", "a", "x" * 64, "é" * 33, "ab\n" * 5000, "".join(chr(r.randint(1, 0x2FFF)) for _ in range(999)), "a"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {x.doc_id: x for x in M.media_features(M.media_column(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        g = got[i]
        assert (g.n_bytes, g.payload_bytes) == (len(raw), len(want))
        assert g.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert g.tail_crc32 == zlib.crc32(want[-64:])
    assert got[2].asDict() | {"doc_id": 7} == got[7].asDict() | {"doc_id": 7}
    assert M.media_features(M.media_column(df.limit(0))).count() == 0
