"""Media columns: lossless PNG samples in binary columns, and hashes of their low frequencies.

A PNG is a signature and chunks, each with its length, type, data and CRC-32. Samples are 8-bit grey, ``WIDTH`` to a
row; a row is filtered (none, sub or up, whichever has the least sum of absolute differences), rows are deflated. The
reader tests every checksum and undoes all five filters, with whole-image numpy operations for the first three.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """8-bit grey PNG of a (height, width) array of uint8."""
    height, width = samples.shape
    options = np.zeros((3, height, width), np.uint8)
    options[NONE] = samples
    options[SUB] = samples
    options[SUB, :, 1:] -= samples[:, :-1]
    options[UP] = samples
    options[UP, 1:] -= samples[:-1]
    cost = np.minimum(options, -options).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)  # ties: the lowest filter
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = options[kind, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) of each chunk up to IEND; a wrong signature, length or checksum raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no IEND")


def read_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of an 8-bit grey PNG without interlace; anything else raises ValueError."""
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in chunks(data):
        parts.setdefault(kind, []).append(body)
    width, height, *form = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("not 8-bit grey without interlace")
    raw = zlib.decompress(b"".join(parts[b"IDAT"]))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if (kind > PAETH).any():
        raise ValueError("unknown filter")
    out = rows.copy()
    sub = kind == SUB
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    if (kind < AVERAGE).all():
        # A run of up rows adds to the row before it: sums from each run's start, modulo 256.
        up = kind == UP
        if up.any():
            total = np.cumsum(out, axis=0, dtype=np.uint8)
            start = np.maximum.accumulate(np.where(up, 0, np.arange(len(out))))
            out = total - np.where((start > 0)[:, None], total[start - 1], 0).astype(np.uint8)
        return out
    above = np.zeros(rows.shape[1], np.uint8)
    for y in range(len(out)):
        if kind[y] == UP:
            out[y] += above
        elif kind[y] in (AVERAGE, PAETH):
            left = corner = 0
            for x in range(rows.shape[1]):
                b = int(above[x])
                if kind[y] == AVERAGE:
                    guess = (left + b) // 2
                else:
                    # the nearest of the three to left + above - corner; ties: left, above, corner
                    p = left + b - corner
                    guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                left, corner = (int(rows[y, x]) + guess) & 255, b
                out[y, x] = left
        above = out[y]
    return out


@lru_cache
def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def _shrink(samples: np.ndarray, n: int) -> np.ndarray:
    """Means over n bands of rows, each at least one row high, and n bands of columns."""
    for axis in (0, 1):
        size = samples.shape[axis]
        starts = np.arange(n) * size // n
        stops = np.maximum((np.arange(1, n + 1) * size) // n, starts + 1)
        total = np.cumsum(samples, axis=axis, dtype=np.float64)
        total = np.concatenate((np.zeros_like(total.take([0], axis)), total), axis)
        width = (stops - starts).reshape((-1, 1) if axis == 0 else (1, -1))
        samples = (total.take(stops, axis) - total.take(starts, axis)) / width
    return samples


def cosine_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> str:
    """``low * low`` bits in hex: which low frequencies of the shrunk image lie above their median (without the mean)."""
    c = _cosines(side, low)
    wave = np.round(c @ _shrink(samples, side) @ c.T, 6).ravel()
    bits = wave > np.median(wave[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of ``WIDTH``."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


MEDIA_SCHEMA = "n_bytes long, media binary"
FEATURE_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _columns(df: DataFrame, keep) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)


def media_column(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), level: int = 1) -> DataFrame:
    """``keep``, n_bytes, media: each whole text as a PNG in a binary column. A null text is an empty one (64 zeros).

    Rows are handled one by one: repeated rows and null ids stay, other columns don't enter the result.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            for i in range(0, len(batch), 256):
                part = [t.as_py() or "" for t in texts.slice(i, 256)]
                media = [write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH), level) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, 256) for k in keep),
                        pa.array([len(t.encode()) for t in part], pa.int64()),
                        pa.array(media, pa.binary()),
                    ],
                    names=[*keep, "n_bytes", "media"],
                )

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"{_columns(docs, keep)}, {MEDIA_SCHEMA}")


def media_features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and what the stored bytes hold, read back: payload size and digests, media digest, cosine hash.

    A null medium gives nulls; a damaged one raises.
    """

    def of(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        samples = read_png(data)
        stored = samples.tobytes()
        return (
            len(stored),
            hashlib.sha256(stored).hexdigest(),
            zlib.crc32(stored[-WIDTH:]),
            len(data),
            hashlib.sha256(data).hexdigest(),
            cosine_hash(samples),
        )

    def run(batches):
        names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            found = [of(x.as_py()) for x in batch.column("media")]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], names=[*keep, *names])

    return media.select(*keep, "media").mapInArrow(run, f"{_columns(media, keep)}, {FEATURE_SCHEMA}")
