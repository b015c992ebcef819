"""Quality classifier: Naive Bayes support vectors.

A text is the set of its hashed n-grams: byte 4-grams, and 1- to 4-grams of word shapes (which kinds of characters a
word has, its length class, whether it repeats the word before, whether a line ends after it). Each indicator is scaled
by the log ratio of its counts in the two classes, vectors have unit length, and a linear model with hinge loss is fitted
by dual coordinate descent. Margins become scores through a logistic curve fitted on margins of held-back folds.

The fit sees at most ``per_class`` labelled documents of either class, the smallest by a hash of their id, and of these
so many that their features take ``class_bytes`` at most; the result is two tables of ``2**BITS`` numbers. Scoring covers whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 18
DIM = 1 << BITS

# Bits of a byte's kind: letter in lower case (or beyond ASCII), upper case, digit, sentence mark, other sign, line end.
KIND = np.full(256, 16, np.uint16)
KIND[128:] = 1
for chars, bit in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 4), (b".,;:'\"()-?", 8), (b" \t\x0b\x0c", 0), (b"\n\r", 32)):
    KIND[list(chars)] = bit
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
_RANDOM = np.random.default_rng(20240229)
POWERS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
MIX = (_RANDOM.integers(1, 1 << 31, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * MIX[8 + salt]
    return (x ^ (x >> np.uint32(13))) * MIX[15] >> np.uint32(32 - BITS)


class Extractor:
    """Distinct feature numbers of a text; an empty text has the one feature of nothing."""

    def __init__(self):
        self.seen = np.zeros(DIM, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode(), np.uint8)
        parts = []
        if len(b) >= 4:
            c = b.astype(np.uint32)
            parts.append(_bucket(c[:-3] * MIX[0] + c[1:-2] * MIX[1] + c[2:-1] * MIX[2] + c[3:] * MIX[3], 0))
        blank = BLANK[b]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        if len(starts):
            kind = np.bitwise_or.reduceat(KIND[b], starts).astype(np.uint32)
            place = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))[: len(b)] if starts[0] == 0 else None
            if place is None:
                place = np.arange(len(b)) - np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(b)))))
            letter = b.astype(np.uint64)
            letter[blank] = 0
            word = np.add.reduceat(letter * POWERS[place & 63], starts)
            size = np.add.reduceat((~blank).astype(np.int64), starts)
            same = np.concatenate(([False], word[1:] == word[:-1])).astype(np.uint32)
            shape = kind | same << np.uint32(6) | np.digitize(size, (2, 4, 13)).astype(np.uint32) << np.uint32(7)
            gram = shape + np.uint32(1)
            for n in range(1, 5):
                if n > 1:
                    if len(shape) < n:
                        break
                    gram = gram[:-1] * MIX[4] + shape[n - 1 :] + np.uint32(1)
                parts.append(_bucket(gram, n))
        if not parts:
            return np.zeros(1, np.int32)
        idx = np.concatenate(parts)
        order = np.arange(len(idx))
        self.seen[idx] = order
        return idx[self.seen[idx] == order].astype(np.int32)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # fitted weight of each scaled feature
    bias: float
    slope: float
    offset: float

    def margin(self, idx: np.ndarray) -> float:
        r = self.ratio[idx]
        norm = float(np.sqrt(np.square(r).sum())) or 1.0
        return float((r * self.weight[idx]).sum()) / norm + self.bias

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx) + self.offset, -500, 500))))


def count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIM), alpha)
    for idx, y in zip(rows, labels.tolist(), strict=True):
        counts[y, idx] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, rounds: int, tol=1e-3):
    """Weights and bias that minimise ``|w|^2 / 2 + sum c_i max(0, 1 - y_i (w x_i + bias))`` (the bias counts in |w|)."""
    w, bias = np.zeros(DIM), 0.0
    a = np.zeros(len(rows))
    diagonal = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            slack = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(a[i] - slack / diagonal[i], 0.0), c[i])
            if step := new - a[i]:
                worst = max(worst, abs(step))
                a[i] = new
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
        if worst < tol:
            break
    return w, bias


def _fit(rows: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int) -> Model:
    ratio = count_ratios(rows, labels)
    values = []
    for idx in rows:
        v = ratio[idx]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    n = np.bincount(labels, minlength=2)
    c = cost * len(labels) / (2 * n[labels])
    w, bias = dual_descent(rows, values, 2.0 * labels - 1, c, rounds)
    return Model(ratio, w, bias, 1.0, 0.0)


def logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve that gives the labels' likelihood; a small penalty keeps the slope finite."""
    x = np.stack((margins, np.ones_like(margins)), axis=1)
    t = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (p - labels) + np.array([1e-2, 1e-3]) * t
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hess, grad)
        t -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(t[0]), 1e-3), float(t[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 20, folds: int = 3) -> Model:
    """A model of rows of feature numbers and 0/1 labels. With fewer than ``folds`` rows in a class the score is a constant,
    the share of label 1."""
    labels = np.asarray(labels, np.int64)
    n = np.bincount(labels, minlength=2)
    if n.min() < folds:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    model = _fit(rows, labels, cost, rounds)
    margins = np.zeros(len(rows))
    for k in range(folds):
        held = np.arange(len(rows)) % folds == k
        other = _fit([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], cost, rounds)
        margins[held] = [other.margin(rows[i]) for i in np.flatnonzero(held)]
    model.slope, model.offset = logistic(margins, labels)
    return model


def held_out(id_col: str):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 2500,
    class_bytes: int = 128 << 20,
) -> Model:
    """Fit on labelled rows that aren't held out: per class at most ``per_class``, the first by a hash of the id, as long as
    their features fit ``class_bytes`` (the first always does).

    An id that has several texts counts with one of them (the smallest by its md5), an id with both labels with either.
    Null ids and labels other than 0 and 1 are left out, a null text is an empty one; without rows the score is a half.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")
    )
    order = (F.xxhash64("__id"), "__id")
    some = known.where("__y = 1").orderBy(*order).limit(per_class).unionByName(
        known.where("__y = 0").orderBy(*order).limit(per_class)
    )
    some = some.distinct()
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    one = texts.join(F.broadcast(some.select("__id").distinct()), "__id", "left_semi")
    one = one.groupBy("__id").agg(F.min(F.struct(F.md5("__t").alias("d"), F.col("__t").alias("t")))["t"].alias("__t"))
    chosen = one.join(F.broadcast(some), "__id").withColumn("__o", F.xxhash64("__id")).select("__id", "__o", "__t", "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            found = [extract(t.as_py()).tobytes() for t in batch.column("__t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").cast(pa.string()), batch.column("__o"), batch.column("__y"), pa.array(found, pa.binary())],
                names=["i", "o", "y", "x"],
            )

    rows = chosen.mapInArrow(run, "i string, o long, y int, x binary")
    before = Window.partitionBy("y").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("b", F.sum(F.octet_length("x")).over(before)).withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("o", "i")))
    got = rows.where((F.col("b") <= class_bytes) | (F.col("k") == 1)).select("i", "y", "x").collect()
    got.sort(key=lambda r: (r.i, r.y))
    return fit([np.frombuffer(r.x, np.int32) for r in got], np.array([r.y for r in got], np.int64))


def score(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    threshold: float = 0.5,
) -> DataFrame:
    """One row per document: id, ``keep``, held_out, score, predicted (1 if score >= ``threshold``).

    A null text is an empty one; both have a score. Rows are scored one by one: repeated rows and null ids stay. Columns
    other than ``keep`` don't enter the result, and none but the text enters the score.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two tables of 2**BITS numbers
    names = [f"__k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, fitted = Extractor(), shared.value
        for batch in batches:
            found = [fitted.score(extract(t.as_py() or "")) for t in batch.column("__t")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ["__id", "__h", *names]), pa.array(found, pa.float64())],
                names=["__id", "__h", *names, "__s"],
            )

    rows = docs.select(
        F.col(id_col).alias("__id"),
        held_out(id_col).alias("__h"),
        *[F.col(k).alias(a) for k, a in zip(keep, names, strict=True)],
        F.col(text_col).alias("__t"),
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, __s double").select(
        F.col("__id").alias(id_col),
        *[F.col(a).alias(k) for k, a in zip(keep, names, strict=True)],
        F.col("__h").alias("held_out"),
        F.col("__s").alias("score"),
        (F.col("__s") >= threshold).cast("int").alias("predicted"),
    )
