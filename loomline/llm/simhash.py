"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

Equal fingerprints are one point. Top trees of vantage points and distances, fitted on a bounded sample, cut the points
into shards; shards above a limit are cut again by samples of their own, and those that no distance parts (see
``partition``) go in blocks. Of ``radius`` differing bits at most half are in one half of the fingerprint: so there are
two top trees, each with the distance over one half and half the radius, whose borders hold far fewer points than those
of one tree over all bits. In each shard a task builds the lower tree over all its points and bits. A point farther than the median
from a vantage point belongs outside; by the triangle inequality a partner on the inner side is at most ``radius``
nearer, so a point that is outside by no more than ``radius`` is also sent inside. Two linked points therefore meet in
some leaf, at every level, whatever the sample was: the sample only balances. Leaves compare exactly and give links to
their components' smallest points, so a dense group costs a link a point, not a link a pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import connected_components, staged
from loomline.llm.partition import in_blocks, split_until_small

LEAF = 512
#: A split counts if its larger side holds at most this share of the points.
LARGEST = 0.9


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; words are what ASCII white space separates, A-Z in lower case.

    Fewer words than a shingle are one shingle; no word gives 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, seed) for s in joined], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` and fp (the fingerprint's bits as a long). A null text has no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("__text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"]
            )

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, fp long")


ALL_BITS = np.uint64(2**64 - 1)
#: The bits that the top trees look at; a tree's root has the number of halves plus its own.
HALVES = (np.uint64(2**32 - 1), np.uint64(2**64 - 2**32))


def _far(points: np.ndarray, pivot: np.uint64, bits: np.uint64 = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((points ^ pivot) & bits)


def split(points: np.ndarray, radius: int, tries: int = 4, bits: np.uint64 = ALL_BITS) -> tuple[np.uint64, int] | None:
    """A vantage point among the points, and the distance that leaves the least points on the larger side (which, inside,
    has the border's too). None where that is nearly all."""
    best = None
    for pivot in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        within = np.cumsum(np.bincount(_far(points, pivot, bits), minlength=65 + radius))
        inner, outer = within[radius : 64 + radius], len(points) - within[:64]
        larger = np.maximum(inner, outer)
        cut = int(np.lexsort((inner + outer, larger))[0])
        if larger[cut] <= LARGEST * len(points) and (best is None or larger[cut] < best[0]):
            best = (larger[cut], pivot, cut)
    return best and (best[1], best[2])


class TopTree:
    """The shards: vantage points and distances from a sample of ``share`` points to one. Nodes are numbered as in a heap.

    A node is split while it stands for more than ``limit`` points and has enough of the sample to tell. Points within
    ``radius`` of one another, over ``bits``, meet in a shard.
    """

    def __init__(
        self, sample: np.ndarray, share: float, limit: float, radius: int, root: int = 1, bits: np.uint64 = ALL_BITS, least: int = 32
    ):
        self.radius, self.root, self.bits = radius, root, bits
        self.nodes: dict[int, tuple[np.uint64, int]] = {}
        todo = [(root, sample)]
        while todo:
            node, points = todo.pop()
            if len(points) * share > limit and len(points) >= least and (found := split(points, radius, bits=bits)):
                self.nodes[node] = found
                d = _far(points, found[0], bits)
                todo += [(2 * node, points[d <= found[1] + radius]), (2 * node + 1, points[d > found[1]])]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, shard): every shard in which a point must be seen."""
        out_i, out_s = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if node not in self.nodes:
                out_i.append(idx)
                out_s.append(np.full(len(idx), node, np.int64))
                continue
            pivot, cut = self.nodes[node]
            d = _far(points[idx], pivot, self.bits)
            todo += [(2 * node, idx[d <= cut + self.radius]), (2 * node + 1, idx[d > cut])]
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_i), np.concatenate(out_s)


def links(points: np.ndarray, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(point, smaller point) links that join all points within ``radius`` of one another, directly or over others."""
    found_a, found_b = [], []
    todo = [np.unique(points)]
    while todo:
        part = todo.pop()
        if len(part) > leaf and (cut := split(part, radius)):
            d = _far(part, cut[0])
            todo += [part[d <= cut[1] + radius], part[d > cut[1]]]
            continue
        if len(part) <= leaf:
            near = np.bitwise_count(part[:, None] ^ part) <= radius
            near[np.arange(len(part)), np.arange(len(part))] = False
            rest = part[near.any(axis=1)]  # most leaves have no link
        else:
            rest = part
        # Walk from point to point; each step looks only at what hasn't been reached.
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            front = [root]
            while front and len(rest):
                near = _far(rest, front.pop()) <= radius
                if near.any():
                    reached = rest[near]
                    found_a.append(reached)
                    found_b.append(np.full(len(reached), root, np.uint64))
                    front += list(reached)
                    rest = rest[~near]
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_links(points: DataFrame, radius: int, per_shard: int = 10_000, sample: int = 8192) -> DataFrame:
    """Links (a, b) between different fingerprints of ``points(fp)`` that give its components at ``radius`` or less."""
    n = points.count()
    some = points.orderBy(F.xxhash64("fp")).limit(sample).collect() if n > per_shard else []
    goal = 0.7 * per_shard  # a sample's estimate may be too low
    fitted, share, half = np.array([r.fp for r in some], np.int64).view(np.uint64), n / max(1, len(some)), radius // len(HALVES)
    trees = [TopTree(fitted, share, goal, half, len(HALVES) + k, bits) for k, bits in enumerate(HALVES)]
    if not any(t.nodes for t in trees):
        trees = [TopTree(fitted, share, goal, radius)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for tree in trees:
                i, shard = tree.route(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[i])], names=["shard", "fp"])

    def fit(pdf: pd.DataFrame, share: int) -> bytes | None:
        shard, sampled = int(pdf["shard"].iloc[0]), _bits(pdf["fp"])
        top = shard >> max(0, shard.bit_length() - len(HALVES).bit_length())
        for bits, near in ((HALVES[top - len(HALVES)], half), (ALL_BITS, radius)) if top >= len(HALVES) else ((ALL_BITS, radius),):
            own = TopTree(sampled, share, goal, near, shard, bits)
            if own.nodes:
                return pickle.dumps(own)
        return None

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = links(_bits(pdf["fp"]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = staged(points.mapInArrow(route, "shard long, fp long"), "shards")
    rows = in_blocks(split_until_small(rows, "fp", per_shard, fit, lambda pdf, t: pickle.loads(t).route(_bits(pdf["fp"]))), "fp")
    # As many tasks as full shards: their work isn't told by their bytes.
    tasks = max(1, min(100_000, -(-rows.count() // per_shard)))
    by = ("shard", "low", "high")
    return rows.repartition(tasks, *by).groupBy(*by).applyInPandas(search, "a long, b long")


def _bits(fp: pd.Series) -> np.ndarray:
    return fp.to_numpy(np.int64).view(np.uint64)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    shingle: int = 3,
    per_shard: int = 10_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, ``keep``, fp (long), class_fp (one fingerprint of its component) and component_id (the
    smallest id reachable over links of ``radius`` or less).

    A null or empty text has fingerprint 0 and links like any other. Repeated rows each stay; a null id counts as
    larger than any other when the smallest is taken, and is null only if all of a component are. Other columns don't
    enter the result. An empty table gives an empty result.
    """
    names = ["__id", *(f"__k{i}" for i in range(len(keep)))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip((id_col, *keep), names, strict=True)], F.col(text_col).alias("__t"))
    fps = staged(fingerprints(rows, "__t", tuple(names), shingle), "fingerprints")
    points = staged(fps.groupBy("fp").agg(F.min("__id").alias("low")), "points")
    found = connected_components(near_links(points.select("fp"), radius, per_shard))
    linked = points.join(found, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    alone = points.join(found, F.col("fp") == F.col("node"), "left_anti")
    classes = linked.join(lowest, "root").select("fp", "root", "lowest")
    classes = classes.unionByName(alone.select("fp", F.col("fp").alias("root"), F.col("low").alias("lowest")))
    return fps.join(classes, "fp").select(
        *[F.col(a).alias(c) for a, c in zip(names, (id_col, *keep), strict=True)],
        "fp",
        F.col("root").alias("class_fp"),
        F.col("lowest").alias("component_id"),
    )
