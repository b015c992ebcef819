"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits along the best of a few random directions, again and again, where this leaves small and even sides; a
vector within a margin of the cut goes to both, the margin being narrower where too many would. Leaves above a limit are split again by samples of their own; what no direction parts is
dense and goes in blocks (see ``partition``). Vectors that share a leaf of some tree are compared exactly, in double
precision. Equal vectors are one point with a count.

A pair that shares several leaves counts in the first of them only, which both points' leaf lists tell: so links are
counted without a list of pairs, and a dense group gives a row a point and leaf, not a row a pair. Components come from
links to each leaf's local roots.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import connected_components, staged
from loomline.llm.partition import in_blocks, split_until_small

#: Points are dense if each split with the whole margin leaves more than this share of them on both sides.
DENSE = 0.4
#: Elsewhere the margin is narrowed until at most this share is on both sides.
BOTH = 0.16
#: Where splits are tried, as shares of the points below: first at the median, elsewhere if that leaves many on both sides.
MEDIAN, CUTS, MANY = (0.5,), (0.4, 0.6, 0.3, 0.7, 0.2, 0.8), 0.3


def unit(vector) -> np.ndarray | None:
    """The vector at unit length in double precision; None for what links with nothing."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    v = v / (np.abs(v).max() or 1.0)  # so that squares neither vanish nor overflow
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 and np.isfinite(norm) else None


def packed(vector) -> bytes:
    """The components as they came: in single precision where that loses nothing."""
    v = np.array(vector, np.float64)
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes()


def unpacked(raw, dims: int) -> np.ndarray:
    """Unit vectors of packed ones."""
    x = np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64) for r in raw], np.float64).reshape(-1, dims)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tree:
    """Directions and medians from a sample of unit vectors, one for ``share`` points. Nodes are numbered as in a heap.

    A node is split while it stands for more than ``limit`` points, has enough of the sample to tell and isn't dense,
    along the one of ``tries`` directions, and there where, both sides are smallest with ``spill`` as the margin.
    """

    def __init__(
        self, sample: np.ndarray, share: float, limit: float, spill: float, seed: int, root: int = 1, tries: int = 3, least: int = 24
    ):
        rng = np.random.default_rng([seed, root])
        self.root = root
        self.nodes: dict[int, tuple[np.ndarray, float, float]] = {}
        todo = [(root, sample)]
        while todo:
            node, points = todo.pop()
            if len(points) * share <= limit or len(points) < least:
                continue
            directions = rng.standard_normal((tries, sample.shape[1]))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            best = None
            for at in (MEDIAN, CUTS):
                if best and best[1] <= MANY:
                    break
                for along, direction in zip((points @ directions.T).T, directions, strict=True):
                    for cut in np.quantile(along, at):
                        low, high = np.mean(along <= cut + spill), np.mean(along >= cut - spill)
                        cost, both = low**2 + high**2, low + high - 1  # small and even sides
                        if both <= DENSE and max(low, high) <= 0.9 and (best is None or cost < best[0]):
                            best = (cost, both, direction, float(cut), along)
            if best is None:
                continue
            _, _, direction, cut, along = best
            margin = min(spill, float(np.quantile(np.abs(along - cut), BOTH)))
            self.nodes[node] = (direction, cut, margin)
            todo += [(2 * node, points[along <= cut + margin]), (2 * node + 1, points[along >= cut - margin])]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_i, out_leaf = [], []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if node not in self.nodes:
                out_i.append(idx)
                out_leaf.append(np.full(len(idx), node, np.int64))
                continue
            direction, cut, margin = self.nodes[node]
            along = points[idx] @ direction
            todo += [(2 * node, idx[along <= cut + margin]), (2 * node + 1, idx[along >= cut - margin])]
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_i), np.concatenate(out_leaf)


def compare(
    x: np.ndarray, n: np.ndarray, earlier: list[np.ndarray], threshold: float, part: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(links first seen here of each point, local root of each point) of a leaf's unit vectors ``x`` with counts ``n``.

    ``earlier`` are the points' leaves before this one. With ``part``, only pairs of different parts count. Pairs are
    looked at in blocks; no list of pairs is made.
    """
    m = len(x)

    def near(rows: np.ndarray, i: int, block: int) -> np.ndarray:
        out = x[rows[i : i + block]] @ x[rows].T >= threshold
        own = np.arange(len(out))
        out[own, i + own] = False
        if part is not None:
            out &= part[rows[i : i + block], None] != part[rows]
        return out

    label, links = np.arange(m), np.zeros(m, np.int64)
    block = max(1, min(m, 4_000_000 // max(1, m)))
    every = np.arange(m)
    linked = [near(every, i, block).any(axis=1) for i in range(0, m, block)]
    some = np.flatnonzero(np.concatenate(linked)) if linked else every
    if not len(some):
        return links, label
    # Which earlier leaves each linked point is in, as 0/1 columns: two points share one if the product isn't 0.
    before = [earlier[i] for i in some]
    names, column = np.unique(np.concatenate(before), return_inverse=True)
    held = np.zeros((len(some), max(1, len(names))), np.float32)
    held[np.repeat(np.arange(len(some)), [len(c) for c in before]), column] = 1
    weight = n[some]
    block = max(1, min(len(some), 4_000_000 // len(some)))
    label_some = np.arange(len(some))
    first = changed = True
    while changed:  # smallest label over links, until it stays
        changed = False
        for i in range(0, len(some), block):
            found = near(some, i, block)
            if first:
                fresh = found & (held[i : i + block] @ held.T == 0)
                links[some[i : i + block]] = fresh @ weight
            low = np.minimum(np.where(found, label_some[None, :], len(some)).min(axis=1), label_some[i : i + block])
            if (low < label_some[i : i + block]).any():
                changed = True
                label_some[i : i + block] = low
        first = False
    label[some] = some[label_some]
    return links, label


def _columns(schema_of: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {schema_of.schema[n].dataType.simpleString()}" for n in names)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 6,
    leaf: int = 400,
    sample: int = 4096,
    spill: float = 0.75,
    block: int = 8192,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Pairs with a cosine of at least ``threshold`` link; pairs are found if they share a leaf of one of the trees. A
    vector's margin is ``spill`` times the standard deviation of a just-linked pair's difference along a random
    direction, or what leaves at most ``BOTH`` of a node's on both sides. A pair that shares no leaf is missed, so n_links may be too low; README gives the measured recall. The top
    of the trees is fitted on ``sample`` vectors (the first by a hash), every vector is in them; leaves of more than
    ``leaf`` vectors are split again, and compared in blocks of ``block`` where nothing parts them.

    Null, empty and zero vectors and such with null or non-finite components link with nothing and are kept. Vectors of
    other lengths than the most frequent one's are compared with their like only. Repeated rows are vectors like others
    and link; a null id is never a component's id unless all are null. Other columns don't enter the result. An empty
    table gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("__v").to_pylist()
            found = [unit(v) for v in vectors]
            digests = [None if u is None else hashlib.md5(u.tobytes()).digest() for u in found]
            raw = [None if u is None else packed(v) for u, v in zip(found, vectors, strict=True)]
            dims = [None if u is None else len(u) for u in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())],
                names=["__id", "digest", "raw", "dims"],
            )

    rows = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    all_rows = staged(rows.mapInArrow(read, f"{_columns(rows, '__id')}, digest binary, raw binary, dims int"), "vectors")
    points = staged(
        all_rows.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("__id").alias("rep"), F.count("*").alias("n"), F.min("raw").alias("raw"), F.min("dims").alias("dims")),
        "distinct-vectors",
    )
    widths = points.groupBy("dims").count().orderBy(F.desc("count"), "dims").collect()  # a row a length
    parts = [
        _leaf_results(points.where(F.col("dims") == w.dims), w.dims, w["count"], threshold, trees, leaf, sample, spill, block)
        for w in widths
    ]
    if not parts:
        return all_rows.select(
            F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
            F.col("__id").alias("component_id"), F.lit(True).alias("kept"),
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = staged(found, "leaf-links")
    # Points go by their digest, which no two share, until the smallest id is looked up.
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("root != digest").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    classes = points.join(links, "digest", "left").join(roots, F.col("digest") == F.col("node"), "left").select(
        "digest", "rep", "n", "links", F.coalesce("root", "digest").alias("root")
    )
    lowest = classes.groupBy("root").agg(F.min("rep").alias("low"))
    classes = classes.join(lowest, "root").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "low"
    )
    return (
        all_rows.select("__id", "digest")
        .join(classes, "digest", "left")
        .select(
            F.col("__id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("low", "__id").alias("component_id"),
            F.coalesce(F.col("__id") == F.coalesce("low", "__id"), F.lit(False)).alias("kept"),
        )
    )


def _leaf_results(points, dims, count, threshold, trees, leaf, sample, spill, block) -> DataFrame:
    """digest, links, root of each point and leaf in which the point has a link."""
    margin = spill * float(np.sqrt(max(0.0, 2 - 2 * threshold)) / np.sqrt(dims))
    some = points.orderBy(F.xxhash64("digest")).limit(sample).select("raw").collect() if count > leaf else []
    fitted = unpacked([r.raw for r in some], dims) if some else np.zeros((0, dims))
    goal = 0.7 * leaf  # a sample's estimate may be too low
    root = 1 << (trees - 1).bit_length()
    forest = [Tree(fitted, count / max(1, len(some)), goal, margin, 1, root + k) for k in range(trees if count > leaf else 1)]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                x = unpacked((r.as_py() for r in part.column("raw")), dims)
                for tree in forest:
                    who, shard = tree.route(x)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("digest").take(pa.array(who))], names=["shard", "digest"])

    def fit(pdf: pd.DataFrame, share: int) -> bytes | None:
        tree = Tree(unpacked(pdf["raw"], dims), share, goal, margin, 2, int(pdf["shard"].iloc[0]))
        return pickle.dumps(tree) if tree.nodes else None

    def route(pdf: pd.DataFrame, tree: bytes) -> tuple[np.ndarray, np.ndarray]:
        return pickle.loads(tree).route(unpacked(pdf["raw"], dims))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, cross = unpacked(pdf["raw"], dims), pdf["low"].iloc[0] != pdf["high"].iloc[0]
        part = pdf["block"].to_numpy() if cross else None
        got, root = compare(x, pdf["n"].to_numpy(), [np.asarray(c, np.int64) for c in pdf["earlier"]], threshold, part)
        digest = pdf["digest"].to_numpy()
        out = pd.DataFrame({"digest": digest, "links": got, "root": digest[root]})
        return out[(got > 0) | (root != np.arange(len(x)))]

    placed = staged(points.select("digest", "raw").mapInArrow(top, "shard long, digest binary"), "leaves")
    big = staged(placed.groupBy("shard").count().where(F.col("count") > leaf).select("shard"), "big-leaves")
    if not big.isEmpty():
        wide = placed.join(big, "shard", "left_semi").join(points.select("digest", "raw"), "digest").select("shard", "digest", "raw")
        split = split_until_small(wide, "digest", leaf, fit, route, sample, block=block)
        rest = placed.join(big, "shard", "left_anti").withColumn("blocks", F.lit(1))
        placed = rest.unionByName(split.drop("raw"))
    else:
        placed = placed.withColumn("blocks", F.lit(1))
    leaves = placed.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("at"))
    rows = points.select("digest", "n", "raw").join(leaves, "digest")
    rows = rows.select("digest", "n", "raw", F.col("at.shard").alias("__all"), F.posexplode("at").alias("i", "leaf"))
    rows = rows.select("leaf.*", "digest", "n", "raw", F.slice("__all", F.lit(1), F.col("i")).alias("earlier"))
    return in_blocks(rows, "digest").groupBy("shard", "low", "high").applyInPandas(search, "digest binary, links long, root binary")
