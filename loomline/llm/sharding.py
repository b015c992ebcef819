"""Sharding: vector bin packing of groups of equal texts over bytes, tokens and rows.

The greedy step takes items from the largest to the smallest and places each where the dot product of its vector with
the residual capacity is highest. What it places is bounded in number at any input size:

* a *large* group (more than ``1 / fine`` of one shard's share of any of the three) is an item of its own; there are at
  most ``3 * fine * n`` of them. One that exceeds a whole share cannot stay together: it is cut into the fewest even
  parts that fit a share;
* all other groups fall into ``fine * n`` bundles by the hash of their text; a bundle is an item.

Equal texts so share a shard unless their group alone exceeds a share. Slots number a shard's rows from 0: every item is
a stretch of cells, each cell is ranked by itself, and its offset is the sum of the cells before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import n_words, squeezed, staged

DIMS = ("bytes", "tokens", "rows")

#: Weight of each in the dot product: the law is on bytes.
WEIGHTS = np.array([64.0, 1.0, 1.0])


def pack(items: np.ndarray, n: int) -> np.ndarray:
    """Shard of each row of ``items`` (non-negative vectors): decreasing size, highest dot product, lowest shard."""
    total = items.sum(axis=0, dtype=np.float64)
    share = items / np.where(total > 0, total / n, 1)
    residual = np.where(total > 0, 1.0, 0.0) * np.ones((n, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))) if len(items) else ():
        best = int(np.argmax(np.round(residual @ (WEIGHTS * share[i]), 12)))
        out[i] = best
        residual[best] -= share[i]
    return out


def shard(
    docs: DataFrame, n: int = 24, fine: int = 64, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8
) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes + ``overhead``), text_crc32, shard, slot.

    The law is ``bytes``: sizes are near equal over shards, and so are tokens (words) and rows as far as one packing can
    have all three. A null text has no bytes and is in one group with the empty text. Equal ids and repeated rows each
    get a slot of their own; null ids come first in their cell. Other columns don't enter the result. An empty table
    gives an empty result. Only item vectors come to the driver: ``(3 + 1) * fine * n`` rows and the cells of large
    groups, at most as many again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(F.col(id_col).alias("__id"), text.alias("__t"))
        .withColumn("__w", squeezed("__t"))
        .select(
            "__id",
            (F.octet_length("__t") + overhead).cast("long").alias("size"),
            F.crc32("__t").alias("crc"),
            n_words(F.col("__w")).alias("tokens"),
            F.unhex(F.md5("__t")).alias("digest"),
        ),
        "sizes",
    )
    sums = [
        F.sum("size").cast("long").alias("bytes"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.count("*").alias("rows"),
    ]
    total = np.array([x or 0 for x in rows.agg(*sums).first()], np.float64)
    share = np.maximum(total / n, 1)
    bundles = fine * n

    # Sums of a group are made in each scan task first; only groups that can't be bundled come to the driver.
    groups = rows.groupBy("digest").agg(*sums)
    large = groups.where(" or ".join(f"{d} > {float(s / fine)!r}" for d, s in zip(DIMS, share, strict=True))).collect()
    # (digest, cells): a large group is ranked in cells of about a bundle's rows
    cells = [(g.digest, max(1, int(np.ceil(g.rows / max(1.0, total[2] / bundles))))) for g in large]
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(cells, "digest binary, cells long"))  # at most 3 * fine * n rows
    celled = rows.join(known, "digest", "left").select(
        "__id",
        "size",
        "crc",
        "tokens",
        F.coalesce(F.hex(F.when(F.col("cells").isNotNull(), F.col("digest"))), F.lit("")).alias("big"),
        F.when(F.col("cells").isNull(), F.pmod(F.xxhash64("digest"), F.lit(bundles)))
        .otherwise(F.pmod(F.xxhash64("__id", F.lit("cell")), F.col("cells")))
        .alias("cell"),
    )
    counted = {(r.big, r.cell): (r.bytes, r.tokens, r.rows) for r in celled.groupBy("big", "cell").agg(*sums).collect()}

    items, members = [], []
    for key in sorted(k for k in counted if not k[0]):
        items.append(counted[key])
        members.append([key])
    for g in sorted(large, key=lambda g: g.digest):
        own = sorted(k for k in counted if k[0] == g.digest.hex().upper())
        parts = max(int(np.ceil(v / s - 1e-9)) for v, s in zip((g.bytes, g.tokens, g.rows), share, strict=True))
        for part in _parts(own, min(parts, len(own))):
            items.append(tuple(np.sum([counted[k] for k in part], axis=0).tolist()))
            members.append(part)
    placed = pack(np.array(items, np.float64).reshape(-1, 3), n)
    offset = [0] * n
    plan = []
    for to, keys in zip(placed.tolist(), members, strict=True):
        for key in keys:
            plan.append((*key, to, offset[to]))
            offset[to] += counted[key][2]
    plan = F.broadcast(spark.createDataFrame(plan, "big string, cell long, shard int, offset long"))  # one row a cell
    order = Window.partitionBy("big", "cell").orderBy("__id", "crc", "size")
    return celled.join(plan, ["big", "cell"]).select(
        F.col("__id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("offset") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )


def _parts(keys: list, n: int) -> Iterator[list]:
    """``keys`` in ``n`` runs of near equal length."""
    for i in range(n):
        if part := keys[i * len(keys) // n : (i + 1) * len(keys) // n]:
            yield part
