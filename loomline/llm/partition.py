"""Shards that stay below a limit: what a tree over a bounded sample left too big is split by a sample of its own.

Rows are ``shard`` (a node's number as in a heap) and a payload. In each round the shards above the limit give a sample
each, one tree a shard is fitted on it in a grouped function, and the shard's rows, dealt to salted groups, go down that
tree. Sizes, samples and trees are tables: nothing but one count a round reaches the driver, and what is joined by
broadcast is so by its measured size only. A shard that no split makes smaller is dense: it is cut into blocks, and a
task gets two of them, so that every pair of its rows meets in one task, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import staged

#: Nodes beyond this aren't split further: their children's numbers wouldn't fit.
LAST_NODE = 1 << 61


def split_until_small(
    rows: DataFrame,
    key: str,
    limit: int,
    fit: Callable[[pd.DataFrame, int], bytes | None],
    route: Callable[[pd.DataFrame, bytes], tuple],
    sample: int = 4096,
    salted: int = 20_000,
    block: int | None = None,
) -> DataFrame:
    """``rows`` with ``blocks``: 1, or for a dense shard into how many blocks of about ``block`` rows (``limit`` if not given) it is cut.

    ``fit(sampled rows, their share's inverse)`` gives a shard's tree or None if it can't be split; ``route(rows, tree)``
    gives (row numbers, shards). ``key`` is a column that no two rows of a shard share.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", blocks int"

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, n = int(pdf["shard"].iloc[0]), int(pdf["__n"].iloc[0])
        tree = fit(pdf, n // len(pdf)) if shard < LAST_NODE else None
        return pd.DataFrame({"shard": [shard], "__n": [n], "tree": [tree]})

    def routed(pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        tree, n = trees["tree"].iloc[0], int(trees["__n"].iloc[0])
        if tree is None:
            return pdf[names].assign(blocks=-(-n // (block or limit)))
        at, shard = route(pdf, tree)
        return pdf[names].iloc[at].assign(shard=shard, blocks=0)

    done = []
    while True:
        big = staged(rows.groupBy("shard").agg(F.count("*").alias("__n")).where(F.col("__n") > limit), "big-shards")
        if big.isEmpty():
            done.append(rows.select(*names, F.lit(1).alias("blocks")))
            break
        done.append(rows.join(big, "shard", "left_anti").select(*names, F.lit(1).alias("blocks")))
        some = rows.join(big, "shard").where(
            F.pmod(F.xxhash64(key, F.lit(len(done))), F.greatest(F.lit(1), F.floor(F.col("__n") / sample))) == 0
        )
        trees = staged(some.groupBy("shard").applyInPandas(fitted, "shard long, __n long, tree binary"), "shard-trees")
        salts = F.ceil(F.col("__n") / salted).cast("int")
        left = rows.join(big, "shard").withColumn("__salt", F.pmod(F.xxhash64(key), salts).cast("int"))
        right = trees.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        by = ["shard", "__salt"]
        both = staged(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(routed, schema), "split-shards")
        done.append(both.where("blocks > 0"))
        rows = both.where("blocks = 0").select(*names)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows(shard, blocks, ...)`` with ``block``, ``low`` and ``high``: a row stands once for each pair of blocks that
    its block is in. Pairs of one shard's rows meet where (low, high) are their two blocks."""
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(key, F.lit("block")), F.col("blocks"))).otherwise(0).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (
        rows.withColumn("block", block)
        .withColumn("__o", F.explode(others))
        .withColumn("low", F.least("block", "__o"))
        .withColumn("high", F.greatest("block", "__o"))
        .drop("__o", "blocks")
    )
