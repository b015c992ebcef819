"""What several operators share: the shared work folder, staged tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a single machine, where it is unset, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomline.work.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("loomline.work.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read of files, not of Python work. Column order and types stay.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def squeezed(text):
    """The words of a text (what ASCII white space separates) with one space between."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def n_words(words):
    """How many words a squeezed text has."""
    return (
        F.when(words == "", F.lit(0))
        .otherwise(F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "))) + 1)
        .cast("long")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node named in ``edges(a, b)``: columns ``node``, ``root``.

    Alternates two star contractions over staged tables. In each, a node's neighbours are hung on the smallest of
    them: first those larger than the node, then those not larger. Edges never outnumber the input's, the rounds grow
    with the logarithm of the longest chain. Nothing is collected but one count and one sum a round. Minima are
    partial aggregates, and the join back to a hub's edges is one that adaptive execution splits.

    Null ids and self links are left out; an empty table gives an empty one.
    """
    typ = edges.schema["a"].dataType
    e = staged(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min(F.least("a", "b")).alias("m"))
        large = (
            both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a != b").distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("n"))
        e = staged(
            joined.select(
                F.explode(
                    F.array(
                        F.struct(F.col("a"), F.col("m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    )
                ).alias("x")
            )
            .select("x.*")
            .where("a != b")
            .distinct(),
            "links",
        )
        now = e.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == (now.n, now.h):
            break
        before = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").cast(typ).alias("node"), F.col("b").cast(typ).alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
