"""Corpus pipeline: stages over documents, each reading what the one before it wrote.

Quality rejects go; of each group of near copies one document stays; sources are mixed to their target weights, a
document standing once for each pass at its training position; what is left is encoded.

A document is an id with a text. Rows that repeat both count as one from the second stage on. In all stages a null text
is an empty one, a null id an id like others (it comes last among equals, and no label is learned from it), and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import mixing, quality
from loomline.llm.common import staged
from loomline.llm.piece_codec import piece_codec
from loomline.llm.queries import piece_digests
from loomline.llm.simhash import simhash_components


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score >= 0.5), with all their columns. A score of just 0.5 stays;
    without usable labels all do."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    plain = docs.toDF(*names).withColumn("id", F.col(at["doc_id"])).withColumn("t", F.col(at["text"]))
    scored = quality.score(plain, model, "id", "t", keep=tuple(names))
    return scored.where("predicted = 1").select(*names).toDF(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``__key``: the id and the digest of the text, never null."""
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("__key", F.concat_ws(" ", *parts))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (then digest) of each SimHash component."""
    rows = _keyed(docs)
    found = simhash_components(rows, keep=("__key",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__key"))
    kept = found.groupBy("class_fp").agg(first.alias("x")).select("x.__key")
    # one shuffle of the texts: the join and the distinct rows are by the same key
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix passes it, sorted by training position; those without words, and those of
    which less than half is taken, not at all. A null source is a source."""
    rows = _keyed(docs)
    plan = mixing.mix(rows, keep=("__key",)).where("passes > 0").groupBy("__key")
    plan = plan.agg(F.flatten(F.collect_list("positions")).alias("__p"))
    placed = rows.dropDuplicates(["__key"]).join(plan, "__key")
    placed = placed.select(*docs.columns, F.explode("__p").alias("__at"))
    return placed.repartitionByRange("__at").sortWithinPartitions("__at").drop("__at")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each row, repeated ones too."""
    return piece_digests(piece_codec(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL has neither the classifier's fit nor the library's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i}")
    return docs
