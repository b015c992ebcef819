"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import license_sql, mixing, quality
from loomline.llm.html_text import extract
from loomline.llm.license_scan import license_scan
from loomline.llm.media import media_column, media_features
from loomline.llm.piece_codec import piece_codec
from loomline.llm.sharding import shard
from loomline.llm.simhash import simhash_components
from loomline.llm.token_counts import token_counts
from loomline.llm.vector_dedup import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, plainly: for the small table of the SQL check.
SQL["op1_vector_dedup"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from v as a join v as b
    on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, root) as (
  select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as component_id from r group by 1),
n as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on node = vec_id left join n on a = vec_id"""


@query
def op2_piece_codec(spark, sf_dir):
    return piece_digests(piece_codec(table(spark, sf_dir, "documents")))


@query
def op3_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query
def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("positions")


SQL["op5_mixing"] = mixing.SQL


@query
def op6_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op8_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_media(spark, sf_dir):
    return media_features(media_column(table(spark, sf_dir, "documents")))


SQL["op6_license_scan"] = license_sql.sql()
