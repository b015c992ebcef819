"""Sources and sinks: captures, the run store, histories and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.StructType(
    [
        T.StructField("t", T.LongType()),
        T.StructField("cmd", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("raw", T.LongType()),
        T.StructField("out", T.LongType()),
        T.StructField("ms", T.LongType()),
        T.StructField("exit", T.IntegerType()),
        T.StructField("lossy", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("of", T.LongType()),
        T.StructField("mode", T.StringType()),
    ]
)

META = T.StructType(
    [
        T.StructField("argv", T.ArrayType(T.StringType())),
        T.StructField("shell", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("cwd", T.StringType()),
    ]
)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``<category>/<name>.txt`` with ``<name>.meta.json``: category, name, raw, meta columns; a body without meta stays."""
    at = lambda ending: F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/([^/]+)\.{ending}$", 1)
    name = lambda ending: F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/([^/]+)\.{ending}$", 2)
    bodies = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    bodies = bodies.select(at("txt").alias("category"), name("txt").alias("name"), F.col("value").alias("raw"))
    meta = spark.read.schema(META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(folder)
    meta = meta.select(at(r"meta\.json").alias("category"), name(r"meta\.json").alias("name"), *META.names)
    return bodies.join(meta, ["category", "name"], "left")


def write_runs(runs: DataFrame, path: str, time: str = "t") -> None:
    """Append ``runs`` to a store, partitioned by day."""
    runs.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def latest(runs: DataFrame, time: str = "t", key: str = "run_id", tie: str | None = None) -> DataFrame:
    """Each id's newest row; of rows at one time the one with the largest ``tie``, else any."""
    order = [F.desc_nulls_last(time), *([F.desc(tie)] if tie else [])]
    return runs.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__i = 1").drop("__i")


def read_runs(spark: SparkSession, path: str, since: str | None = None, time: str = "t", key: str = "run_id") -> DataFrame:
    """The store's runs; ``since`` (a date) prunes partitions. A run stored twice is taken once, the newest."""
    runs = spark.read.parquet(path)
    return latest(runs.where(F.col("day") >= F.lit(since).cast("date")) if since else runs, time, key)


def newest(runs: DataFrame, n: int, time: str = "t", key: str = "run_id", tie: str | None = None) -> DataFrame:
    """The ``n`` newest runs, each id once; at one time the larger id comes first."""
    return latest(runs, time, key, tie).orderBy(F.desc(time), F.desc(key)).limit(n)


def read_history(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Savings records from JSON lines; lines that are none are left out."""
    out = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where("cmd is not null")
    return out.where(F.col("t") >= since) if since is not None else out


def read_transcripts(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """session (file), line number free: value of each JSON line; malformed ones have a null ``type``."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    raw = reader.text(folder).select(F.col("_metadata.file_path").alias("session"), "value")
    doc = F.try_parse_json("value")
    return raw.withColumn("type", F.try_variant_get(doc, "$.type", "string")).withColumn("doc", doc)


def tool_calls(transcripts: DataFrame) -> DataFrame:
    """Tool uses with their results, by session and id; one without a result keeps nulls."""
    block = F.explode(F.from_json(F.get_json_object("value", "$.message.content"), "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"))
    # a substring test before any parsing
    rows = transcripts.where(F.col("value").contains("tool_")).select("session", block.alias("b"))
    uses = rows.where("b.type = 'tool_use'").select("session", F.col("b.id").alias("id"), F.col("b.name").alias("tool"), F.col("b.input").alias("input"))
    results = rows.where("b.type = 'tool_result'").select("session", F.col("b.tool_use_id").alias("id"), F.col("b.content").alias("content"), F.col("b.is_error").alias("is_error"))
    return uses.join(results, ["session", "id"], "left")
