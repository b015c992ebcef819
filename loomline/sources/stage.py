"""Steps written as tables, so that what follows neither computes them again nor plans over all that came before."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Unset, a local session gets a folder of its own for as long as
    it runs; on a cluster, where executors share no disk, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomline.steps.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="steps-")
        spark.conf.set("loomline.steps.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back with its columns; the table stays until the folder is emptied."""
    path = f"{folder(df.sparkSession)}/loomline/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
