"""Structured Streaming over growing histories. Watermarks bound state; what comes later than one is left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, level
from loomline.functions.text import mask
from loomline.sources.store import HISTORY


def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Savings records as they are appended, with ``at`` as event time."""
    return spark.readStream.schema(HISTORY).json(folder).withColumn("at", F.timestamp_seconds("t"))


def savings(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Savings by command and tumbling window."""
    return (
        stream.withWatermark("at", late)
        .groupBy(F.window("at", window), "cmd")
        .agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("out").alias("out"))
        .select(F.col("window.start").alias("start"), "cmd", "n", "raw", "out")
    )


def template_counts(lines: DataFrame, window: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Masked forms of log lines by window: ``lines(at, line)`` to start, template, n, n_err."""
    err = (level(F.col("line")) == ERR).cast("int")
    return (
        lines.withWatermark("at", late)
        .groupBy(F.window("at", window), mask(F.col("line")).alias("template"))
        .agg(F.count("*").alias("n"), F.sum(err).alias("n_err"))
        .select(F.col("window.start").alias("start"), "template", "n", "n_err")
    )


def rerun_deltas(runs: DataFrame, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """For each run of ``runs(command, cwd, run_id, at, items array<string>)``, what is new, fixed and still against the
    run before with the same command and folder. State is the last run's items, kept for ``keep_days`` of event time
    without a run; ``at`` is never null."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = set(state.get[0]) if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "run_id"]).itertuples():
            now = set(r.items)
            rows.append(
                {"command": key[0], "cwd": key[1], "run_id": r.run_id,
                 "n_new": len(now - before) if before is not None else len(now),
                 "n_fixed": len(before - now) if before is not None else 0,
                 "n_still": len(before & now) if before is not None else 0}
            )
            before = now
        state.update((sorted(before),))
        newest = int(pd.Timestamp(r.at).timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_days * 86_400_000)
        yield pd.DataFrame(rows)

    return runs.withWatermark("at", late).groupBy("command", "cwd").applyInPandasWithState(
        step,
        "command string, cwd string, run_id long, n_new long, n_fixed long, n_still long",
        "items array<string>",
        "append",
        "EventTimeTimeout",
    )
