"""Aggregations over histories: savings, recalls, regret levels, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def gain(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, raw, out, saved, pct, failures, lossy over ``history(cmd, raw, out, exit, lossy)``, whole or by ``keys``."""
    saved = F.sum("raw") - F.sum("out")
    return history.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("raw").alias("raw"),
        F.sum("out").alias("out"),
        saved.alias("saved"),
        F.when(F.sum("raw") > 0, F.floor(saved * 100 / F.sum("raw"))).otherwise(0).cast("long").alias("pct"),
        F.count_if(F.col("exit") != 0).alias("failures"),
    )


def daily(history: DataFrame, time: str = "t") -> DataFrame:
    """gain by day, with a row of zeros for each day between the first and the last that has none."""
    by_day = gain(history.withColumn("day", F.to_date(time)), ["day"])
    ends = history.agg(F.min(F.to_date(time)).alias("a"), F.max(F.to_date(time)).alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(by_day, "day", "left").fillna(0)


def totals(df: DataFrame, category: str, **sums: Column) -> DataFrame:
    """Sums by category, and over all as the row whose category is null."""
    return df.rollup(category).agg(*[F.sum(v).alias(k) for k, v in sums.items()], F.count("*").alias("n"))


def regret_counts(events: DataFrame, keys: Sequence[str], seconds: str, days: int = 7) -> DataFrame:
    """For each event how many of its key fell in the ``days`` up to it, itself included."""
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-days * DAY, 0)
    return events.withColumn("n_recent", F.count("*").over(w))


def regret_level(n_recent: Column, clean_runs: Column) -> Column:
    """0, 1 from two regrets on, 2 from four; every 20 clean runs since take a level back."""
    base = F.when(n_recent >= 4, 2).when(n_recent >= 2, 1).otherwise(0)
    return F.greatest(base - F.floor(clean_runs / 20), F.lit(0)).cast("int")


def recalls(runs: DataFrame, shows: DataFrame, keys: Sequence[str], seconds: str, minutes: int = 15) -> DataFrame:
    """Each recall with the newest run of its key at most ``minutes`` before it: an as-of join by union and carry-forward."""
    both = runs.select(*keys, F.col(seconds).alias("asked_at"), F.col("id").alias("run"), F.lit(0).alias("k")).unionByName(
        shows.select(*keys, F.col(seconds).alias("asked_at"), F.col("id").alias("run"), F.lit(1).alias("k"))
    )
    w = Window.partitionBy(*keys).orderBy("asked_at", "k", "run").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.last(F.when(F.col("k") == 0, F.struct("asked_at", "run")), ignorenulls=True).over(w)
    out = both.withColumn("__r", newest).where("k = 1")
    near = F.col("asked_at") - F.col("__r.asked_at") <= minutes * 60
    return out.select(*keys, "asked_at", F.col("run").alias("shown"), F.when(near, F.col("__r.run")).alias("run"))


def retained(
    runs: DataFrame, now: Column, time: str = "t", size: str = "bytes", newest: int = 1000, fresh: int = DAY,
    oldest: int = 7 * DAY, most_bytes: int = 256 << 20,
) -> DataFrame:
    """Runs that stay: among the newest or fresh, not too old, and within the byte limit counted from the newest.

    Rank and running size are over one store, by partitions of the store's folder column ``store``.
    """
    w = Window.partitionBy("store").orderBy(F.desc(time), F.desc("id"))
    age = now - F.col(time)
    ranked = (
        runs.withColumn("__i", F.row_number().over(w))
        .withColumn("__b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    keep = ((F.col("__i") <= newest) | (age < fresh)) & (age <= oldest) & (F.col("__b") <= most_bytes)
    return ranked.where(keep).drop("__i", "__b")
