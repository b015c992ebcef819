"""Operators on ordered lines: DataFrames with key columns, ``pos`` and ``line``.

Every operator takes the key columns (``run_id`` unless told otherwise) and keeps ``pos`` as identity. They share one
partitioning by key; runs of lines are found with window functions (gaps and islands).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, level
from loomline.functions.patterns import LOCATED_LINE
from loomline.functions.text import mask

KEYS = ("run_id",)


def explode(df: DataFrame, text: str = "text", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos from 0, line. A null text has no lines, an empty one has one."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def implode(lines: DataFrame, keys: Sequence[str] = KEYS, name: str = "text") -> DataFrame:
    """Lines in order of ``pos``, joined again."""
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias(name))


def by_pos(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("pos")


def islands(lines: DataFrame, same: Column, keys: Sequence[str] = KEYS, name: str = "island") -> DataFrame:
    """A number for each stretch of lines in which ``same`` (null-safe) doesn't change."""
    w = by_pos(keys)
    with_key = lines.withColumn("__same", same)
    new = F.when(F.lag("__same").over(w).eqNullSafe(F.col("__same")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return with_key.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__same", "__new")


def collapse_runs(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal neighbours as one line with ``[×n]``, blank ones as one empty line; ``pos`` is the first's."""
    run = islands(lines, F.when(F.trim("line") == "", "").otherwise(F.col("line")), keys)
    n = F.count("*")
    first = F.min_by("line", "pos")
    return (
        run.groupBy(*keys, "island")
        .agg(F.min("pos").alias("pos"), first.alias("first"), n.alias("n"))
        .select(
            *keys,
            "pos",
            F.when(F.trim("first") == "", "")
            .when(F.col("n") == 1, F.col("first"))
            .otherwise(F.concat("first", F.lit(" [×"), F.col("n").cast("string"), F.lit("]")))
            .alias("line"),
            F.col("n").cast("long").alias("n"),
        )
    )


def collapse_similar(lines: DataFrame, keys: Sequence[str] = KEYS, min_run: int = 4, longest: int = 1000) -> DataFrame:
    """Runs of at least ``min_run`` lines with one mask become first, a count, last. Errors, places, blank and very long
    lines never join a run."""
    joins = (
        (F.octet_length("line") <= longest)
        & (F.trim("line") != "")
        & ~F.col("line").rlike(LOCATED_LINE)
        & (level(F.col("line")) < ERR)
    )
    masked = lines.withColumn("__mask", F.when(joins, mask(F.col("line"))))
    # a line that joins none is an island of its own
    run = islands(masked, F.coalesce("__mask", F.concat(F.lit("\0"), F.col("pos").cast("string"))), keys)
    w = Window.partitionBy(*keys, "island")
    sized = run.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy("pos")))
    between = F.concat(F.lit("… "), (F.col("__n") - 2).cast("string"), F.lit(" similar lines …"))
    return (
        sized.where((F.col("__n") < min_run) | F.col("__i").isin(1, 2) | (F.col("__i") == F.col("__n")))
        .withColumn("line", F.when((F.col("__n") >= min_run) & (F.col("__i") == 2), between).otherwise(F.col("line")))
        .select(*keys, "pos", "line")
    )


def records(lines: DataFrame, starts: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """``record``: how many starts there were up to a line; lines before the first are record 0."""
    return lines.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(by_pos(keys)).cast("long"))


def carry(lines: DataFrame, heading: Column, value: Column, keys: Sequence[str] = KEYS, name: str = "heading") -> DataFrame:
    """The last heading's value, on every line from it on."""
    return lines.withColumn(name, F.last(F.when(heading, value), ignorenulls=True).over(by_pos(keys)))


def context(lines: DataFrame, hit: Column, before: int, after: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines within ``before``/``after`` of a hit, with ``hit``."""
    w = by_pos(keys).rowsBetween(-after, before)
    found = lines.withColumn("hit", hit).withColumn("__near", F.max(F.col("hit").cast("int")).over(w))
    return found.where("__near = 1").drop("__near")


def gaps(kept: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``omitted``: how many lines are missing before each kept one."""
    return kept.withColumn("omitted", (F.col("pos") - F.coalesce(F.lag("pos").over(by_pos(keys)), F.lit(-1)) - 1).cast("long"))


def show(
    lines: DataFrame,
    errors: bool = False,
    grep: str | None = None,
    between: tuple[int, int] | None = None,
    head: int | None = None,
    tail: int | None = None,
    around: int = 0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Selection over stored lines: a range (from 1), then errors and pattern, their context, then head or tail."""
    out = lines
    if between:
        out = out.where(F.col("pos").between(between[0] - 1, between[1] - 1))
    hit = F.lit(True)
    if errors:
        hit = hit & (level(F.col("line")) == ERR)
    if grep is not None:
        hit = hit & F.col("line").rlike(grep)
    out = context(out, hit, around, around, keys) if errors or grep is not None else out.withColumn("hit", F.lit(True))
    if head is not None:
        out = out.withColumn("__i", F.row_number().over(by_pos(keys))).where(F.col("__i") <= head).drop("__i")
    if tail is not None:
        last = Window.partitionBy(*keys).orderBy(F.desc("pos"))
        out = out.withColumn("__i", F.row_number().over(last)).where(F.col("__i") <= tail).drop("__i")
    return gaps(out, keys)
