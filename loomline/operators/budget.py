"""Selection of lines under a budget."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, WARN, level
from loomline.functions.text import shorten
from loomline.functions.tokens import estimate

KEYS = ("run_id",)

# Budget of a mode as a share of the budget given, and the cap of the smallest mode.
MODE_SHARES = {"auto": (1, 1), "error": (3, 2), "debug": (2, 1), "verify": (1, 2), "minimal": (1, 1)}
MINIMAL = 2000
RESERVE = 80


def mode_budget(budget: Column, mode: Column) -> Column:
    out = budget
    for name, (num, den) in MODE_SHARES.items():
        out = F.when(mode == name, F.floor(budget * num / den)).otherwise(out)
    return F.greatest(F.when(mode == "minimal", F.least(out, F.lit(MINIMAL))).otherwise(out), F.lit(1)).cast("long")


def pressure_budget(budget: Column, used: Column, window: Column) -> Column:
    """A fuller context shrinks the budget: by steps at 50, 75 and 90 percent, not below a floor, never above it."""
    full = used / window

    def scaled(share: float, floor: int) -> Column:
        return F.least(budget, F.greatest(F.floor(budget.cast("double") * share), F.lit(floor), F.lit(1)))

    return (
        F.when(~((used > 0) & (window > 0)), budget)
        .when(full >= 0.9, scaled(0.4, 1500))
        .when(full >= 0.75, scaled(0.6, 2500))
        .when(full >= 0.5, scaled(0.8, 0))
        .otherwise(budget)
        .cast("long")
    )


def head_tail(lines: DataFrame, budget: int, cost: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The blind cut: lines from the front while they fit half the budget, then from the end while they fit the other.

    Both are prefixes, so running sums decide. ``side`` is head, tail or all.
    """
    priced = lines.withColumn("__c", cost.cast("long"))
    front = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    half = budget // 2
    return (
        priced.withColumn("__all", F.sum("__c").over(whole) <= budget)
        .withColumn("__head", F.sum("__c").over(front) <= half)
        .withColumn("__tail", F.sum("__c").over(back) <= half)
        .withColumn("side", F.when(F.col("__all"), "all").when(F.col("__head"), "head").when(F.col("__tail"), "tail"))
        .where("side is not null")
        .drop("__c", "__all", "__head", "__tail")
    )


def _select(cost: list[int], kind: list[int], blank: list[bool], budget: int, failed: bool) -> list[int]:
    """Positions to keep. Phases in order, each with the share of the budget up to which it may go; what doesn't fit is
    left out (first phases) or ends the phase (last ones)."""
    n, kept, used = len(cost), set(), 0
    room = budget - RESERVE
    if sum(cost) <= budget:
        return list(range(n))

    def take(i: int, share: float) -> bool:
        nonlocal used
        if i in kept:
            return True
        if used + cost[i] > room * share:
            return False
        kept.add(i)
        used += cost[i]
        return True

    for i in range(max(0, n - 15), n):
        take(i, 0.25)
    for i in range(n):
        if kind[i] == ERR:
            take(i, 0.6)
            if i + 1 < n and not blank[i + 1]:
                take(i + 1, 0.6)
    for phase in (
        (range(n), 0.35 if failed else 0.5),
        (range(n - 1, -1, -1), 1.0),
        ((i for i in range(n) if kind[i] == WARN), 1.0),
        (range(n), 1.0),
    ):
        for i in phase[0]:
            if not take(i, phase[1]):
                break
    return sorted(kept)


def pick(lines: DataFrame, budget: int, failed: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """The lines that fit: last lines, errors with what follows them, head, tail, warnings. Keeps ``pos`` and ``line``.

    A greedy selection that skips what doesn't fit is no prefix sum: it runs as a grouped function over cost, kind and
    position (not the text), and the text is joined back by position.
    """
    priced = lines.select(
        *keys,
        "pos",
        (estimate(shorten(F.col("line"), 400)) + 1).alias("cost"),
        level(F.col("line")).alias("kind"),
        (F.trim("line") == "").alias("blank"),
    )
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in priced.schema.fields[: len(keys) + 1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        keep = _select(pdf["cost"].tolist(), pdf["kind"].tolist(), pdf["blank"].tolist(), budget, failed)
        return pdf.loc[keep, [*keys, "pos"]]

    kept = priced.groupBy(*keys).applyInPandas(run, head)
    return lines.join(kept, [*keys, "pos"])


def render(kept: DataFrame, total: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Views: kept lines with ``… n lines omitted …`` between; ``total`` has keys and n_lines."""
    w = Window.partitionBy(*keys).orderBy("pos")
    missing = F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-1)) - 1
    said = lambda n: F.concat(F.lit("… "), n.cast("string"), F.when(n == 1, " line").otherwise(" lines"), F.lit(" omitted …"))
    rows = kept.withColumn("__m", missing).withColumn(
        "__t", F.when(F.col("__m") > 0, F.concat(said(F.col("__m")), F.lit("\n"), "line")).otherwise(F.col("line"))
    )
    held = F.array_sort(F.collect_list(F.struct("pos", "__t")))
    out = rows.groupBy(*keys).agg(
        F.array_join(F.transform(held, lambda x: x["__t"]), "\n").alias("__view"), F.max("pos").alias("__last")
    )
    rest = F.col("n_lines") - F.coalesce("__last", F.lit(-1)) - 1
    return total.join(out, list(keys), "left").select(
        *keys,
        F.concat_ws("\n", "__view", F.when(rest > 0, said(rest))).alias("view"),
    )
