"""Join-like operators: what a view lost, what changed between two runs, which earlier run a run belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, app_locations, level
from loomline.functions.text import squash

KEYS = ("run_id",)


def missing_errors(lines: DataFrame, view: DataFrame, keys: Sequence[str] = KEYS, most: int | None = None, graded: str | None = None) -> DataFrame:
    """Distinct error lines (white space squashed) of ``lines`` that no line of ``view`` equals or holds: keys, pos, line.

    Null lines are none. What no line equals is then looked for within the run's longer lines. ``most`` keeps the first so many of a run: the guard's report; ``n_missing`` counts all. ``graded`` names a column of ``lines`` that holds their level already.
    """
    errors = lines.where((level(F.col("line")) if graded is None else F.col(graded)) == ERR).withColumn("__s", squash(F.col("line")))
    first = errors.groupBy(*keys, "__s").agg(F.min("pos").cast("long").alias("pos"), F.min_by("line", "pos").alias("line"))
    shown = view.select(*keys, squash(F.col("line")).alias("__s")).distinct()
    lost = first.join(shown, [*keys, "__s"], "left_anti")
    held = shown.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__s").alias("__v"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    lost = lost.join(held, same & F.col("__v").contains(F.col("__s")), "left_anti").drop("__s")
    lost = lost.withColumn("n_missing", F.count("*").over(Window.partitionBy(*keys)))
    if most is None:
        return lost
    w = Window.partitionBy(*keys).orderBy("pos")
    return lost.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most).drop("__i")


def missing_locations(lines: DataFrame, view: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct places outside libraries that the lines name and the view doesn't."""
    of = lambda df: df.select(*keys, F.explode(app_locations(F.col("line"))).alias("place")).distinct()
    return of(lines).join(of(view), [*keys, "place"], "left_anti")


def delta(before: DataFrame, after: DataFrame, key: str = "key", block: str = "block") -> DataFrame:
    """Items of two runs side by side: key, state (new, fixed, changed, still)."""
    b = before.select(F.col(key).alias("__k"), F.col(block).alias("__old"), F.lit(True).alias("__was"))
    a = after.select(F.col(key).alias("__k2"), F.col(block).alias("__new"), F.lit(True).alias("__is"))
    both = b.join(a, F.col("__k") == F.col("__k2"), "full_outer")
    state = (
        F.when(F.col("__was").isNull(), "new")
        .when(F.col("__is").isNull(), "fixed")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "still")
        .otherwise("changed")
    )
    return both.select(F.coalesce("__k", "__k2").alias(key), state.alias("state"))


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two multisets differ, with n in the first less n in the second; equal multisets give none."""
    cols = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("__n").alias("surplus")).where("surplus != 0")


def unseen(view: DataFrame, known: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines of a view whose loosened form (digits and white space aside) no known line has."""
    loose = F.regexp_replace(squash(F.col("line")), "[0-9]+", "0")
    seen = known.select(*keys, loose.alias("__l")).distinct()
    return view.withColumn("__l", loose).join(seen, [*keys, "__l"], "left_anti").drop("__l")


def previous(runs: DataFrame, same: Sequence[str], time: str, value: Column, name: str = "previous", tie: str = "run_id") -> DataFrame:
    """As-of: ``value`` of the newest earlier run with the same columns ``same``; of runs at one time the smaller ``tie`` is
    the earlier. Null times come first."""
    return runs.withColumn(name, F.lag(value).over(Window.partitionBy(*same).orderBy(time, tie)))


def acted_within(
    calls: DataFrame, session: str, seq: str, named: Column, touched: Column, window: int = 3
) -> DataFrame:
    """Calls whose named thing is touched within the next ``window`` calls of the session: ``acted_at`` is the first.

    An interval join of bounded width: each call is looked at from the ``window`` calls before it, so it is an equi-join
    on session and sequence number.
    """
    asked = calls.select(session, F.col(seq).alias("asked_at"), named.alias("__what")).where("__what is not null")
    asked = asked.withColumn("__at", F.explode(F.sequence(F.col("asked_at") + 1, F.col("asked_at") + window)))
    done = calls.select(session, F.col(seq).alias("__at"), touched.alias("__what")).where("__what is not null")
    hits = asked.join(done, [session, "__at", "__what"], "left_semi")
    first = hits.groupBy(session, "asked_at").agg(F.min("__at").alias("acted_at"))
    return asked.select(session, "asked_at").distinct().join(first, [session, "asked_at"], "left")


def focus_rank(lines: DataFrame, terms: DataFrame, keys: Sequence[str] = KEYS, most_terms: int = 64) -> DataFrame:
    """Lines by the summed weight of the focus terms they hold as whole words: keys, pos, score.

    ``terms(term, weight)`` is a short list. A term on more than 10 lines and more than a third of a run's lines is too
    broad to rank by. Words of lines are matched by an equi-join, not line by line against each term.
    """
    some = terms.select(F.lower("term").alias("word"), "weight").orderBy(F.desc("weight"), "term").limit(most_terms)
    found = lines.where(F.trim("line") != "")
    n = found.groupBy(*keys).agg(F.count("*").alias("__lines"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("[0-9A-Za-z_]+"), F.lit(0)))
    hits = found.select(*keys, "pos", F.explode(words).alias("word")).join(F.broadcast(some), "word")
    wide = hits.groupBy(*keys, "word").agg(F.count("*").alias("__hits")).join(n, list(keys))
    wide = wide.where((F.col("__hits") > 10) & (F.col("__hits") * 3 > F.col("__lines")))
    kept = hits.join(wide, [*keys, "word"], "left_anti")
    return kept.groupBy(*keys, "pos").agg(F.sum("weight").alias("score"))
