"""The engine over many runs, ``runs(run_id, command, exit, raw)`` to one view a run; README lists what it lacks.

Clean, count, keep small outputs whole; else a reader by the command or by marks in the output, a table for JSON above the
budget, templates for logs, lists of paths by directory, or the plain shape (progress dropped, runs collapsed, goroutines
grouped, stacks folded, similar lines collapsed, lines shortened); then the budget, the guard that puts lost error lines
back (JSON and path lists are content, without guard), and last the gate that never gives more than nine tenths of what came in.

A run's lines stay in one partition of its id through all window functions; branches are filters on one column, and rows
of other branches never reach a branch's functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, is_progress, level
from loomline.functions.text import clean, shorten
from loomline.functions.tokens import estimate
from loomline.operators import budget as B, compare, lines as L, paths as P, stacks, templates
from loomline.operators.json_tables import json_view
from loomline.readers import apply, assign, detect
from loomline.sources.stage import written


@dataclass(frozen=True)
class Options:
    budget: int = 8000
    small: int = 150
    max_line: int = 400
    guard: int = 40
    saving: float = 0.1


def prepared(runs: DataFrame) -> DataFrame:
    """run_id, command, exit, text, n_raw (tokens), reader, kind."""
    return detect(
        assign(runs.select("run_id", "command", "exit", clean(F.coalesce("raw", F.lit(""))).alias("text")))
    ).withColumn("n_raw", estimate(F.col("text")))


def log_lines(lines: DataFrame) -> DataFrame:
    """Of lines with their ``level``: template lines in order of first sight, errors with their example."""
    found = templates.merged(lines, graded="level")
    said = F.when(F.col("is_err"), F.col("example")).otherwise(F.col("template"))
    n = F.concat(F.lit("[×"), F.col("cnt").cast("string"), F.lit("] "), said)
    return found.select("run_id", F.col("first_pos").cast("int").alias("pos"), F.when(F.col("cnt") > 1, n).otherwise(said).alias("line"))


def plain_lines(lines: DataFrame, options: Options) -> DataFrame:
    out = lines.where(~is_progress(F.col("line")))
    out = L.collapse_runs(out).select("run_id", "pos", "line")
    out = L.collapse_similar(stacks.fold_stacks(stacks.group_goroutines(out)))
    return out.withColumn("line", shorten(F.col("line"), options.max_line, level(F.col("line")) == ERR))


def path_lines(lines: DataFrame) -> DataFrame:
    """Paths by directory, other lines as they are; of recursive listings the paths alone."""
    listing = F.col("reader").eqNullSafe(F.lit("ls-recursive"))
    plain, like = lines.where(~listing), P.is_path_like(F.col("line"))
    found = plain.where(like).select("run_id", "pos", F.col("line").alias("path")).unionByName(P.recursive_listing(lines.where(listing)))
    return P.factored_lines(found).unionByName(plain.where(~like & (F.trim("line") != "")).select("run_id", "pos", "line"))


def condense(runs: DataFrame, options: Options = Options()) -> DataFrame:
    """run_id, shape, n_raw, n_out, lossy, view for every run. A null output is an empty one; run ids are unique.

    Cleaned runs, their lines, the shaped and the kept ones feed several branches each: they are written to the shared folder
    at the call, so a lost executor costs its tasks only, and no plan holds all steps.
    """
    own = F.col("kind").isNotNull() & (F.col("kind") != "plain")
    ready = prepared(runs)
    ready = json_view(ready.withColumn("json", F.when(~own & (F.col("n_raw") > options.budget), F.col("text"))), "json", "json")
    ready = written(ready, "runs")
    small = F.col("n_raw") <= options.small
    big = ready.where(~small)
    is_json = F.col("json").isNotNull()
    lines = L.explode(big.withColumn("is_json", is_json), "text", ["run_id", "reader", "kind", "is_json"])
    general = lines.where(~own & ~F.col("is_json"))
    gate = templates.log_gate(general).where("is_log_run").select("run_id", F.lit(True).alias("is_log"))
    listed = P.path_lists(general).where("is_list").select("run_id", "is_list")
    lines = lines.join(gate, "run_id", "left").join(listed, "run_id", "left")
    shape = (
        F.when(own, F.col("reader"))
        .when(F.col("is_json"), "json")
        .when(F.col("is_log"), "log")
        .when(F.col("is_list") | (F.col("reader") == "ls-recursive"), "paths")
        .otherwise("lines")
    )
    lines = written(lines.withColumn("shape", shape).withColumn("level", level(F.col("line"))).drop("is_log", "is_list"), "lines")
    base = ["run_id", "pos", "line"]
    read = apply(lines.where(own)).select(*base)
    logs = log_lines(lines.where("shape = 'log'").select(*base, "level"))
    listed = path_lines(lines.where("shape = 'paths'"))
    tables = L.explode(big.where(is_json), "json", ["run_id"])
    plain = plain_lines(lines.where("shape = 'lines'").select(*base), options)
    shaped = read.unionByName(logs).unionByName(listed).unionByName(tables).unionByName(plain)
    kept = written(B.pick(written(shaped, "shaped"), options.budget), "kept")
    lost = compare.missing_errors(lines.where("shape not in ('json', 'paths')").select(*base, "level"), kept, most=options.guard, graded="level")
    noted = lost.select("run_id", (F.col("pos") + F.lit(1 << 30)).cast("int").alias("pos"), "line")
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    views = kept.select(*base).unionByName(noted).groupBy("run_id").agg(
        F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("view")
    )
    shapes = lines.groupBy("run_id").agg(F.first("shape").alias("shape"))
    out = ready.join(views, "run_id", "left").join(shapes, "run_id", "left")
    out = out.withColumn("n_view", estimate(F.coalesce("view", F.lit(""))))
    whole = small | F.col("view").isNull() | (F.col("n_view") > F.col("n_raw") * (1 - options.saving))
    return out.select(
        "run_id",
        F.when(small, "small").otherwise(F.coalesce("shape", F.lit("lines"))).alias("shape"),
        "n_raw",
        F.when(whole, F.col("n_raw")).otherwise(F.col("n_view")).alias("n_out"),
        (~whole).alias("lossy"),
        F.when(whole, F.col("text")).otherwise(F.col("view")).alias("view"),
    )
