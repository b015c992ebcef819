"""Stack traces and goroutine dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.patterns import LIBRARY
from loomline.operators.lines import carry, islands, records

KEYS = ("run_id",)

# How a frame is written in Python, JavaScript, the JVM and .NET, Rust, Ruby and PHP.
FRAMES = (
    r'^\s+File "[^"]+", line \d+'
    r"|^\s+at (?:async )?(?:[^\s(]+ )?\(?[^\s()]+:\d+(?::\d+)?\)?$"
    r"|^\s+at [\w.$<>/]+\([^()]*\)$"
    r"|^\s+at .+ in \S+:line \d+$"
    r"|^\s+\d+: (?:0x[0-9a-f]+ - )?\S+"
    r"|^\s+(?:from )?\S+:\d+:in [`'].*'$"
    r"|^#\d+ \S+\(\d+\): "
    r"|^\t\S+\.go:\d+(?: \+0x[0-9a-f]+)?$"
)
RUNTIME = LIBRARY + r"|node:|<anonymous>|\bjava\.|\bjavax\.|\bsun\.|\bjdk\.|\borg\.springframework|\bSystem\.|core::|std::|/gems/|vendor/"


def fold_stacks(lines: DataFrame, keys: Sequence[str] = KEYS, boundary: int = 1, whole: int = 6) -> DataFrame:
    """Traces longer than ``whole`` frames keep first, last and application frames with ``boundary`` neighbours; each
    stretch of at least two others becomes one line with its number."""
    marked = lines.withColumn("__f", F.col("line").rlike(FRAMES))
    run = islands(marked, F.col("__f"), keys, "__trace")
    w = Window.partitionBy(*keys, "__trace")
    order = w.orderBy("pos")
    own = F.when(F.col("line").rlike(RUNTIME), 0).otherwise(1)
    run = (
        run.withColumn("__n", F.count("*").over(w))
        .withColumn("__i", F.row_number().over(order))
        .withColumn("__near", F.max(own).over(order.rowsBetween(-boundary, boundary)))
        .withColumn(
            "__keep",
            ~F.col("__f") | (F.col("__n") <= whole) | (F.col("__i") == 1) | (F.col("__i") == F.col("__n")) | (F.col("__near") == 1),
        )
    )
    part = islands(run, F.concat_ws(" ", F.col("__trace").cast("string"), F.col("__keep").cast("string")), keys, "__part")
    p = Window.partitionBy(*keys, "__part")
    part = part.withColumn("__k", F.count("*").over(p)).withColumn("__j", F.row_number().over(p.orderBy("pos")))
    folded = ~F.col("__keep") & (F.col("__k") >= 2)
    text = F.concat(F.lit("    … "), F.col("__k").cast("string"), F.lit(" library frames"))
    return part.where(~folded | (F.col("__j") == 1)).select(*keys, "pos", F.when(folded, text).otherwise(F.col("line")).alias("line"))


def goroutines(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Goroutines with the same frames (arguments and addresses aside): keys, signature, n, states, first_pos, top."""
    header = r"^goroutine (\d+) \[([^\],]+)"
    dump = records(lines, F.col("line").rlike(header), keys).where("record > 0 and trim(line) != ''")
    dump = carry(dump, F.col("line").rlike(header), F.regexp_extract("line", header, 2), keys, "state")
    frame = F.regexp_replace(F.regexp_replace("line", r"\([^()]*\)$|\(0x[^)]*\)", "()"), r" \+0x[0-9a-f]+$|0x[0-9a-f]+|in goroutine \d+", "")
    frames = F.array_sort(F.collect_list(F.struct("pos", frame.alias("f"))))
    blocks = dump.groupBy(*keys, "record").agg(
        F.min("pos").alias("pos"), F.first("state").alias("state"), F.transform(frames, lambda x: x["f"]).alias("all")
    )
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    blocks = blocks.withColumn("signature", F.array_join(rest, "\n")).withColumn("top", F.try_element_at(rest, F.lit(1)))
    return blocks.groupBy(*keys, "signature").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("state")), ", ").alias("states"),
        F.min("pos").cast("long").alias("first_pos"),
        F.first("top").alias("top"),
    )


def group_goroutines(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dumps of at least two goroutines: the first stays; of others with the same frames (arguments and addresses aside) the
    first one's frames stay, under a header with their number and states. What isn't a frame stays."""
    header = r"^goroutine (\d+)(?: [^\[]*)? \[([^\]]*)\]:$"
    file = r"^\s+\S+\.go:\d+(?: \+0x[0-9a-f]+)?$"
    order = Window.partitionBy(*keys).orderBy("pos")
    after = F.coalesce(F.lead("line").over(order).rlike(file), F.lit(False))
    frame = F.col("line").rlike(file) | (after & F.col("line").rlike(r"^\S")) | F.trim("line").isin("...additional frames elided...")
    marked = lines.withColumn("__head", F.col("line").rlike(header)).withColumn("__frame", frame)
    marked = records(marked, F.col("__head"), keys)
    inside = Window.partitionBy(*keys, "record").orderBy("pos")
    other = F.count_if(~F.col("__head") & ~F.col("__frame")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__in", (F.col("record") > 0) & (other == 0))
    same = F.regexp_replace(F.regexp_replace("line", r"\([^()]*\)$|\(0x[^)]*\)", "()"), r" \+0x[0-9a-f]+$|0x[0-9a-f]+| in goroutine \d+", "")
    frames = F.array_sort(F.collect_list(F.when(~F.col("__head"), F.struct("pos", same.alias("f")))))
    blocks = marked.where("__in").groupBy(*keys, "record").agg(
        F.max(F.when(F.col("__head"), F.regexp_extract("line", header, 2))).alias("__state"),
        F.array_join(F.transform(frames, lambda x: x["f"]), "\n").alias("__same"),
    )
    # the first one is a group of its own
    group = Window.partitionBy(*keys, "__same", F.col("record") == 1)
    blocks = (
        blocks.withColumn("__n", F.count("*").over(group))
        .withColumn("__rep", F.min("record").over(group))
        .withColumn("__states", F.array_join(F.array_sort(F.collect_set("__state").over(group)), ", "))
        .drop("__same", "__state")
    )
    out = marked.join(blocks, [*keys, "record"], "left").where("not __in or record = __rep")
    title = F.concat(F.col("__n").cast("string"), F.lit(" goroutines ["), "__states", F.lit("]:"))
    line = F.when(F.col("__in") & F.col("__head") & (F.col("__n") > 1), title).otherwise(F.col("line"))
    return out.select(*keys, "pos", line.alias("line"))
