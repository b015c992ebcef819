"""Mixing sources to target weights along a time-varying curriculum.

A source's weight at training time t in [0, 1] is ``weight * (1 + tilt * (2 t - 1))``: over the whole run it integrates
to ``weight``. Targets share ``share`` of all words by these integrals; none exceeds ``most`` times its source's words,
what is over goes to the others by weight. A source's documents stand in a fixed pseudo-random order; its demand up to
time t is ``target * ((1 - tilt) t + tilt t^2)`` words, and inverting that at the words before a document gives the
document's position. The order starts again when a source is used up. The mix is sorted by position by ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import n_words, squeezed, staged


EVERY = Window.unboundedPreceding, Window.unboundedFollowing


def tilt_of(rank: Column) -> Column:
    """The curriculum that is used unless another is given: sources by turns early (-0.5), even (0) and late (0.5)."""
    return (rank % 3 - 1) * F.lit(0.5)


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``sources(name, source, source_size)`` with weight, tilt and target. One row a source; no document is read.
    Sources are what a mix has weights for, hundreds or thousands, so their windows may be one task's.

    Sources come by code point, null last, and take ``weights`` in turn. A source is capped when its cap's ratio to its
    weight lies below the level at which the others share the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(*EVERY)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    level = (F.col("need") - F.col("capped")) / F.col("weights_left")
    return (
        ranked.withColumn("need", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the first source in this order whose cap is above its level ends the capped ones
        .withColumn("own_level", F.when(cap > level * F.col("weight"), level))
        .withColumn("level", F.first("own_level", ignorenulls=True).over(by_ratio.rowsBetween(*EVERY)))
        .withColumn(
            "target",
            F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight"))),
        )
        .select("name", "source_size", "rank", "weight", "target")
    )


def position(words: Column, target: Column, tilt: Column) -> Column:
    """Training time at which a source's demand has reached ``words``."""
    y = words / target  # abs: no negative zero
    return F.when(tilt == 0, y).otherwise(F.abs((F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y) - (1 - tilt)) / (2 * tilt)))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    cells: int = 1024,
    tilt=tilt_of,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: ``keep``, size, source_size, target, taken, passes, position, positions.

    ``size`` counts words (what ASCII white space separates; a null text has 0). ``taken`` is how many words the mix
    takes: the source's order is read through again and again until the target, rounded to whole words, is reached, so
    one document of a source may be taken in part. ``passes`` is the number of whole copies that fits this best (a part
    of at least half counts). ``position`` is the first training time, null for what isn't taken; ``positions`` has one
    for each pass.

    Order within a source: the md5 of the id as text, a space and the text's md5. Repeated rows are taken like any others; a null
    id counts as the text ''; a null source is a source. Documents without words take nothing. Each source is dealt to
    ``cells`` cells, so no task holds a whole source: running sums are over cells, then in a cell. Other columns don't
    enter the result. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    names = [f"__k{i}" for i in range(len(keep))]
    rows = staged(
        docs.select(
            *[F.col(k).alias(a) for k, a in zip(keep, names, strict=True)],
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("name"),  # never null
            key.alias("key"),
            squeezed(text).alias("__w"),
        )
        .select(
            *names,
            "source",
            "name",
            "key",
            n_words(F.col("__w")).alias("size"),
            (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * cells / 2**32).cast("int").alias("cell"),
        ),
        "word-counts",
    )
    per_cell = rows.groupBy("name", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"))
    sources = per_cell.groupBy("name").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size"))
    planned = targets(sources, weights, share, most).withColumn("tilt", tilt(F.col("rank")).cast("double"))
    earlier = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("cells_before", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
    plan = per_cell.join(planned, "name").select("name", "cell", "cells_before", "source_size", "target", "tilt")
    in_cell = Window.partitionBy("name", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(in_cell), F.lit(0))).join(plan, ["name", "cell"])
    start = F.col("cells_before") + F.col("in_cell")
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("goal") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    out = (
        placed.withColumn("start", start)
        .withColumn("goal", goal)
        .withColumn("whole", whole)
        .withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))
        .withColumn(
            "passes", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
        )
        .select(
            *[F.col(x).alias(k) for k, x in zip(keep, names, strict=True)],
            "size",
            "source_size",
            "target",
            "taken",
            "passes",
            F.when(
                F.col("taken") > 0, F.round(position(F.col("start").cast("double"), F.col("target"), F.col("tilt")), 9)
            ).alias("position"),
            F.when(
                F.col("passes") > 0,
                F.transform(
                    F.sequence(F.lit(0), F.col("passes") - 1),
                    lambda k: position((F.col("start") + k * F.col("source_size")).cast("double"), F.col("target"), F.col("tilt")),
                ),
            ).alias("positions"),
        )
    )
    # What isn't taken has no position: it stands after the rest, dealt over as many ranges as it needs.
    place = F.coalesce("position", F.lit(1.5) + F.xxhash64(F.monotonically_increasing_id()) / F.lit(2.0**65))
    return out.withColumn("__at", place).repartitionByRange("__at").sortWithinPartitions("__at").drop("__at")


SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5(concat_ws(' ', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) as k from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as rank
  from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][rank % 3 + 1] as weight from s),
f as (
  select *, sum(source_size) over () * 1.5::double as need,
    coalesce(sum(source_size * 2.0::double) over (order by source_size / weight, rank
      rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, rank
      rows between unbounded preceding and 1 preceding), 0) as weights_left from w),
l as (
  select *, first_value(case when source_size * 2.0::double > (need - capped) / weights_left * weight
    then (need - capped) / weights_left end ignore nulls) over (order by source_size / weight, rank
      rows between unbounded preceding and unbounded following) as level from f),
t as (
  select *, case when level is null then source_size * 2.0::double
    else least(source_size * 2.0::double, level * weight) end as target, (rank % 3 - 1) * 0.5::double as tilt from l),
p as (
  select doc_id, size, source_size, target, tilt, round(target)::bigint as goal,
    coalesce(sum(size) over (partition by d.source order by k rows between unbounded preceding and 1 preceding), 0)
      as start
  from d join t on d.source is not distinct from t.source),
q as (
  select *, case when source_size > 0 then goal // source_size else 0 end as whole from p),
r as (
  select *, (whole * size + greatest(0, least(size, goal - whole * source_size - start)))::bigint as taken from q)
select doc_id, size, source_size, target, taken,
  case when size > 0 then floor(taken / size + 0.5) else 0 end::int as passes,
  case when taken > 0 then round(case when tilt = 0 then start / target else
    abs((sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (start / target)) - (1 - tilt)) / (2 * tilt)) end, 9) end as position
from r"""
