"""Path lists: what is one, recursive listings as paths, and lists factored by directory.

Operators take ``lines(run_id, pos, line)`` or ``paths(run_id, pos, path)``. Null lines are no paths; a path given twice
counts twice; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id",)

NUMBERED = r"^(.*?)([0-9]{1,9})([^0-9]*)$"


def is_path_like(line: Column) -> Column:
    """No signs that paths seldom hold, no blanks at the ends or twice, a letter or digit; with a blank, a slash after it or
    an extension at the end."""
    plain = ~line.rlike(r'[\t:"<>|*?;`\\]|  | -> |^\s|\s$') & line.rlike(r"[\p{L}\p{Nd}]") & (F.length(line) <= 1024)
    return plain & (~line.contains(" ") | line.rlike(r" [^/]*/|\.[A-Za-z][A-Za-z0-9]{0,7}$"))


def path_lists(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, n (lines that aren't blank), n_like, n_slash, n_spaced, is_list: at least four lines, four fifths of them like
    paths, of these half with a slash and at most a fifth with a blank."""
    line, like = F.col("line"), is_path_like(F.col("line"))
    found = lines.where(F.trim("line") != "").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(like).alias("n_like"),
        F.count_if(like & line.contains("/")).alias("n_slash"),
        F.count_if(like & line.contains(" ")).alias("n_spaced"),
    )
    good = (F.col("n_like") * 10 >= F.col("n") * 8) & (F.col("n_slash") * 2 >= F.col("n_like")) & (F.col("n_spaced") * 5 <= F.col("n_like"))
    return found.withColumn("is_list", (F.col("n") >= 4) & good)


def recursive_listing(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, path of listings by directory: a heading ends with a colon and comes first or after a blank line; the
    names below it are its own. Runs without heading, with fewer than four names or more than a twentieth of other lines give
    none. Names above the first heading keep no directory."""
    w = Window.partitionBy(*keys).orderBy("pos")
    blank = F.trim("line") == ""
    bare = F.regexp_replace("line", ":$", "")
    fresh = F.coalesce(F.lag(blank).over(w), F.lit(True))
    heading = fresh & F.col("line").endswith(":") & (is_path_like(bare) | bare.rlike(r"^\.{1,2}/?$"))
    rows = lines.where("line is not null").withColumn("__head", heading).withColumn("__dir", F.when(F.col("__head"), bare))
    rows = rows.withColumn("__dir", F.last("__dir", ignorenulls=True).over(w)).where(~blank)
    name = ~F.col("__head") & is_path_like(F.col("line")) & ~F.col("line").contains("/")
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("__name", name).withColumn("__n", F.count_if("__name").over(whole))
    rows = rows.withColumn("__bad", F.count_if(~F.col("__name") & ~F.col("__head")).over(whole)).withColumn(
        "__heads", F.count_if("__head").over(whole)
    )
    rows = rows.where("__name and __heads > 0 and __n >= 4 and __bad * 20 <= __n")
    path = F.when(F.col("__dir").isNull(), F.col("line")).otherwise(F.concat(F.regexp_replace("__dir", "/$", ""), F.lit("/"), "line"))
    return rows.select(*keys, "pos", path.alias("path"))


def factored(paths: DataFrame, keys: Sequence[str] = KEYS, heavy: int = 20, siblings: int = 6) -> DataFrame:
    """keys, directory, n_files, first_pos, shown: one row a directory. At least ``siblings`` names that differ in one number
    are one item, ``stem{low..high}end`` if gapless, else ``stem*end (n)``. Up to ``heavy`` items are listed by name, more are
    counted by extension. A directory's items are never gathered beyond ``heavy``."""
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = paths.where("path is not null").select(
        *keys, "pos", directory.alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("__name")
    )
    number = F.try_to_number(F.nullif(F.regexp_extract("__name", NUMBERED, 2), F.lit("")), F.lit("999999999")).cast("long")
    rows = rows.withColumn("__stem", F.regexp_extract("__name", NUMBERED, 1)).withColumn("__end", F.regexp_extract("__name", NUMBERED, 3))
    rows = rows.withColumn("__number", number)
    by = [*keys, "directory"]
    # numbered names first: one row for each family of them, whatever its size
    distinct = rows.groupBy(*by, "__name", "__stem", "__end", "__number").agg(F.count("*").alias("__k"), F.min("pos").alias("pos"))
    family = Window.partitionBy(*by, "__stem", "__end", F.col("__number").isNull())
    distinct = (
        distinct.withColumn("__n", F.count("*").over(family))
        .withColumn("__low", F.min("__number").over(family))
        .withColumn("__high", F.max("__number").over(family))
    )
    text = lambda c: F.col(c).cast("string")
    range_ = F.concat("__stem", F.lit("{"), text("__low"), F.lit(".."), text("__high"), F.lit("}"), "__end")
    count = F.concat("__stem", F.lit("*"), "__end", F.lit(" ("), text("__n"), F.lit(")"))
    several = F.col("__number").isNotNull() & (F.col("__n") >= siblings)
    item = F.when(several, F.when(F.col("__high") - F.col("__low") + 1 == F.col("__n"), range_).otherwise(count)).otherwise(F.col("__name"))
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("__name", r"[^.]\.([0-9A-Za-z]+)$", 1)), F.lit("")), F.lit("other"))
    items = distinct.withColumn("__item", item).withColumn("__ext", ext)
    items = items.groupBy(*by, "__item", "__ext").agg(F.sum("__k").alias("__k"), F.min("pos").alias("pos"))
    order = Window.partitionBy(*by).orderBy("__item", "__ext")
    items = items.withColumn("__i", F.row_number().over(order)).withColumn("__k", F.col("__k").cast("long"))
    by_ext = items.groupBy(*by, "__ext").agg(
        F.sum("__k").alias("__k"), F.min("pos").alias("pos"), F.count("*").alias("__items"),
        F.collect_list(F.when(F.col("__i") <= heavy, F.struct("__i", "__item"))).alias("__held"),
    )
    ends = F.array_sort(F.collect_list(F.struct((-F.col("__k")).alias("k"), F.col("__ext").alias("e"))))
    out = by_ext.groupBy(*by).agg(
        F.sum("__k").alias("n_files"), F.min("pos").alias("first_pos"), F.sum("__items").alias("__items"),
        F.array_sort(F.flatten(F.collect_list("__held"))).alias("__held"), ends.alias("__ends"),
    )
    names = F.array_join(F.transform("__held", lambda x: x["__item"]), ", ")
    counts = F.array_join(F.transform("__ends", lambda x: F.concat(x["e"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    shown = F.when(F.col("__items") <= heavy, names).otherwise(F.concat(F.lit("["), text("n_files"), F.lit(" files: "), counts, F.lit("]")))
    return out.select(*by, "n_files", "first_pos", shown.alias("shown"))


def factored_lines(paths: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, pos, line: the factored list in the order in which directories come first."""
    head = F.when(F.col("directory") == "", F.lit("")).otherwise(F.concat("directory", F.lit("/: ")))
    return factored(paths, keys).select(*keys, F.col("first_pos").cast("int").alias("pos"), F.concat(head, "shown").alias("line"))
