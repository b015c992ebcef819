"""Operators on rows that a reader has parsed: counts, constant columns, caps, paths, JSON members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``summary``: ``value n`` for each value, the most frequent first, ties by value."""
    counts = df.groupBy(*keys, key.cast("string").alias("__v")).count()
    held = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("__v").alias("v"))))
    parts = F.transform(held, lambda x: F.concat(x["v"], F.lit(" "), (-x["n"]).cast("string")))
    return counts.groupBy(*keys).agg(F.array_join(parts, ", ").alias("summary"))


def constant_columns(df: DataFrame, least: int = 3) -> DataFrame:
    """column, value, n of the columns that have one value, never null, in all rows (at least ``least``)."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns
    ])).alias("x")).select("x.*")
    found = rows.groupBy("column").agg(
        F.count("*").alias("n"), F.count("v").alias("__known"), F.min("v").alias("value"), F.max("v").alias("__max")
    )
    return found.where((F.col("n") >= least) & (F.col("n") == F.col("__known")) & (F.col("value") == F.col("__max"))).select(
        "column", "value", "n"
    )


def top_and_rest(df: DataFrame, size: Column, tie: Column, keep: int = 30, whole: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of a group of up to ``whole``, else the ``keep`` largest, with what the others sum to on each row."""
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("__size", size)
        .withColumn("__i", F.row_number().over(w.orderBy(F.desc("__size"), tie)))
        .withColumn("__n", F.count("*").over(w))
        .withColumn("__keep", (F.col("__n") <= whole) | (F.col("__i") <= keep))
        .withColumn("n_rest", F.sum(F.when(F.col("__keep"), 0).otherwise(1)).over(w).cast("long"))
        .withColumn("size_rest", F.coalesce(F.sum(F.when(~F.col("__keep"), F.col("__size"))).over(w), F.lit(0)))
        .where("__keep")
        .drop("__size", "__i", "__n", "__keep")
    )


def capped_matches(lines: DataFrame, pattern: str, file: str, per_file: int = 15, most: int = 150, files: int = 60) -> DataFrame:
    """Matches of a search by file: at most ``per_file`` each, of the first ``files`` files with a match, ``most`` in all.

    ``n_file`` is the file's whole number of matches. The caps are the report's; the counts cover every line.
    """
    hits = lines.where(F.col("line").rlike(pattern))
    in_file = Window.partitionBy(file)
    numbered = hits.withColumn("n_file", F.count("*").over(in_file)).withColumn(
        "__i", F.row_number().over(in_file.orderBy("pos"))
    )
    shown = numbered.where(F.col("__i") <= per_file)
    first = shown.select(file).distinct().orderBy(file).limit(files)
    return shown.join(F.broadcast(first), file, "left_semi").orderBy(file, "pos").limit(most).drop("__i")


def prefixes(paths: DataFrame, path: str = "path", keys: Sequence[str] = ()) -> DataFrame:
    """prefix, depth, n_files of every directory above a file."""
    parts = F.split(path, "/", -1)
    rows = paths.select(*keys, F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("depth"), parts.alias("__p"))
    rows = rows.where(F.size("__p") > F.col("depth"))
    return (
        rows.select(*keys, F.array_join(F.slice("__p", 1, F.col("depth")), "/").alias("prefix"), "depth")
        .groupBy(*keys, "prefix", "depth")
        .agg(F.count("*").alias("n_files"))
    )


def extensions(paths: DataFrame, path: str = "path", keys: Sequence[str] = ()) -> DataFrame:
    """ext, n: files by extension; '' without one."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return paths.select(*keys, F.lower(F.regexp_extract(name, r"[^.]\.([0-9A-Za-z]+)$", 1)).alias("ext")).groupBy(*keys, "ext").agg(
        F.count("*").alias("n")
    )


def brace_ranges(names: DataFrame, name: str = "name", keys: Sequence[str] = (), least: int = 6) -> DataFrame:
    """Numbered siblings (stem, number, ending) of at least ``least``: ``stem{low..high}ending`` if gapless, else a count."""
    parts = names.select(
        *keys,
        F.regexp_extract(name, r"^(.*?)([0-9]{1,9})([^0-9]*)$", 1).alias("stem"),
        F.regexp_extract(name, r"^(.*?)([0-9]{1,9})([^0-9]*)$", 2).alias("__n"),
        F.regexp_extract(name, r"^(.*?)([0-9]{1,9})([^0-9]*)$", 3).alias("ending"),
    ).where("__n != ''")
    number = F.col("__n").cast("long")
    found = parts.groupBy(*keys, "stem", "ending").agg(
        F.countDistinct(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")
    )
    gapless = F.col("high") - F.col("low") + 1 == F.col("n")
    shown = F.concat("stem", F.lit("{"), F.col("low").cast("string"), F.lit(".."), F.col("high").cast("string"), F.lit("}"), "ending")
    return found.where(F.col("n") >= least).withColumn(
        "shown", F.when(gapless, shown).otherwise(F.concat("stem", F.lit("*"), "ending", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    )


def json_members(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """key, value (as text) of the members of each row's JSON object; rows that hold no object have none."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select(*keys, F.explode(parsed).alias("key", "value"))


def json_columns(df: DataFrame, column: str) -> DataFrame:
    """key, n, n_values, is_column (in at least half the objects), is_constant."""
    total = df.agg(F.count(column).alias("__total"))
    found = json_members(df, column).groupBy("key").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values")
    )
    return found.crossJoin(F.broadcast(total)).select(  # one row
        "key",
        "n",
        "n_values",
        (F.col("n") * 2 >= F.col("__total")).alias("is_column"),
        ((F.col("n_values") == 1) & (F.col("n") == F.col("__total"))).alias("is_constant"),
    )


def fixed_width(lines: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows of tables whose header's word starts are the columns: keys, pos, cells (array of name and text).

    Columns are cut where the header has two spaces or more.
    """
    w = Window.partitionBy(*keys)
    head = F.first("line").over(w.orderBy("pos"))
    names = F.regexp_extract_all(F.col("__h"), F.lit(r"\S+(?: \S+)*"), F.lit(0))
    rows = lines.withColumn("__h", head).where((F.col("pos") > 0) & (F.trim("line") != "")).withColumn("__n", names)
    rows = rows.withColumn("__at", F.transform("__n", start_of))
    after = F.transform(
        F.sequence(F.lit(1), F.size("__n")),
        lambda i: F.struct(
            F.element_at("__n", i).alias("name"),
            F.trim(
                F.substring(
                    "line",
                    F.element_at("__at", i),
                    F.coalesce(F.try_element_at("__at", i + 1), F.lit(1 << 20)) - F.element_at("__at", i),
                )
            ).alias("text"),
        ),
    )
    return rows.select(*keys, "pos", after.alias("cells"))


def start_of(name: Column) -> Column:
    """Where a column's name begins in the header ``__h``; a name that another holds is looked for as a whole word."""
    return F.regexp_instr(F.col("__h"), F.concat(F.lit(r"(?<!\S)\Q"), name, F.lit(r"\E(?!\S)")))
