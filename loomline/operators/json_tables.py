"""JSON documents as tables: arrays of like objects, and maps of them, as one line for the keys and one an item.

Everything is an expression over a document's own items, so no row leaves its partition. Values are read as text; nested
ones stay JSON. Nulls and texts that hold no such array give a null view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of a cell, of a constant and of a long array is shown, and when addresses go.
CELL, INLINE, MOST, SHOWN, URLS = 80, 40, 30, 20, 10
ADDRESS_KEY = r"^(?:_links|url|href|.*_url)$"


def items(text: Column) -> Column:
    """array<map<string,string>>: an array's objects; of a root object with at least three members that are all objects, each
    member with its name as ``(key)``. Null for any other text."""
    trimmed = F.trim(text)
    several = F.from_json(trimmed, "array<map<string,string>>")
    parts = F.map_entries(F.from_json(trimmed, "map<string,string>"))
    whole = (F.size(parts) >= 3) & F.forall(parts, lambda e: e["value"].startswith("{"))
    members = F.transform(
        parts, lambda e: F.map_concat(F.create_map(F.lit("(key)"), e["key"]), F.map_filter(F.from_json(e["value"], "map<string,string>"), lambda k, _: k != "(key)"))
    )
    found = F.when(trimmed.startswith("["), several).when(trimmed.startswith("{") & whole, members)
    return F.when(F.forall(found, lambda m: m.isNotNull() & (F.size(m) > 0)), found)


def cell(value: Column) -> Column:
    """At most 80 characters on one line; long objects and arrays by their sizes, nothing for a missing value."""
    flat = value
    for sign, put in (("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        flat = F.replace(flat, F.lit(sign), F.lit(put))
    n_keys = F.size(F.from_json(value, "map<string,string>"))
    n_items = F.size(F.from_json(value, "array<string>"))
    long = F.length(value) > INLINE
    cut = F.when(F.length(flat) > CELL, F.concat(F.left(flat, F.lit(CELL - 1)), F.lit("…"))).otherwise(flat)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(long & value.startswith("{") & (n_keys > 0), F.concat(F.lit("{…"), n_keys.cast("string"), F.lit(" keys}")))
        .when(long & value.startswith("[") & (n_items > 0), F.concat(F.lit("["), n_items.cast("string"), F.lit(" items]")))
        .otherwise(cut)
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row: a generator keeps projections above it from taking its expression over."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def json_view(df: DataFrame, column: str, name: str = "view") -> DataFrame:
    """``df`` with ``name``: the table of the document in ``column``, null if it holds none.

    A table has at least three objects, each with four fifths of the common keys (those of at least half the objects).
    Columns of addresses go if there are at least ten addresses. A key with one short value in all objects is written once.
    Of more than 30 items 20 are shown, with the number of the others.
    """
    held = _once(df, "__items", items(F.col(column)))
    n = F.size("__items")
    keys = F.array_distinct(F.flatten(F.transform("__items", F.map_keys)))
    held = _once(held, "__keys", F.transform(keys, lambda k: F.struct(
        k.alias("k"),
        F.filter(F.transform("__items", lambda m: F.struct(F.map_contains_key(m, k).alias("has"), m[k].alias("v"))), lambda x: x["has"]).alias("vs"),
    )))
    held = _once(held, "__common", F.transform(F.filter("__keys", lambda x: F.size(x["vs"]) * 2 >= n), lambda x: x["k"]))
    alike = F.forall("__items", lambda m: F.size(F.array_intersect(F.map_keys(m), F.col("__common"))) * 10 >= F.size("__common") * 8)
    is_table = (n >= 3) & (F.size("__common") > 0) & alike
    is_address = lambda v: v.isNull() | v.rlike("^(?:https?://|/|\\{)")
    address = lambda x: x["k"].rlike(ADDRESS_KEY) & F.forall(x["vs"], lambda y: is_address(y["v"]))
    n_addresses = F.size(F.filter(F.flatten(F.transform(F.filter("__keys", address), lambda x: x["vs"])), lambda y: y["v"].isNotNull()))
    held = _once(held, "__many", n_addresses >= URLS)
    held = _once(held, "__own", F.filter("__keys", lambda x: ~(F.col("__many") & address(x))))
    first = lambda x: x["vs"][0]["v"]
    constant = lambda x: (F.size(x["vs"]) == n) & F.coalesce(F.length(first(x)) <= INLINE, F.lit(True)) & F.forall(x["vs"], lambda y: y["v"].eqNullSafe(first(x)))
    held = _once(held, "__same", F.transform(F.filter("__own", constant), lambda x: F.concat(x["k"], F.lit("="), F.when(first(x).isNull(), F.lit("null")).otherwise(cell(first(x))))))
    held = _once(held, "__keep", F.transform(F.filter("__own", lambda x: ~constant(x)), lambda x: x["k"]))
    rows = F.transform(
        F.slice("__items", 1, F.when(n > MOST, F.lit(SHOWN)).otherwise(F.greatest(n, F.lit(1)))),
        lambda m: F.array_join(F.transform("__keep", lambda k: cell(m[k])), " | "),
    )
    lines = F.concat(
        F.array(F.concat(F.lit("[table: "), n.cast("string"), F.lit(" items]"))),
        F.when(F.size("__keep") > 0, F.array(F.concat(F.lit("keys: "), F.array_join("__keep", ", ")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("__same") > 0, F.array(F.concat(F.lit("all: "), F.array_join("__same", ", ")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("__keep") > 0, rows).otherwise(F.array().cast("array<string>")),
        F.when(n > MOST, F.array(F.concat(F.lit("… +"), (n - SHOWN).cast("string"), F.lit(" more items")))).otherwise(F.array().cast("array<string>")),
    )
    view = F.when(is_table, F.array_join(lines, "\n")).alias(name)
    return held.select(*[c for c in df.columns if c != name], view)
