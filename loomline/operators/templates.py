"""Log templates: records with one masked form, their variable slots, and the greedy merge of near forms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.classify import ERR, is_log, level, log_level
from loomline.functions.text import mask

KEYS = ("run_id",)

#: A run is a log from so many lines on, if 6 of 10 look like records.
MIN_LINES = 40
MAX_SCAN = 200
MAX_VALUES = 64


def log_gate(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, n_lines (not blank), n_log, is_log_run."""
    full = F.trim("line") != ""
    return (
        lines.groupBy(*keys)
        .agg(F.count_if(full).alias("n_lines"), F.count_if(full & is_log(F.col("line"))).alias("n_log"))
        .withColumn("is_log_run", (F.col("n_lines") >= MIN_LINES) & (F.col("n_log") * 10 >= F.col("n_lines") * 6))
    )


def exact(lines: DataFrame, keys: Sequence[str] = KEYS, graded: str | None = None) -> DataFrame:
    """One row per masked line: cnt, first_pos, last_pos, example, is_err. Null lines are none; of lines that stand at one
    position, repeated rows, any is the example. ``graded`` names a column that holds the lines' level already."""
    found = level(F.col("line")) if graded is None else F.col(graded)
    return (
        lines.where("line is not null")
        .withColumn("template", mask(F.col("line")))
        .groupBy(*keys, "template")
        .agg(
            F.count("*").alias("cnt"),
            F.min("pos").cast("long").alias("first_pos"),
            F.max("pos").cast("long").alias("last_pos"),
            F.min_by("line", "pos").alias("example"),
            (F.max(found) == ERR).alias("is_err"),
        )
    )


def slots(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per template and slot (token whose mask differs): distinct values, numeric range, the most frequent value.

    Ties between values go to the one seen first.
    """
    tokens = F.split("line", " ", -1)
    masked = lines.withColumn("template", mask(F.col("line"))).select(
        *keys, "pos", "template", F.posexplode(tokens).alias("slot", "value")
    )
    varied = masked.where(mask(F.col("value")) != F.col("value"))
    values = varied.groupBy(*keys, "template", "slot", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    number = F.try_to_number(F.regexp_extract("value", r"^-?[0-9]+", 0), F.lit("S999999999999999999")).cast("long")
    return values.groupBy(*keys, "template", "slot").agg(
        F.count("*").alias("n_values"),
        F.sum("n").alias("n"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.min_by("value", F.struct(-F.col("n"), F.col("first"))).alias("top"),
        (F.count("*") > MAX_VALUES).alias("overflow"),
    )


def categorical(slot_stats: DataFrame, most: int = 4) -> DataFrame:
    """Slots with 2 to ``most`` values that on average stand at least twice."""
    return slot_stats.where((F.col("n_values") >= 2) & (F.col("n_values") <= most) & (F.col("n_values") * 2 <= F.col("n")))


def _is_word(token: str) -> bool:
    return any(c.isascii() and c.isalpha() for c in token) and not any(c.isdigit() or c == "<" for c in token)


def _merge(rows: list[tuple[list[str], int, int]]) -> list[list]:
    """Greedy merge of distinct heads in order of first sight: [tokens, cnt, first_pos, members]."""
    out: list[list] = []
    for toks, n, first in rows:
        word = [_is_word(t) for t in toks]
        best, best_share = None, -1.0
        for t in out[:MAX_SCAN]:
            seen = equal = 0
            for mine, other, is_word, was_word in zip(toks, t[0], word, t[4], strict=True):
                if is_word or was_word:
                    seen += 1
                    equal += mine == other
            share = equal / seen if seen else 1.0
            if share >= (1 if seen <= 2 else 0.5) and share > best_share:
                best, best_share = t, share
        if best is None:
            out.append([list(toks), n, first, 1, word])
        else:
            best[0] = [a if a == b else "<*>" for a, b in zip(best[0], toks, strict=True)]
            best[1] += n
            best[3] += 1
    return out


def merged(lines: DataFrame, keys: Sequence[str] = KEYS, graded: str | None = None) -> DataFrame:
    """Templates after the merge: template, cnt, first_pos, n_forms, example, is_err.

    Equal masked lines are aggregated first, so the ordered merge sees distinct forms only. It runs by key (level, class,
    number of tokens, first two words), for which it is independent: rows are partitioned and sorted by it and read as a
    stream, so a task holds the templates of one key, and Spark sizes the tasks. Errors only merge with equal words. Null
    lines are none; an empty table gives none.
    """
    forms = exact(lines, keys, graded).withColumn("toks", F.split("template", " ", -1))
    words = F.filter("toks", lambda t: t.rlike("^[^0-9<]*[A-Za-z][^0-9<]*$"))
    group = F.concat_ws(
        "\x01",
        log_level(F.col("template")),
        F.col("is_err").cast("string"),
        F.size("toks").cast("string"),
        F.when(F.col("is_err"), F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, 1, 2), " ")),
    )
    cols = [*keys, "grp", "toks", "cnt", "first_pos", "example", "is_err"]
    rows = forms.withColumn("grp", group).select(*cols)
    dealt = rows.repartition(*keys, "grp").sortWithinPartitions(*keys, "grp", "first_pos", "example")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    names = [*keys, "template", "cnt", "first_pos", "n_forms", "example", "is_err"]

    def out(key: tuple, group: list, like: pa.RecordBatch) -> pa.RecordBatch:
        found = _merge([(x["toks"], x["cnt"], x["first_pos"]) for x in group])
        examples = {x["first_pos"]: x["example"] for x in reversed(group)}
        n = len(found)
        heads = [pa.array([v] * n, like.schema.field(k).type) for k, v in zip(keys, key, strict=False)]
        return pa.RecordBatch.from_arrays(
            [
                *heads,
                pa.array([" ".join(t[0]) for t in found], pa.string()),
                pa.array([t[1] for t in found], pa.int64()),
                pa.array([t[2] for t in found], pa.int64()),
                pa.array([t[3] for t in found], pa.int64()),
                pa.array([examples[t[2]] for t in found], pa.string()),
                pa.array([group[0]["is_err"]] * n, pa.bool_()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, ready, batch = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in (*keys, "grp"))
                if group and own != key:
                    ready.append(out(key, group, batch))
                    group = []
                key = own
                group.append(row)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if group:
            yield out(key, group, batch)

    return dealt.mapInArrow(
        run, f"{kinds}, template string, cnt long, first_pos long, n_forms long, example string, is_err boolean"
    )


def pick(templates: DataFrame, budget: int, cost: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Which templates fit: errors first, then the rarest and the most frequent in turn; a prefix of this order, so the
    running cost decides."""
    rare = F.row_number().over(Window.partitionBy(*keys, "is_err").orderBy("cnt", "first_pos"))
    often = F.row_number().over(Window.partitionBy(*keys, "is_err").orderBy(F.desc("cnt"), "first_pos"))
    turn = F.when(F.col("is_err"), F.col("first_pos")).otherwise(F.least(2 * often, 2 * rare + 1))
    order = Window.partitionBy(*keys).orderBy(F.desc("is_err"), "__turn", "first_pos")
    return (
        templates.withColumn("__turn", turn)
        .withColumn("used", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
        .withColumn("shown", F.col("used") <= budget)
        .drop("__turn")
    )
