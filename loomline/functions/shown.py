"""Column expressions on single lines and numbers: cuts, what a line is for, and how figures are written.

Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomline.functions.classify import NORMAL, level, log_level
from loomline.functions.text import strip_ansi


def shorten_bytes(line: Column, most: int) -> Column:
    """The longest start of whole characters within ``most`` bytes of UTF-8."""
    raw = F.encode(line, "UTF-8")
    at = lambda k: F.hex(F.substring(raw, k, 1))
    whole = lambda k: ~at(k + 1).between("80", "BF")  # the byte after k begins a character
    end = F.when(whole(most), most).when(whole(most - 1), most - 1).when(whole(most - 2), most - 2).otherwise(most - 3)
    cut = F.decode(F.substring(raw, F.lit(1), F.greatest(end, F.lit(0))), "UTF-8")
    return F.when(F.octet_length(line) <= most, line).otherwise(cut)


def around(line: Column, pattern: str, width: int = 160, longest: int = 200) -> Column:
    """Lines above ``longest``: ``width`` characters around the first match (the start without one), ellipses where it's cut."""
    at = F.greatest(F.regexp_instr(line, F.lit(pattern)), F.lit(1))
    size = F.length(F.regexp_substr(line, F.lit(pattern)))
    begin = at - F.floor((width - F.least(F.coalesce(size, F.lit(0)), F.lit(width))) / 2).cast("int")
    begin = F.greatest(F.lit(1), F.least(begin, F.length(line) - width + 1))
    held = F.substring(line, begin, F.lit(width))
    left, right = F.when(begin > 1, "…").otherwise(""), F.when(begin + width <= F.length(line), "…").otherwise("")
    return F.when(F.length(line) > longest, F.concat(left, held, right)).otherwise(line)


def looks_binary(text: Column, head: int = 1 << 16) -> Column:
    """More than eight zero characters in the head, or three tenths of it control or replacement characters."""
    sample = F.left(text, F.lit(head))
    bad = F.regexp_count(sample, F.lit(r"[\x01-\x07\x0e-\x1a\x1c-\x1f\x7f�]"))
    return (F.regexp_count(sample, F.lit(r"\x00")) > 8) | (bad * 10 > F.length(sample) * 3)


# Levels and keys that call for attention.
ALARM_LEVELS = ("warn", "warning", "error", "fatal", "critical", "severe", "w", "e", "f")
ALARM = r'(?i)\b(?:lvl|level|severity)=(?:crit|critical|alert|emerg|fatal|error|eror|warn)\b|"level":\s*(?:[4-6]0)\b'


def alarming(line: Column) -> Column:
    """A level of warning or above, an error or a warning by its words, or such a key; of numbered levels 40, 50 and 60."""
    return log_level(line).isin(*ALARM_LEVELS) | (level(line) != NORMAL) | line.rlike(ALARM)


# How test runners, linters and compilers sum up.
SUMMARY = (
    r"^(?:ok  |FAIL)\t\S|^\[\d[\d,]* passed\b|^Test Suites: |^Tests: +\d|^ *(?:Test Files|Tests|Errors) {2,}\d"
    r"|^ ❯ \S.* \(\d+ tests?\b.*\)|^ {2}\d+ (?:passing|failing|pending)\b|^=+ .*\bin \d+(?:\.\d+)?s\b.*=+$"
    r"|^\d+ (?:passed|failed|errors?|skipped|xfailed|xpassed|deselected)\b.*\bin \d+(?:\.\d+)?s\b"
    r"|^Found \d+ errors?\b|^✖ \d+ problems?\b|^test result: |^error: (?:test failed|could not compile)\b"
    r"|^warning: `[^`]+` \(.*\) generated \d+ warnings?"
)


def is_summary(line: Column) -> Column:
    return line.rlike(SUMMARY)


# How a program asks.
PROMPT = (
    r"(?i)(?:[?:>]\s*(?:[\[(][^\n]{0,40}[\])]\s*)?|[\[(]\s*y(?:es)?\s*/\s*no?\s*[\])]\s*|password:?\s*"
    r"|\b(?:press|hit)\s+(?:enter|return|any key)\b[^\n]{0,40})$"
)


def prompt(text: Column, longest: int = 200) -> Column:
    """The last line, if it asks for something and no line end follows; else null."""
    last = F.element_at(F.split(text, "\n", -1), -1)
    last = strip_ansi(F.element_at(F.split(F.regexp_replace(last, "\r+$", ""), "\r", -1), -1))
    asks = (F.trim(last) != "") & (F.length(last) <= longest) & ~last.rlike(r"[\x00-\x08\x0a-\x1f]") & last.rlike(PROMPT)
    return F.when(asks, last)


#: Options that ask for output that programs read.
MACHINE = (
    r"^(?:--json(?:=.*)?|--porcelain(?:=.*)?|-z|--null|-0|--print0|-print0|--format=(?:json|csv|xml|yaml|ndjson).*"
    r"|--output=(?:json|yaml|name|jsonpath.*|wide-json)|-o(?:json|yaml|name)|--message-format=.*|--reporter=json|--csv|--xml|--tsv)$"
)


def machine_readable(argv: Column) -> Column:
    """An option before ``--`` asks for output that programs read; ``-o json`` and ``--format json`` count as one."""
    end = F.array_position(argv, "--")
    own = F.when(end > 0, F.slice(argv, 1, F.greatest(end - 1, F.lit(1)).cast("int"))).otherwise(argv)
    pairs = F.transform(own, lambda a, i: F.when(F.get(own, i - 1).isin("-o", "--output", "--format", "--reporter"), a))
    return (end != 1) & (F.exists(own, lambda a: a.rlike(MACHINE)) | F.exists(pairs, lambda a: F.coalesce(a.rlike("^(?:json|yaml|xml|csv|ndjson|name)$"), F.lit(False))))


def human(n: Column) -> Column:
    """1234 as 1.2k, 5600000 as 5.6M; whole below a thousand."""
    size = F.abs(n)
    one = lambda by, sign: F.concat(F.format_string("%.1f", n / by), F.lit(sign))
    return F.when(size >= 999950, one(1e6, "M")).when(size >= 1000, one(1e3, "k")).otherwise(n.cast("string"))


def receipt(n_raw: Column, n_out: Column, saved: Column, *notes: Column) -> Column:
    """``[120→30 lines (−75%) · note]``; null notes are left out."""
    pct = F.floor(saved * 100 + 0.5).cast("string")
    head = F.concat(F.lit("["), F.format_number(n_raw, 0), F.lit("→"), F.format_number(n_out, 0), F.lit(" lines (−"), pct, F.lit("%)"))
    return F.concat(F.concat_ws(" · ", head, *notes), F.lit("]"))


BARS = "▁▂▃▄▅▆▇█"


def bar(value: Column, top: Column) -> Column:
    """A value's bar of eight heights against ``top``; a dot for none."""
    height = F.least(F.lit(len(BARS)), F.floor(value * (len(BARS) - 1) / top).cast("int") + 1)
    return F.when((value <= 0) | (top <= 0) | value.isNull() | top.isNull(), "·").otherwise(F.substring(F.lit(BARS), height, F.lit(1)))


def sparkline(df, day: str, value: str, keys: tuple[str, ...] = ()):
    """keys, line: a row's days in order as bars against the largest. ``df`` has one row a day."""
    marked = df.withColumn("__b", bar(F.col(value), F.max(value).over(Window.partitionBy(*keys))))
    held = F.array_sort(F.collect_list(F.struct(day, "__b")))
    return marked.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["__b"]), "").alias("line"))
