"""Column expressions that normalise text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions import patterns as P


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, P.ANSI, "")


def collapse_returns(text: Column) -> Column:
    """Per line what was written last: the last stretch between carriage returns that isn't blank."""

    def line(x: Column) -> Column:
        shown = F.filter(F.split(x, "\r", -1), lambda p: F.trim(F.translate(p, "\t", " ")) != "")
        return F.when(F.contains(x, F.lit("\r")), F.coalesce(F.try_element_at(shown, F.lit(-1)), F.lit(""))).otherwise(x)

    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(F.contains(plain, F.lit("\r")), F.array_join(F.transform(F.split(plain, "\n", -1), line), "\n")).otherwise(plain)


def strip_overstrikes(text: Column) -> Column:
    """A backspace takes back the character before it."""
    done = F.aggregate(
        F.split(text, ""),
        F.lit(""),
        lambda a, c: F.when(c == "\b", F.left(a, F.length(a) - 1)).otherwise(F.concat(a, c)),
    )
    return F.when(F.contains(text, F.lit("\b")), done).otherwise(text)


def trim_trailing(text: Column) -> Column:
    """No blanks at line ends, no line ends at the end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?dm)[ \t]+$", ""), r"\n+\z", "")


def clean(text: Column) -> Column:
    return trim_trailing(strip_overstrikes(collapse_returns(strip_ansi(text))))


def squash(text: Column) -> Column:
    """One space for each stretch of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0b\x85\p{Z}]+", " "))


def shorten(line: Column, most: int, error: Column | None = None) -> Column:
    """Three quarters of the head, a fifth of the tail and the number left out; an error line may be thrice as long."""
    limit = F.when(error, F.lit(3 * most)).otherwise(F.lit(most)) if error is not None else F.lit(most)
    head, tail = F.floor(limit * 3 / 4).cast("int"), F.floor(limit / 5).cast("int")
    cut = F.concat(
        F.left(line, head),
        F.lit("…[+"),
        (F.length(line) - head - tail).cast("string"),
        F.lit(" chars]…"),
        F.right(line, tail),
    )
    return F.when(F.length(line) > limit, cut).otherwise(line)


def relativize(line: Column, cwd: Column, home: Column) -> Column:
    """Paths below ``cwd`` without it, paths below ``home`` from ``~``; not within a URL or a longer path."""

    def below(text: Column, root: Column, to: str) -> Column:
        quoted = F.concat(F.lit(r"(?<![0-9A-Za-z_./:~-])\Q"), root, F.lit(r"/\E"))
        return F.when(F.coalesce(root, F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(to)))

    return below(below(line, cwd, ""), home, "~/")


#: Signs between the groups of a match while a line is masked; they are taken out of it.
MARKS = [chr(0xF8F0 + i) for i in range(len(P.MASKS) + 1)]
#: Such signs of the line itself stand for the time as this one and a second sign that no mask looks at.
ESCAPE = chr(0xF8EE)
ESCAPED = {c: ESCAPE + chr(0x2800 + i) for i, c in enumerate([ESCAPE, *MARKS])}


def _escaped(line: Column, back: bool = False) -> Column:
    out = line
    for c, put in reversed(ESCAPED.items()) if back else ESCAPED.items():
        out = F.replace(out, F.lit(put if back else c), F.lit(c if back else put))
    return F.when(line.rlike(f"[{ESCAPE}{MARKS[0]}-{MARKS[-1]}]"), out).otherwise(line)


def mask(line: Column) -> Column:
    """Times, addresses, sizes and numbers by their kind, in one pass from left to right.

    The pass writes all groups of a match behind their marks, of which one isn't empty; cheap replacements then put each
    kind's name. A hexadecimal word needs a digit, and a number at least two.
    """
    pattern = f"(?d)(?={P.MASK_START})(?:{P.MASK})"
    out = F.regexp_replace(_escaped(line), pattern, "".join(f"{m}${g}" for g, m in enumerate(MARKS[:-1], 1)) + MARKS[-1])
    for (name, _), here, after in zip(P.MASKS, MARKS[:-1], MARKS[1:], strict=True):
        if name == "<HEX>":
            out = F.regexp_replace(out, f"{here}[0-9]+(?={after})", "<N>")
            out = F.regexp_replace(out, f"{here}(?=[^{after}]*[0-9])[^{after}]+", name)
        elif name == "<N>":
            out = F.regexp_replace(out, f"{here}(?=[0-9][^{after}]*[0-9])[^{after}]+", name)
        else:
            out = F.regexp_replace(out, f"{here}[^{after}]+", name)
    out = F.regexp_replace(out, f"[{MARKS[0]}-{MARKS[-1]}]", "")
    return F.when(line.rlike("[0-9]"), _escaped(out, back=True)).otherwise(line)


def message_key(text: Column) -> Column:
    """The words without digits."""
    return F.array_join(F.filter(F.split(squash(text), " "), lambda w: ~w.rlike("[0-9]")), " ")


def html_title(html: Column) -> Column:
    return squash(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts and styles go, then all tags; the five basic character references are read."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|noscript|svg)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return squash(text)
