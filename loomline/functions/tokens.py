"""Token estimates without a tokenizer.

A text falls into words (with one character before them), numbers of up to three digits, runs of other signs (with the
line ends after them) and white space; each kind has its cost curve, and the sum is rounded once. Texts are long and
their pieces repeat, so the estimate is an Arrow function that knows the cost of a piece it has seen; as a column
expression it would price each piece anew, in an interpreted lambda.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\t\n\x0b\f\r \x85\p{Z}"
#: Contraction; word with its lead; number; signs with a space before and line ends after; white space.
PIECE = (
    r"'(?:[rR][eE]|[vV][eE]|[lL][lL]|[sStTmMdD])"
    r"|[^\r\n\p{L}\p{N}]?\p{L}+"
    r"|\p{N}{1,3}"
    rf"| ?[^{BLANK}\p{{L}}\p{{N}}]+[\r\n]*"
    rf"|[{BLANK}]*[\r\n]"
    rf"|[{BLANK}]+(?![^{BLANK}])"
    rf"|[{BLANK}]"
)
#: Prices that a worker keeps at most; then it begins anew.
MOST_PRICES = 500_000

_PIECE = regex.compile(PIECE)
_CONTRACTION = regex.compile(r"'(?:[rR][eE]|[vV][eE]|[lL][lL]|[sStTmMdD])")
_LETTER = regex.compile(r"\p{L}")
_LEAD = regex.compile(r"^[^\p{L}]")
_UPPER = regex.compile(r"\p{Lu}+")
_PLAIN = regex.compile(rf"\p{{N}}|[{BLANK}]+$")
_REPEATED = regex.compile(r"([\x00-\x7F])\1{2,}|[^\x00-\x7F]")


# Fixed values, in the next two functions: what a word and a run of signs cost.
def word_cost(piece: str) -> float:
    word = _LEAD.sub("", piece)
    n = len(word)
    if not word.isascii():
        return max(1.0, n * 0.9)
    upper = _UPPER.fullmatch(word) is not None
    if upper and n > 2:
        base = n * 0.55
    elif n <= 4 or upper and n > 1:
        base = 1.0
    else:
        base = (n - 4) * 0.12 + 1 if n <= 8 else (n - 8) * 0.2 + 1.5
    if not upper and _UPPER.match(word):
        base *= 1.12
    return base + 0.3 if piece[0] != " " and not _LETTER.match(piece) else base


def sign_cost(piece: str) -> float:
    signs = piece[1:] if piece.startswith(" ") else piece
    signs = signs.rstrip("\r\n")
    # three or more of the same sign count once
    units = len(_REPEATED.sub(lambda m: m[1] or "", signs))
    two = sum("\x80" <= c <= "߿" for c in signs)
    three = sum("ࠀ" <= c <= "￿" for c in signs)
    four = sum(c > "￿" for c in signs)
    base = (units - 3) * 0.5 + 1 if units > 3 else 1.0 if units else 0.0
    return max(1.0, base + two + three * 1.6 + four * 2.5)


def piece_cost(piece: str) -> float:
    if _CONTRACTION.fullmatch(piece):
        return 1.0
    if _LETTER.search(piece):
        return word_cost(piece)
    return 1.0 if _PLAIN.match(piece) else sign_cost(piece)


class Prices(dict):
    def __missing__(self, piece: str) -> float:
        if len(self) >= MOST_PRICES:
            self.clear()
        cost = self[piece] = piece_cost(piece)
        return cost


def text_cost(text: str, prices: Prices) -> int:
    """Pieces are added in order, so that rounding doesn't depend on the plan."""
    total = 0.0
    for cost in map(prices.__getitem__, _PIECE.findall(text)):
        total += cost
    return int(total + 0.5)


def estimate(text: Column) -> Column:
    """Estimated tokens of a text; 0 for a null one."""

    @F.pandas_udf("int")
    def estimated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prices = Prices()
        for texts in batches:
            yield pd.Series([text_cost(t, prices) if t else 0 for t in texts], dtype="int32")

    return estimated(text)


def quarter_bytes(text: Column) -> Column:
    """The plain estimate: bytes by four, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("int")
