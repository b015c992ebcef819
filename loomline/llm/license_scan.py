"""License scans: an exact set-similarity join of text blocks with license templates, in column expressions only.

Two parts, both over whole texts:

* *base phrases*: places where the words of a phrase stand one after another;
* *templates*: a block meets a template when it holds at least ``threshold`` of the template's distinct words. Blocks are
  the lines of the text, and, as notices are wrapped over lines, all runs of consecutive words of the whole text that
  are a quarter longer than the template (the quarter is for words that lead wrapped lines, such as dnl or REM).
  Template words are ordered by their frequency in the whole corpus, rarest first. A block that meets a template must hold a word of the template's prefix (its ``|T| - need + 1`` rarest words), must have ``need`` words
  (length filter), and from the first common word on both sides must leave room for ``need`` (positional filter).
  Runs of words are looked at only in texts that hold ``need`` words at all, and where ``need`` places lie close enough.
  The filters only prune: what passes is counted exactly, so the labels don't depend on the order.

Only the template side is a literal in the plan; it is as large as the dictionary given, not as the data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of common license notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files",
    "mit-short": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = CHAR + "+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(templates: Mapping[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(re.findall(LOWER_WORD, v.lower()))) for k, v in templates.items()}


def template_spans(templates: Mapping[str, str]) -> dict[str, int]:
    """Words in a run that is held against the template."""
    return {k: math.ceil(1.25 * len(re.findall(LOWER_WORD, v.lower()))) for k, v in templates.items()}


def global_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """Template words, rarest in the corpus first. A count over all texts; at most ``|vocabulary|`` rows come back."""
    if not vocabulary:
        return []
    found = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.explode(F.split(F.lower(text_col), GAP + "+")).alias("w"))
        .where(F.col("w").isin(vocabulary))
        .groupBy("w")
        .count()
        .collect()
    )
    seen = {r["w"]: r["count"] for r in found}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _strings(values: list[str]) -> str:
    """A literal array, in SQL."""
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")" if values else "cast(array() as array<string>)"


def phrase_pattern(phrase: str) -> str:
    """Matches the first word of each place, with the others looked ahead for, so that places may overlap."""
    first, *rest = (re.escape(w) for w in re.findall(LOWER_WORD, phrase.lower()))
    return f"(?i)(?<!{CHAR}){first}" + (f"(?={''.join(f'{GAP}+{w}' for w in rest)}(?!{CHAR}))" if rest else f"(?!{CHAR})")


@dataclass(frozen=True)
class Template:
    label: str
    words: list[str]  # rarest first
    need: int
    span: int

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.need + 1]


def ordered_templates(
    table: dict[str, list[str]], spans: dict[str, int], order: list[str], threshold: float
) -> list[Template]:
    rank = {w: i for i, w in enumerate(order)}
    need = lambda ws: max(1, math.ceil(threshold * len(ws) - 1e-9))
    return [Template(k, sorted(ws, key=rank.__getitem__), need(ws), spans[k]) for k, ws in table.items() if ws]


def template_hits(text: str, templates: list[Template], order: list[str], block_sep: str) -> Column:
    """array<struct<label, containment>> of the templates that some block of the column ``text`` meets."""
    rows = ", ".join(
        f"named_struct('label', '{t.label}', 'words', {_strings(t.words)}, 'prefix', {_strings(t.prefix)}, 'need', {t.need})"
        for t in templates
    )
    prefixes = sorted({w for t in templates for w in t.prefix})
    # h: the block's template words, rarest first; c: those it shares with the template
    return F.expr(f"""
      flatten(transform(
        filter(
          transform(split({text}, r'{block_sep}'), b -> array_distinct(regexp_extract_all(
            translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'{LOWER_WORD}', 0))),
          b -> size(b) >= {min(t.need for t in templates)} and arrays_overlap(b, {_strings(prefixes)})),
        b -> transform(
          filter(
            transform(
              filter(
                transform(array({rows}), t -> named_struct('t', t, 'h', array_intersect({_strings(order)}, b))),
                x -> size(x.h) >= x.t.need and arrays_overlap(x.h, x.t.prefix)),
              x -> named_struct('t', x.t, 'h', x.h, 'c', array_intersect(x.t.words, x.h))),
            x -> 1 + least(size(x.t.words) - array_position(x.t.words, x.c[0]),
                           size(x.h) - array_position(x.h, x.c[0])) >= x.t.need and size(x.c) >= x.t.need),
          x -> named_struct('label', x.t.label, 'containment', size(x.c) / double(size(x.t.words))))))""")


def window_hits(words: str, templates: list[Template], order: list[str]) -> Column:
    """array<struct<label, containment>> of the templates that some run of words meets; ``words``: the text's words with
    one space between."""
    rows = ", ".join(
        f"named_struct('label', '{t.label}', 'words', {_strings(t.words)}, 'need', {t.need}, 'span', {t.span})" for t in templates
    )
    # x.d: template words of the text; h: places (i) of the template's words (x); n: distinct ones in the run from a place
    return F.expr(f"""
      flatten(transform(
        transform(
          array(split(translate({words}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')),
          w -> named_struct('w', w, 'd', array_intersect({_strings(order)}, w))),
        x -> filter(
          transform(
            filter(array({rows}), t -> size(array_intersect(t.words, x.d)) >= t.need),
            t -> named_struct('label', t.label, 'containment', coalesce(array_max(transform(
              array(filter(transform(x.w, (v, i) -> named_struct('i', i, 'x', v)), e -> array_contains(t.words, e.x))),
              h -> array_max(transform(
                filter(transform(h, (e, j) -> named_struct('i', e.i, 'j', j)),
                       e -> coalesce(get(h, e.j + t.need - 1).i < e.i + t.span, false)),
                e -> size(array_distinct(transform(
                  filter(slice(h, e.j + 1, t.span), g -> g.i < e.i + t.span), g -> g.x))))))), 0)
              / double(size(t.words)), 'need', t.need / double(size(t.words)))),
          r -> r.containment >= r.need - 1e-9)))""")


def license_scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = 0.9,
    block_sep: str = "\n",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per document: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases; ``first_word``/``last_word`` are their smallest and largest starts in
    words from 0. ``labels`` adds the templates that a block (a line or a run of words over lines) meets. ``score`` is the largest containment of a template
    that is met, 1 where a base phrase stands, else 0.

    A null text is an empty one: no words, no places, empty labels, score 0. Rows with equal or null ids are judged one
    by one (nothing is joined). Columns other than ``keep`` don't enter the result, whatever their names. An empty
    table gives an empty result.
    """
    table = template_words(templates)
    order = global_order(docs, text_col, sorted({w for ws in table.values() for w in ws}))
    ready = ordered_templates(table, template_spans(templates), order, threshold)
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))

    # The words with one space between. Plain byte searches in it find the few texts that the patterns and the join
    # have to look at; lower() changes more than A-Z, so it may let through too much, never too little.
    base = base.withColumn("__w", F.trim(F.regexp_replace("__t", GAP + "+", " ")))
    base = base.withColumn("__l", F.concat(F.lit(" "), F.lower("__w"), F.lit(" ")))
    n_words = F.when(F.col("__w") == "", F.lit(0)).otherwise(
        F.octet_length("__w") - F.octet_length(F.replace(F.col("__w"), F.lit(" "))) + 1
    )
    holds = lambda words: F.col("__l").contains(f" {words} ")
    any_template = reduce(or_, map(holds, sorted({w for t in ready for w in t.prefix})), F.lit(False))
    patterns = [(label, phrase_pattern(p), holds(" ".join(re.findall(LOWER_WORD, p.lower())))) for p, label in phrases.items()]
    any_phrase = reduce(or_, [x[2] for x in patterns], F.lit(False))

    def places(label: str, pattern: str, held: Column) -> Column:
        """Each match is one word, so what stands before the first and after the last place gives their word numbers."""
        pieces = F.split("__t", pattern, -1)
        return F.when(
            held & F.col("__t").rlike(pattern),
            F.struct(
                F.lit(label).alias("label"),
                (F.size(pieces) - 1).cast("long").alias("n"),
                F.regexp_count(F.element_at(pieces, 1), F.lit(WORD)).cast("long").alias("first"),
                (F.col("n_words") - F.regexp_count(F.element_at(pieces, -1), F.lit(WORD)) - 1).alias("last"),
            ),
        )

    if ready:
        runs = F.transform(window_hits("__w", ready, order), lambda x: F.struct(x["label"], x["containment"]))
        hits = F.concat(template_hits("__t", ready, order, block_sep), runs)
    counted = base.select(*keep, "__t", "__w", "__l", n_words.cast("long").alias("n_words"))
    found = counted.select(
        *keep,
        "n_words",
        F.when(any_phrase, F.array_compact(F.array(*[places(*x) for x in patterns])))
        .otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
        .alias("__p"),
        F.when(any_template, hits if ready else F.lit(None))
        .otherwise(F.array().cast("array<struct<label:string,containment:double>>"))
        .alias("__h"),
    )
    base_set = F.array_sort(F.array_distinct(F.transform("__p", lambda x: x["label"])))
    return found.select(
        *keep,
        "n_words",
        F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("__p", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("__p", lambda x: x["last"])).alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.transform("__h", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size("__p") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("__h", lambda x: x["containment"])), F.lit(0.0)))
        .alias("score"),
    )
