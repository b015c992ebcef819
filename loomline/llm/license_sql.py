"""DuckDB SQL for the license scan: the plain definition, without the join's filters.

A block is a line, or the words from a place of a template's word on, as many as the template's span."""

from __future__ import annotations

from loomline.llm.license_scan import BASE_PHRASES, TEMPLATES, template_spans, template_words

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(threshold: float = 0.9) -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    phrases = []
    for p, label in BASE_PHRASES.items():
        ws = p.split()
        test = " and ".join(f"w[i{f' + {k}' if k else ''}] = '{x}'" for k, x in enumerate(ws))
        phrases.append((label, f"list_filter(range(1, len(w) + 1), lambda i: {test})"))
    spans = template_spans(TEMPLATES)
    templates = ", ".join(
        f"{{'label': '{k}', 'words': {quoted(v)}, 'span': {spans[k]}}}" for k, v in template_words(TEMPLATES).items()
    )
    found = ", ".join(f"{e} as p{i}" for i, (_, e) in enumerate(phrases))
    every = "list_concat(" + ", ".join(f"p{i}" for i in range(len(phrases))) + ")"
    every = every if len(phrases) > 1 else "p0"
    labels = ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, (label, _) in enumerate(phrases))
    return f"""
with t as (
  select doc_id, {LOWER.format("coalesce(text, '')")} as t from documents),
w as (
  select doc_id, {WORDS.format("t")} as w,
    list_transform(string_split(t, chr(10)), lambda b: {WORDS.format("b")}) as blocks from t),
p as (
  select doc_id, w, {found},
    list_filter(list_transform([{templates}], lambda x: {{'label': x.label, 'c': list_max(list_transform(list_concat(blocks,
      case when len(list_intersect(x.words, w)) >= {threshold} * len(x.words) then list_transform(
        list_filter(range(1, len(w) + 1), lambda i: list_contains(x.words, w[i])), lambda i: w[i:i + x.span - 1]) else [] end),
      lambda b: len(list_intersect(x.words, b)) / len(x.words)::double))}}), lambda x: x.c >= {threshold}) as h from w),
q as (
  select doc_id, len(w)::bigint as n_words, {every} as s, list_filter([{labels}], lambda x: x is not null) as b, h from p)
select doc_id, n_words, len(s)::bigint as n_base, (list_min(s) - 1)::bigint as first_word,
  (list_max(s) - 1)::bigint as last_word, coalesce(array_to_string(list_sort(list_distinct(b)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b, list_transform(h, lambda x: x.label)))), ','), '') as labels,
  case when len(s) > 0 then 1.0 else coalesce(list_max(list_transform(h, lambda x: x.c)), 0.0) end::double as score
from q"""
