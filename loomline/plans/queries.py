"""The registered queries over the engine's own operators, each with DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import classify, patterns as P, text
from loomline.functions.tokens import estimate, quarter_bytes
from loomline.operators import budget, compare, history, lines as L, stacks, tables, templates
from loomline.plans.condense import Options, condense
from loomline.readers import apply, assign
from loomline.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def re2(pattern: str) -> str:
    """A pattern in the dialect of RE2, quoted for SQL."""
    out = pattern.replace(P.WORD, "").replace(P.B, r"\b").replace(P.L, r"\b").replace(P.R, r"\b")
    out = out.replace("(?di)", "(?i)").replace("(?dm)", "(?m)").replace("(?d)", "")
    return out.replace("'", "''")


# Log lines made from events, in words that both engines read.
LINE = """concat({ts}, ' ', case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' else 'INFO' end, ' ',
  case event_type
    when 'error' then concat('request ', event_id, ' failed: timed out after ', event_id % 90, 'ms at api/server.go:', event_id % 7)
    when 'purchase' then concat('deprecated call by user ', user_id, ' of ', event_id % 50, 'KB')
    when 'click' then concat('0 errors in batch ', event_id, ' from 10.0.', user_id % 4, '.', event_id % 250)
    when 'signup' then concat('session 0x', event_id % 1000, 'ab of user ', user_id, ' opened')
    else concat('job ', event_id % 3, ' done in ', event_id % 1000, 'ms') end)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    line = F.expr(LINE.format(ts="date_format(ts, 'yyyy-MM-dd HH:mm:ss')"))
    return events.select(F.col("user_id").alias("run_id"), pos.cast("long").alias("pos"), line.alias("line"))


LOGS = f"""logs as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
  {LINE.format(ts="strftime(ts, '%Y-%m-%d %H:%M:%S')")} as line from events)"""

LINES = """lines as (select doc_id as run_id, unnest(range(len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))"""

SQUASHED = "trim(regexp_replace({}, '[\\s\\x0b\\x{{85}}\\pZ]+', ' ', 'g'))"

LEVEL = f"""case when trim(line) = '' then 0
  when not regexp_matches(line, '{re2(P.ERROR)}|{re2(P.WARNING)}') or regexp_matches(line, '{re2(P.PASSED)}') then 0
  when regexp_matches(line, '{re2(P.ERROR)}')
    and regexp_matches(regexp_replace(line, '{re2(P.BENIGN)}', ' ', 'g'), '{re2(P.ERROR)}') then 2
  when regexp_matches(line, '{re2(P.WARNING)}')
    and regexp_matches(regexp_replace(line, '{re2(P.BENIGN)}', ' ', 'g'), '{re2(P.WARNING)}') then 1 else 0 end"""


def mask_sql(line: str) -> str:
    p = re2(P.MASK)
    groups = [f"regexp_extract_all({line}, '{p}', {g})" for g in range(1, len(P.MASKS) + 1)]
    whens = []
    for (name, _), g in zip(P.MASKS, groups, strict=True):
        x = f"({g})[i]"
        put = f"'{name}'"
        if name == "<HEX>":
            put = f"case when not regexp_matches({x}, '[0-9]') then {x} when regexp_full_match({x}, '[0-9]+') then '<N>' else '<HEX>' end"
        elif name == "<N>":
            put = f"case when regexp_matches({x}, '[0-9][^0-9]*[0-9]') then '<N>' else {x} end"
        whens.append(f"when {x} <> '' then {put}")
    gaps = f"regexp_split_to_array({line}, '{p}')"
    return f"""concat(array_to_string(list_transform(range(1, len({groups[0]}) + 1), lambda i:
      concat(({gaps})[i], case {' '.join(whens)} else '' end)), ''), ({gaps})[-1])"""


def documents(spark, sf_dir) -> DataFrame:
    return L.explode(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "run_id"))


# --- text


@query(f"with {LINES} select run_id, pos::int as pos, line from lines")
def line_explode(spark, sf_dir):
    return documents(spark, sf_dir)


@query(
    f"""with {LINES} select run_id, count(*) as n_lines, count(*) filter (trim(line) = '') as n_blank,
    max(length(line))::bigint as longest from lines group by 1"""
)
def line_stats(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.trim("line") == "").alias("n_blank"),
        F.max(F.length("line")).cast("long").alias("longest"),
    )


@query(r"select doc_id, regexp_replace(regexp_replace(text, '(?m)[ \t]+$', '', 'g'), '\n+\z', '') as text from documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query(f"select page_id, {SQUASHED.format('html')} as html from pages")
def squash_white_space(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.squash(F.col("html")).alias("html"))


@query(
    f"""select page_id, {SQUASHED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title from pages"""
)
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query(
    """select doc_id, case when length(text) > 200 then concat(left(text, 150), '…[+', length(text) - 190, ' chars]…',
    right(text, 40)) else text end as text from documents"""
)
def shorten_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text"), 200).alias("text"))


@query(f"with {LOGS} select run_id, pos, {mask_sql('line')} as masked from logs")
def mask_line(spark, sf_dir):
    return logs(spark, sf_dir).select("run_id", "pos", text.mask(F.col("line")).alias("masked"))


@query()
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate(F.col("text")).alias("n_tokens"))


# --- classes


@query(f"with {LOGS} select run_id, pos, {LEVEL}::int as level from logs")
def classify_level(spark, sf_dir):
    return logs(spark, sf_dir).select("run_id", "pos", classify.level(F.col("line")).alias("level"))


@query(
    f"""with {LOGS} select run_id, count(*) filter (l = 1) as n_warn, count(*) filter (l = 2) as n_err
    from (select run_id, {LEVEL} as l from logs) group by 1"""
)
def warn_error_counts(spark, sf_dir):
    level = classify.level(F.col("line"))
    return logs(spark, sf_dir).groupBy("run_id").agg(
        F.count_if(level == 1).alias("n_warn"), F.count_if(level == 2).alias("n_err")
    )


@query(
    f"""with {LOGS}, g as (select run_id, count(*) as n_lines, count(*) filter (regexp_matches(left(line, 256), '{re2(P.LOG_TIME)}')
      or regexp_matches(left(line, 256), '{re2(P.LOG_LEVEL)}')) as n_log from logs where trim(line) <> '' group by 1)
    select *, n_lines >= 40 and n_log * 10 >= n_lines * 6 as is_log_run from g"""
)
def log_gate(spark, sf_dir):
    return templates.log_gate(logs(spark, sf_dir))


@query(
    f"""with {LOGS} select run_id, pos, regexp_extract(line, '{re2(P.LOG_TIME)}') as at,
    lower(regexp_extract(line, '\\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|SEVERE)\\b')) as level from logs"""
)
def record_time_level(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "run_id", "pos", classify.record_time(F.col("line")).alias("at"), classify.log_level(F.col("line")).alias("level")
    )


@query(
    f"""with {LOGS}, p as (select run_id, unnest(regexp_extract_all(line, '{re2(P.LOCATION)}')) as p from logs)
    select run_id, regexp_extract(p, '[^/]*$') as place, count(*) as n from p group by 1, 2"""
)
def location_counts(spark, sf_dir):
    places = logs(spark, sf_dir).select("run_id", F.explode(classify.locations(F.col("line"))).alias("p"))
    return places.groupBy("run_id", classify.location_key(F.col("p")).alias("place")).agg(F.count("*").alias("n"))


CUES = """case conv_id % 9 when 0 then ' Now let me verify that.' when 1 then ' I will debug this, and find the root cause.'
  when 2 then ' No need to verify.' when 3 then ' Debugging, then verify.' when 4 then ' Start the debug server.' when 5 then ' Why did the test fail?'
  when 6 then ' Do not verify or confirm it.' when 7 then ' See whether it builds; not sure, so run the whole suite again.' else '' end"""


@query(
    f"""select conv_id, turn, case when conv_id % 9 in (0, 7) then 'verify' when conv_id % 9 in (1, 5) then 'error' else 'auto' end as mode
    from (select conv_id, turn, concat(text, {CUES}) from conversations)"""
)
def mode_infer(spark, sf_dir):
    said = F.concat(F.coalesce("text", F.lit("")), F.expr(CUES))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.mode_of(said).alias("mode"))


# --- templates


TEMPLATES = f"""t as (select run_id, {mask_sql('line')} as template, line, pos, {LEVEL} as l from logs)"""


@query(
    f"""with {LOGS}, {TEMPLATES} select run_id, template, count(*) as cnt, min(pos) as first_pos, max(pos) as last_pos,
    arg_min(line, pos) as example, max(l) = 2 as is_err from t group by 1, 2"""
)
def template_exact(spark, sf_dir):
    return templates.exact(logs(spark, sf_dir))


VARS = f"""tok as (select run_id, pos, template, unnest(range(len(a))) as slot, unnest(a) as value
    from (select *, string_split(line, ' ') as a from t)),
  m as (select run_id, template, slot, value, count(*) as n, min(pos) as first from tok
    where {mask_sql('value')} <> value group by all),
  v as (select run_id, template, slot::int as slot, count(*) as n_values, sum(n)::bigint as n,
    min(try_cast(nullif(regexp_extract(value, '^-?[0-9]+'), '') as bigint)) as low,
    max(try_cast(nullif(regexp_extract(value, '^-?[0-9]+'), '') as bigint)) as high,
    arg_min(value, row(-n, first)) as top, count(*) > 64 as overflow from m group by all)"""


@query(f"with {LOGS}, {TEMPLATES}, {VARS} select * from v")
def template_vars(spark, sf_dir):
    return templates.slots(logs(spark, sf_dir))


@query(f"with {LOGS}, {TEMPLATES}, {VARS} select * from v where n_values between 2 and 4 and n_values * 2 <= n")
def template_categorical(spark, sf_dir):
    return templates.categorical(templates.slots(logs(spark, sf_dir)))


@query()
def template_merged(spark, sf_dir):
    return templates.merged(logs(spark, sf_dir))


@query(
    f"""with {LOGS}, {TEMPLATES}, e as (select run_id, template, count(*) as cnt, min(pos) as first_pos, max(l) = 2 as is_err
      from t group by 1, 2),
    r as (select *, row_number() over (partition by run_id, is_err order by cnt, first_pos) as rare,
      row_number() over (partition by run_id, is_err order by cnt desc, first_pos) as often from e),
    u as (select *, sum(ceil(strlen(template) / 4)) over (partition by run_id order by is_err desc,
      case when is_err then first_pos else least(2 * often, 2 * rare + 1) end, first_pos)::bigint as used from r)
    select run_id, template, cnt, first_pos, is_err, used, used <= 60 as shown from u"""
)
def template_pick(spark, sf_dir):
    found = templates.exact(logs(spark, sf_dir)).select("run_id", "template", "cnt", "first_pos", "is_err")
    return templates.pick(found, 60, quarter_bytes(F.col("template")))


# --- ordered lines


RUNS = """n as (select *, case when pos = 0 or k <> lag(k) over (partition by run_id order by pos) then 1 else 0 end as new
    from (select *, case when trim(line) = '' then '' else line end as k from {0})),
  i as (select *, sum(new) over (partition by run_id order by pos) as island from n)"""


@query(
    f"""with {LINES}, {RUNS.format('lines')} select run_id, min(pos)::int as pos, case when trim(arg_min(line, pos)) = '' then ''
    when count(*) = 1 then arg_min(line, pos) else concat(arg_min(line, pos), ' [×', count(*), ']') end as line, count(*) as n
    from i group by run_id, island"""
)
def collapse_runs(spark, sf_dir):
    return L.collapse_runs(documents(spark, sf_dir))


@query(
    f"""with {LOGS}, m as (select run_id, pos, line, case when strlen(line) <= 1000 and trim(line) <> ''
      and not regexp_matches(line, '{re2(P.LOCATED_LINE)}') and {LEVEL} < 2 then {mask_sql('line')} else concat('#', pos) end as k
      from logs),
    n as (select *, case when lag(k) over w is distinct from k then 1 else 0 end as new from m
      window w as (partition by run_id order by pos)),
    i as (select *, sum(new) over (partition by run_id order by pos) as island from n),
    c as (select *, count(*) over (partition by run_id, island) as c,
      row_number() over (partition by run_id, island order by pos) as j from i)
    select run_id, pos, case when c >= 4 and j = 2 then concat('… ', c - 2, ' similar lines …') else line end as line
    from c where c < 4 or j in (1, 2, c)"""
)
def collapse_similar(spark, sf_dir):
    return L.collapse_similar(logs(spark, sf_dir))


@query(
    f"""with {LOGS} select run_id, pos, sum(case when line like '%ERROR%' then 1 else 0 end)
    over (partition by run_id order by pos)::bigint as record from logs"""
)
def record_sessionize(spark, sf_dir):
    return L.records(logs(spark, sf_dir), F.col("line").contains("ERROR")).select("run_id", "pos", "record")


@query(
    f"""with {LINES} select run_id, pos::int as pos, last_value(case when length(line) < 20 then line end ignore nulls)
    over (partition by run_id order by pos) as heading from lines"""
)
def heading_carry(spark, sf_dir):
    short = F.length("line") < 20
    return L.carry(documents(spark, sf_dir), short, F.col("line")).select("run_id", "pos", "heading")


@query(
    f"""with {LOGS}, c as (select *, line like '%failed%' as hit, max(case when line like '%failed%' then 1 else 0 end) over
      (partition by run_id order by pos rows between 1 preceding and 2 following) as near from logs),
    k as (select * from c where near = 1)
    select run_id, pos, line, hit, (pos - coalesce(lag(pos) over (partition by run_id order by pos), -1) - 1)::bigint as omitted from k"""
)
def context_lines(spark, sf_dir):
    found = logs(spark, sf_dir)
    return L.gaps(L.context(found, F.col("line").contains("failed"), 2, 1))


@query(
    f"""with {LOGS}, c as (select *, {LEVEL} = 2 as hit from logs where pos between 9 and 59),
    k as (select *, row_number() over (partition by run_id order by pos) as i from c where hit)
    select run_id, pos, line, hit, (pos - coalesce(lag(pos) over (partition by run_id order by pos), -1) - 1)::bigint as omitted
    from k where i <= 5"""
)
def show_errors(spark, sf_dir):
    return L.show(logs(spark, sf_dir), errors=True, between=(10, 60), head=5)


@query(
    f"""with {LINES}, k as (select *, row_number() over (partition by run_id order by pos desc) as i from lines)
    select run_id, pos::int as pos, line, true as hit,
    (pos - coalesce(lag(pos) over (partition by run_id order by pos), -1) - 1)::bigint as omitted from k where i <= 3"""
)
def tail_select(spark, sf_dir):
    return L.show(documents(spark, sf_dir), tail=3)


# --- budgets


HEAD_TAIL = f"""with {LINES}, c as (select *, ceil(strlen(line) / 4)::int + 1 as c from lines),
    s as (select *, sum(c) over (partition by run_id) as whole, sum(c) over (partition by run_id order by pos) as front,
      sum(c) over (partition by run_id order by pos desc) as back from c)
    select run_id, pos::int as pos, line, case when whole <= 400 then 'all' when front <= 200 then 'head' else 'tail' end as side
    from s where whole <= 400 or front <= 200 or back <= 200"""


@query(HEAD_TAIL)
def head_tail_baseline(spark, sf_dir):
    return budget.head_tail(documents(spark, sf_dir), 400, quarter_bytes(F.col("line")) + 1)


@query()
def budget_pick(spark, sf_dir):
    return budget.pick(logs(spark, sf_dir), 800, failed=True)


@query(
    """with u as (select conv_id, sum(strlen(text))::bigint as used from conversations group by 1)
    select conv_id, used, case when used <= 0 then 8000 when used / 4000 >= 0.9 then 3200 when used / 4000 >= 0.75 then 4800
    when used / 4000 >= 0.5 then 6400 else 8000 end::bigint as budget from u"""
)
def pressure_budget(spark, sf_dir):
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("used"))
    return used.select(
        "conv_id", "used", budget.pressure_budget(F.lit(8000), F.col("used"), F.lit(4000)).alias("budget")
    )


@query(
    """select conv_id, turn, mode, case mode when 'error' then 12000 when 'debug' then 16000 when 'verify' then 4000
    when 'minimal' then 2000 else 8000 end::bigint as budget from (select conv_id, turn,
    ['auto', 'error', 'debug', 'verify', 'minimal'][(conv_id + turn) % 5 + 1] as mode from conversations)"""
)
def mode_budget(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in ("auto", "error", "debug", "verify", "minimal")])
    mode = F.get(names, ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", mode.alias("mode"))
    return turns.withColumn("budget", budget.mode_budget(F.lit(8000), F.col("mode")))


# --- joins


@query(
    f"""with {LOGS}, e as (select run_id, {SQUASHED.format('line')} as s, min(pos) as pos, arg_min(line, pos) as line
      from logs where {LEVEL} = 2 group by 1, 2),
    v as (select run_id, {SQUASHED.format('line')} as s from logs where pos < 20),
    x as (select run_id, pos, line, count(*) over (partition by run_id) as n_missing from e
      where not exists (select 1 from v where v.run_id = e.run_id and contains(v.s, e.s)))
    select * from x qualify row_number() over (partition by run_id order by pos) <= 40"""
)
def guard_missing(spark, sf_dir):
    found = logs(spark, sf_dir)
    return compare.missing_errors(found, found.where("pos < 20"), most=40)


@query(
    f"""with {LOGS}, p as (select run_id, pos, regexp_extract(unnest(regexp_extract_all(line, '{re2(P.LOCATION)}')), '[^/]*$') as place
      from logs) select distinct run_id, place from p anti join (select run_id, place from p where pos < 20) using (run_id, place)"""
)
def location_missing(spark, sf_dir):
    found = logs(spark, sf_dir)
    return compare.missing_locations(found, found.where("pos < 20"))


@query(
    """with a as (select o_custkey as key, max(o_orderstatus) as block from orders where o_orderdate < date '1996-01-01' group by 1),
    b as (select o_custkey as key, max(o_orderstatus) as block from orders where o_orderdate >= date '1996-01-01' group by 1)
    select coalesce(a.key, b.key) as key, case when a.key is null then 'new' when b.key is null then 'fixed'
    when a.block = b.block then 'still' else 'changed' end as state from a full join b on a.key = b.key"""
)
def delta_full_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda cond: orders.where(cond).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("block"))
    return compare.delta(of("o_orderdate < date '1996-01-01'"), of("o_orderdate >= date '1996-01-01'"))


@query(
    """with b as (select o_custkey as key, o_orderstatus as block, case when o_orderdate < date '1996-01-01' then 1 else -1 end as n
    from orders) select key, block, sum(n)::bigint as surplus from b group by 1, 2 having sum(n) <> 0"""
)
def multiset_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("block"), "o_orderdate")
    of = lambda cond: rows.where(cond).select("key", "block")
    return compare.multiset_differences(of("o_orderdate < date '1996-01-01'"), of("o_orderdate >= date '1996-01-01'"))


@query(
    f"""with {LOGS}, k as (select *, regexp_replace({SQUASHED.format('line')}, '[0-9]+', '0', 'g') as l from logs)
    select run_id, pos, line from (select * from k where pos >= 10) anti join (select run_id, l from k where pos < 10) using (run_id, l)"""
)
def unseen_lines(spark, sf_dir):
    found = logs(spark, sf_dir)
    return compare.unseen(found.where("pos >= 10"), found.where("pos < 10"))


@query(
    """select event_id, user_id, event_type, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as previous from events"""
)
def asof_previous(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return compare.previous(events, ["user_id", "event_type"], "ts", F.col("event_id"), tie="event_id").select(
        "event_id", "user_id", "event_type", "previous"
    )


@query(
    """with c as (select user_id, row_number() over (partition by user_id order by ts, event_id) as seq,
      case when event_type = 'view' then (event_id % 3)::varchar end as named,
      case when event_type = 'click' then (event_id % 3)::varchar end as touched from events)
    select a.user_id, a.seq::int as asked_at, min(b.seq)::int as acted_at from c a left join c b on a.user_id = b.user_id
      and b.seq between a.seq + 1 and a.seq + 3 and a.named = b.touched where a.named is not null group by 1, 2"""
)
def acted_within_3(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = table(spark, sf_dir, "events").withColumn("seq", seq)
    what = (F.col("event_id") % 3).cast("string")
    return compare.acted_within(
        calls, "user_id", "seq", F.when(F.col("event_type") == "view", what), F.when(F.col("event_type") == "click", what)
    )


@query(
    """with c as (select conv_id, turn, role, lead(role) over w as r, lead(turn) over w as t from conversations
      window w as (partition by conv_id order by turn))
    select conv_id, turn, case when r = 'assistant' then t end as answered_at from c where role = 'user'"""
)
def pair_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("r", F.lead("role").over(w)).withColumn("t", F.lead("turn").over(w))
    return turns.where("role = 'user'").select("conv_id", "turn", F.when(F.col("r") == "assistant", F.col("t")).alias("answered_at"))


TERMS = [("request", 1.0), ("batch", 0.75), ("opened", 0.5), ("timed", 0.25)]


@query(
    f"""with {LOGS}, terms(word, weight) as (values {', '.join(f"('{t}', {w}::double)" for t, w in TERMS)}),
    h as (select run_id, pos, word, weight from (select run_id, pos, list_distinct(regexp_extract_all(lower(line), '[0-9A-Za-z_]+')) as ws
      from logs) join terms on list_contains(ws, word)),
    n as (select run_id, count(*) as n from logs group by 1),
    broad as (select run_id, word from h join n using (run_id) group by run_id, word, n having count(*) > 10 and count(*) * 3 > n)
    select run_id, pos, sum(weight) as score from h anti join broad using (run_id, word) group by 1, 2"""
)
def focus_rank(spark, sf_dir):
    terms = spark.createDataFrame(TERMS, "term string, weight double")
    return compare.focus_rank(logs(spark, sf_dir), terms)


# --- rows


@query(
    """with m as (select doc_id as run_id, unnest(range(len(l))) as pos, unnest(l) as line, source from
      (select doc_id, source, string_split(text, chr(10)) as l from documents)),
    h as (select *, count(*) over (partition by run_id) as n_file, row_number() over (partition by run_id order by pos) as i from m
      where regexp_matches(line, 'icense')),
    f as (select distinct run_id from h where i <= 2 order by 1 limit 20)
    select run_id, pos::int as pos, line, n_file from h semi join f using (run_id) where i <= 2 order by run_id, pos limit 30"""
)
def grep_capped(spark, sf_dir):
    return tables.capped_matches(documents(spark, sf_dir), "icense", "run_id", per_file=2, most=30, files=20)


@query(
    f"""with {LINES} select run_id, count(*) as n_matches, min(pos)::int as first from lines
    where regexp_matches(line, 'icense|reserved') group by 1"""
)
def grep_histogram(spark, sf_dir):
    hits = L.show(documents(spark, sf_dir), grep="icense|reserved")
    return hits.groupBy("run_id").agg(F.count("*").alias("n_matches"), F.min("pos").alias("first"))


@query(
    """with r as (select p_type, p_partkey, p_size, count(*) over (partition by p_type) as n,
      row_number() over (partition by p_type order by p_size desc, p_partkey) as i from part)
    select p_type, p_partkey, p_size, sum(case when n > 40 and i > 30 then 1 else 0 end) over w as n_rest,
      coalesce(sum(case when n > 40 and i > 30 then p_size end) over w, 0)::bigint as size_rest
    from r window w as (partition by p_type) qualify n <= 40 or i <= 30"""
)
def topk_remainder(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    return tables.top_and_rest(part, F.col("p_size"), F.col("p_partkey"), keys=["p_type"])


@query(
    """select o_orderpriority, string_agg(concat(s, ' ', n), ', ' order by n desc, s) as summary from
    (select o_orderpriority, o_orderstatus as s, count(*) as n from orders group by 1, 2) group by 1"""
)
def count_by_status(spark, sf_dir):
    return tables.count_by(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), ["o_orderpriority"])


@query(
    """select 'x_all' as "column", 'same' as value, count(*) as n from nation having count(*) >= 3"""
)
def constant_columns(spark, sf_dir):
    return tables.constant_columns(table(spark, sf_dir, "nation").withColumn("x_all", F.lit("same")))


WIDE = "select *, l_linenumber // 100 as x_hundreds, case when l_linenumber < 7 then 1 end as x_some from lineitem"
WIDE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"
    " l_shipdate x_hundreds x_some"
).split()


@query(
    f"with w as ({WIDE}) "
    + " union all ".join(
        f"""select '{c}' as "column", min({c})::varchar as value, count(*) as n from w
    having count(*) >= 3 and count({c}) = count(*) and count(distinct {c}) = 1"""
        for c in WIDE_COLUMNS
    )
)
def constant_columns_lineitem(spark, sf_dir):
    """Over all line items, with a column that is constant by the data and one that is null in places."""
    items = table(spark, sf_dir, "lineitem")
    items = items.withColumn("x_hundreds", F.expr("l_linenumber div 100")).withColumn("x_some", F.when(F.col("l_linenumber") < 7, 1))
    return tables.constant_columns(items.select(*WIDE_COLUMNS))


PATHS = "select page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') as path from pages"


@query(
    f"""with p as ({PATHS}), s as (select string_split(path, '/') as a from p),
    d as (select a, unnest(range(1, greatest(len(a) - 1, 1) + 1)) as depth from s)
    select array_to_string(a[1:depth], '/') as prefix, depth::int as depth, count(*) as n_files from d where len(a) > depth group by 1, 2"""
)
def prefix_totals(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    return tables.prefixes(paths)


@query(
    """select lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '[^.]\\.([0-9A-Za-z]+)$', 1)) as ext,
    count(*) as n from pages group by 1"""
)
def ext_histogram(spark, sf_dir):
    return tables.extensions(table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path")))


@query(
    """with c as (select c_nationkey, c_name, c_custkey from customer),
    p as (select c_nationkey, regexp_extract(c_name, '^(.*?)([0-9]{1,9})([^0-9]*)$', 1) as stem,
      regexp_extract(c_name, '^(.*?)([0-9]{1,9})([^0-9]*)$', 2) as k, regexp_extract(c_name, '^(.*?)([0-9]{1,9})([^0-9]*)$', 3) as ending from c),
    g as (select c_nationkey, stem, ending, count(distinct k::bigint) as n, min(k::bigint) as low, max(k::bigint) as high
      from p where k <> '' group by 1, 2, 3)
    select *, case when high - low + 1 = n then concat(stem, '{', low, '..', high, '}', ending)
      else concat(stem, '*', ending, ' (', n, ')') end as shown from g where n >= 6"""
)
def brace_ranges(spark, sf_dir):
    return tables.brace_ranges(table(spark, sf_dir, "customer"), "c_name", ["c_nationkey"])


@query(
    """with m as (select key, json_extract_string(props, concat('$.', key)) as v from
      (select props, unnest(json_keys(props)) as key from events)), t as (select count(props) as n from events)
    select key, count(*) as n, count(distinct v) as n_values, count(*) * 2 >= any_value(t.n) as is_column,
      count(distinct v) = 1 and count(*) = any_value(t.n) as is_constant from m, t group by 1"""
)
def json_columns(spark, sf_dir):
    return tables.json_columns(table(spark, sf_dir, "events"), "props")


# --- histories


def runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cmd"),
        F.col("ts").alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("raw"),
        F.round(F.col("value") * 20).cast("long").alias("out"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit"),
        F.col("event_id").alias("id"),
        "user_id",
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("sec"),
    )


H = """h as (select event_type as cmd, ts as t, round(value * 100)::bigint as raw, round(value * 20)::bigint as out,
  case when event_type = 'error' then 1 else 0 end as exit, event_id as id, user_id, floor(epoch(ts))::bigint as sec from events)"""
GAIN = """count(*) as n, sum(raw)::bigint as raw, sum(out)::bigint as out, (sum(raw) - sum(out))::bigint as saved,
  case when sum(raw) > 0 then floor((sum(raw) - sum(out)) * 100 / sum(raw)) else 0 end::bigint as pct,
  count(*) filter (exit <> 0) as failures"""


@query(f"with {H} select {GAIN} from h")
def gain_summary(spark, sf_dir):
    return history.gain(runs(spark, sf_dir))


@query(f"with {H} select cmd, {GAIN} from h group by 1")
def gain_by_cmd(spark, sf_dir):
    return history.gain(runs(spark, sf_dir), ["cmd"])


@query(
    f"""with {H}, d as (select t::date + datediff('day', date '2000-01-01', t::date)::int as day, {GAIN} from h group by 1),
    s as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d)
    select strftime(s.day, '%Y-%m-%d') as day, coalesce(n, 0) as n, coalesce(raw, 0) as raw, coalesce(out, 0) as out, coalesce(saved, 0) as saved,
    coalesce(pct, 0) as pct, coalesce(failures, 0) as failures from s left join d on s.day = d.day"""
)
def gain_daily_dense(spark, sf_dir):
    """All runs, their days twice as far apart, so that each second one has none."""
    apart = F.expr("cast(date_add(cast(t as date), datediff(cast(t as date), date '2000-01-01')) as timestamp_ntz)")
    found = history.daily(runs(spark, sf_dir).withColumn("t", apart))
    return found.withColumn("day", F.col("day").cast("string"))


@query(
    f"""with {H}, d as (select t::date as day, {GAIN} from h group by 1),
    s as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d)
    select strftime(s.day, '%Y-%m-%d') as day, coalesce(n, 0) as n, coalesce(raw, 0) as raw, coalesce(out, 0) as out, coalesce(saved, 0) as saved,
    coalesce(pct, 0) as pct, coalesce(failures, 0) as failures from s left join d on s.day = d.day"""
)
def gain_daily(spark, sf_dir):
    return history.daily(runs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"with {H} select cmd, sum(raw)::bigint as raw, sum(out)::bigint as out, count(*) as n from h group by rollup (cmd)")
def totals_rollup(spark, sf_dir):
    return history.totals(runs(spark, sf_dir), "cmd", raw=F.col("raw"), out=F.col("out"))


@query(
    f"""with {H}, w as (select id, cmd, user_id, count(*) over (partition by cmd, user_id order by sec
      range between 604800 preceding and current row) as n_recent from h where exit = 1)
    select *, case when n_recent >= 4 then 2 when n_recent >= 2 then 1 else 0 end::int as level from w"""
)
def tune_levels(spark, sf_dir):
    failed = runs(spark, sf_dir).where("exit = 1")
    counted = history.regret_counts(failed, ["cmd", "user_id"], "sec").select("id", "cmd", "user_id", "n_recent")
    return counted.withColumn("level", history.regret_level(F.col("n_recent"), F.lit(0)))


@query(
    f"""with {H} select s.user_id, s.sec as asked_at, s.id as shown, case when s.sec - r.sec <= 7200 then r.id end as run
    from (select * from h where cmd = 'view') s left join lateral (select id, sec from h r where r.cmd = 'click'
      and r.user_id = s.user_id and r.sec <= s.sec order by sec desc, id desc limit 1) r on true"""
)
def regret_recalls(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return history.recalls(rows.where("cmd = 'click'"), rows.where("cmd = 'view'"), ["user_id"], "sec", minutes=120)


@query(
    f"""with {H}, r as (select id, user_id, sec, raw, row_number() over (partition by user_id order by sec desc, id desc) as i,
      sum(raw) over (partition by user_id order by sec desc, id desc rows unbounded preceding) as b, 1706000000 - sec as age from h)
    select id, user_id from r where (i <= 20 or age < 86400) and age <= 2592000 and b <= 200000"""
)
def retention(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("store", F.col("user_id"))
    kept = history.retained(rows, F.lit(1706000000), "sec", "raw", newest=20, oldest=2592000, most_bytes=200000)
    return kept.select("id", "user_id")


@query(
    """select user_id, event_id, ts from (select * from events qualify row_number() over (partition by user_id
    order by ts desc, event_id desc) = 1) order by ts desc, user_id desc limit 50"""
)
def recent_runs(spark, sf_dir):
    """The list of a store's newest runs: one a user, 50 in all."""
    return store.newest(table(spark, sf_dir, "events"), 50, "ts", "user_id", "event_id").select("user_id", "event_id", "ts")


@query(
    """select user_id, event_type, count(*) as n, arg_max(value, row(ts, event_id)) as value, max(ts) as ts from events group by 1, 2"""
)
def events_merge_latest(spark, sf_dir):
    latest = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), latest.alias("value"), F.max("ts").alias("ts")
    )


@query(
    f"""with {LOGS}, {TEMPLATES}, s as (select distinct template from t where l = 2)
    select count(distinct t.template) as n_templates, count(distinct s.template) as n_shown from t left join s using (template)"""
)
def template_coverage(spark, sf_dir):
    """How many of all templates a view of the errors alone would show."""
    found = templates.exact(logs(spark, sf_dir)).select("template", "is_err")
    shown = found.where("is_err").select(F.col("template").alias("s")).distinct()
    both = found.join(shown, F.col("template") == F.col("s"), "left")
    return both.agg(F.countDistinct("template").alias("n_templates"), F.countDistinct("s").alias("n_shown"))


TRACE = """case event_id % 9 when 0 then 'TypeError: boom' when 8 then '' else concat('    at f', event_id % 9, ' (',
  case when event_id % 9 in (1, 5) then '/srv/app/' else '/srv/node_modules/lib/' end, 'x.js:', event_id % 9, ':1)') end"""


@query()
def stack_fold(spark, sf_dir):
    line = F.expr(TRACE)
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 90).alias("run_id"), (F.col("event_id") % 90).alias("pos"), line.alias("line"))
    return stacks.fold_stacks(rows)


@query()
def condensed_views(spark, sf_dir):
    """The log of each user as one run's output, condensed."""
    raw = L.implode(logs(spark, sf_dir), name="raw")
    return condense(raw.select("run_id", F.lit("app serve").alias("command"), F.lit(0).alias("exit"), "raw"), Options(budget=2000))


@query(
    """with l as (select c_nationkey as run_id, (row_number() over (partition by c_nationkey order by c_custkey) - 1)::int as pos,
      c_custkey % 5 = 0 as own, c_name from customer),
    g as (select *, count(*) over (partition by run_id, own) as n, min(pos) over (partition by run_id, own) as first from l)
    select run_id, pos, case when own then concat('Successfully installed ', c_name) when n = 1 then
      concat('Requirement already satisfied: ', c_name) else concat('[', n, ' requirements already met]') end as line,
    'pip-install' as reader from g where own or pos = first"""
)
def reader_views(spark, sf_dir):
    """Noise readers: synthesized installer output, one run for each customer nation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Successfully installed "), "c_name")).otherwise(
        F.concat(F.lit("Requirement already satisfied: "), "c_name")
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("run_id"), (F.row_number().over(w) - 1).alias("pos"), line.alias("line")
    )
    named = assign(rows.select("run_id").distinct().withColumn("command", F.lit("sudo pip install -r all.txt")))
    return apply(rows.join(named, "run_id"))
