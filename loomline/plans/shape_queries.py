"""The registered queries over shapes of output: paths, JSON tables, detection, cuts of lines, and further reports.

Captures are made of all events, a run a user; the SQL states each result without the operator's steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import shown, text
from loomline.operators import paths
from loomline.operators.json_tables import json_view
from loomline.plans.report_queries import captures, lines_sql
from loomline.readers import assign, detect, reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


LISTED = """case event_type when 'click' then concat('src/m', event_id % 7, '/f', event_id % 40, '.go')
  when 'view' then case when user_id % 3 = 0 then concat('note: ', event_id) else concat('lib/a b', event_id % 5, '.txt') end
  when 'error' then '' else concat('top', event_id % 9, '.md') end"""


@query(
    f"""with {lines_sql(LISTED)}, c as (select run_id, count(*) as n, count(*) filter (line not like 'note%') as n_like,
      count(*) filter (line like '%/%') as n_slash, count(*) filter (line like 'lib/a b%') as n_spaced from lines where line <> '' group by 1)
    select *, n >= 4 and n_like * 10 >= n * 8 and n_slash * 2 >= n_like and n_spaced * 5 <= n_like as is_list from c"""
)
def path_lists(spark, sf_dir):
    return paths.path_lists(captures(spark, sf_dir, LISTED))


NESTED = "concat('./d', event_id % 9, ':', chr(10), 'f', event_id, '.txt', chr(10), 'g', event_id % 5, chr(10), '')"


@query(
    """with e as (select user_id as run_id, event_id, row_number() over (partition by user_id order by ts, event_id) as nth,
      count(*) over (partition by user_id) as n from events)
    select run_id, nth * 100 + i as pos, concat('./d', event_id % 9, case i when 1 then concat('/f', event_id, '.txt') else concat('/g', event_id % 5) end) as path
    from e, (select unnest([1, 2]) as i) where n >= 2"""
)
def recursive_listing(spark, sf_dir):
    return paths.recursive_listing(captures(spark, sf_dir, NESTED))


FILED = """concat(case event_type when 'click' then 'src/numbered/p' when 'view' then 'src/gaps/n' else concat('src/', event_type, '/') end,
  case event_type when 'click' then concat(event_id % 12, '.png') when 'view' then concat(event_id % 300) when 'error' then concat(chr(cast(97 + event_id % 26 as int)), 'x.go')
  when 'signup' then concat(chr(cast(97 + event_id % 3 as int)), '.md') else concat(chr(cast(97 + event_id % 25 as int)), case when event_id % 2 = 0 then '.py' else '' end) end)"""


@query(
    f"""with f as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) * 100 as pos,
      {FILED.replace('as int', 'as integer')} as path from events),
    s as (select run_id, pos, regexp_extract(path, '^(.*)/', 1) as directory, regexp_extract(path, '([^/]*)$', 1) as name from f),
    t as (select *, regexp_extract(name, '^(.*?)([0-9]+)([^0-9]*)$', 1) as stem, try_cast(regexp_extract(name, '^(.*?)([0-9]+)([^0-9]*)$', 2) as bigint) as num,
      regexp_extract(name, '^(.*?)([0-9]+)([^0-9]*)$', 3) as ending, lower(regexp_extract(name, '[^.]\\.([0-9A-Za-z]+)$', 1)) as ext from s),
    g as (select run_id, directory, stem, ending, count(distinct name) as n, min(num) as low, max(num) as high from t where num is not null group by all),
    i as (select t.*, case when g.n >= 6 then case when high - low + 1 = g.n then concat(g.stem, '{{', low, '..', high, '}}', g.ending)
      else concat(g.stem, '*', g.ending, ' (', g.n, ')') end else name end as item from t left join g on t.num is not null and g.run_id = t.run_id
      and g.directory = t.directory and g.stem = t.stem and g.ending = t.ending),
    d as (select run_id, directory, count(*) as n_files, min(pos) as first_pos, count(distinct item) as n_items,
      string_agg(distinct item, ', ' order by item) as names from i group by all),
    e as (select run_id, directory, string_agg(concat(ext, ' ', k), ', ' order by k desc, ext) as exts from (select run_id, directory,
      case ext when '' then 'other' else ext end as ext, count(*) as k from i group by all) group by all)
    select run_id, directory, n_files, first_pos, case when n_items <= 20 then names else concat('[', n_files, ' files: ', exts, ']') end as shown
    from d join e using (run_id, directory)"""
)
def factored_paths(spark, sf_dir):
    rows = captures(spark, sf_dir, FILED)
    return paths.factored(rows.select("run_id", "pos", F.col("line").alias("path")))


@query(
    """with o as (select o_custkey, o_orderkey as id, o_orderstatus as status, o_orderpriority as priority from orders),
    c as (select o_custkey, count(*) as n, count(distinct status) as s, count(distinct priority) as p, min(status) as s1, min(priority) as p1 from o group by 1 having n >= 3),
    r as (select o_custkey, row_number() over (partition by o_custkey order by id) as i, concat_ws(' | ', id::varchar, case when s > 1 then status end,
      case when p > 1 then priority end) as line from o join c using (o_custkey)),
    v as (select o_custkey, string_agg(line, chr(10) order by i) filter (i <= case when n > 30 then 20 else 30 end) as lines from r join c using (o_custkey) group by 1)
    select o_custkey, concat_ws(chr(10), concat('[table: ', n, ' items]'), concat('keys: ', concat_ws(', ', 'id', case when s > 1 then 'status' end, case when p > 1 then 'priority' end)),
      'all: ' || nullif(concat_ws(', ', case when s = 1 then concat('status=', s1) end, case when p = 1 then concat('priority=', p1) end), ''),
      lines, case when n > 30 then concat('… +', n - 20, ' more items') end) as view from c join v using (o_custkey)"""
)
def json_tables(spark, sf_dir):
    """Each customer's orders as one JSON document, read as a table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    docs = orders.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("doc"))
    return json_view(docs, "doc").where("view is not null").drop("doc")


MARKED = """case event_type when 'click' then concat('x', chr(10), '--- FAIL: Test', event_id, ' (0.1s)') when 'view' then concat('Test Suites: 1 failed, ', event_id, ' total')
  when 'error' then concat('src/a.ts(', event_id, ',3): error TS2304: no name') when 'purchase' then concat('test result: ok. ', event_id, ' passed') else concat('plain ', event_id) end"""


@query(
    """select event_id as run_id, case event_type when 'click' then 'go-test' when 'view' then 'jest' when 'error' then 'tsc' when 'purchase' then 'cargo' end as reader,
      case when event_type = 'error' then 'repeat' when event_type in ('click', 'view', 'purchase') then 'noise' end as kind from events"""
)
def detected_readers(spark, sf_dir):
    runs = events(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.lit("./run.sh").alias("command"), F.expr(MARKED).alias("text"))
    return detect(assign(runs)).select("run_id", "reader", "kind")


@query(
    """select doc_id, left(text, list_max(list_filter(range(0, 62), lambda k: strlen(left(text, k)) <= 61))) as cut,
      (len(text) - len(replace(text, chr(0), ''))) > 8 or len(regexp_extract_all(left(text, 65536), '[\\x01-\\x07\\x0e-\\x1a\\x1c-\\x1f\\x7f\\x{FFFD}]')) * 10 > 3 * least(len(text), 65536) as is_binary
    from documents"""
)
def line_cuts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", shown.shorten_bytes(F.col("text"), 61).alias("cut"), shown.looks_binary(F.col("text")).alias("is_binary"))


@query(
    """with m as (select item_id, text as line, case when regexp_matches(text, 'the') then strpos(text, 'the') else 1 end as hit, least(len(regexp_extract(text, 'the')), 160) as size from benchmark),
    b as (select *, greatest(1, least(hit - (160 - size) // 2, len(line) - 159)) as begin from m)
    select item_id, case when len(line) <= 200 then line else concat(case when begin > 1 then '…' else '' end, substr(line, begin, 160), case when begin + 160 <= len(line) then '…' else '' end) end as shown from b"""
)
def match_windows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", shown.around(F.col("text"), "the").alias("shown"))


SAID = """case event_type when 'click' then concat('lvl=crit worker ', event_id) when 'view' then concat('step ', event_id, ' done') when 'error' then concat('ok  ', chr(9), 'pkg/', event_id, chr(9), '1s')
  when 'purchase' then concat('Overwrite ', event_id, '? [y/N] ') else concat('WARN disk at ', event_id % 100) end"""


@query(
    f"""select event_id, event_type in ('click') or event_type not in ('view', 'error', 'purchase', 'click') as is_alarming, event_type = 'error' as is_summary,
      case when event_type = 'purchase' then {SAID} end as prompt from events"""
)
def line_purposes(spark, sf_dir):
    line = F.expr(SAID)
    return events(spark, sf_dir).select(
        "event_id", shown.alarming(line).alias("is_alarming"), shown.is_summary(line).alias("is_summary"), shown.prompt(line).alias("prompt")
    )


@query("select event_id, event_type in ('click', 'error') as is_machine from events")
def machine_options(spark, sf_dir):
    argv = F.expr("""case event_type when 'click' then array('git', 'status', concat('--porcelain=v', event_id % 3)) when 'error' then array('kubectl', 'get', '-o', 'yaml')
      when 'view' then array('grep', '--', '--json') else array('ls', '-l', cast(event_id as string)) end""")
    return events(spark, sf_dir).select("event_id", shown.machine_readable(argv).alias("is_machine"))


@query(
    """with d as (select o_orderstatus as status, o_orderdate::date as day, count(*) filter (o_orderpriority like '1%') as n from orders group by 1, 2),
    t as (select *, max(n) over (partition by status) as top from d)
    select status, string_agg(case when n <= 0 or top = 0 then '·' else substr('▁▂▃▄▅▆▇█', (n * 7 // top)::int + 1, 1) end, '' order by day) as line from t group by 1"""
)
def daily_sparkline(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("n"))
    return shown.sparkline(days, "day", "n", ("status",))


BLAME = "concat(substr(md5(concat(user_id % 5, event_type)), 1, 8), ' (User ', event_type, ' 2024-01-0', user_id % 9, ' ', event_id, ') code')"


@query(
    f"""with {lines_sql(BLAME)}, p as (select run_id, pos, substr(line, 1, 8) as sha, regexp_extract(line, '\\((User \\w+) ', 1) as author,
      regexp_extract(line, '(\\d{{4}}-\\d\\d-\\d\\d)', 1) as date, regexp_extract(line, ' (\\d+)\\)', 1)::bigint as num from lines),
    n as (select *, row_number() over (partition by run_id order by pos) - row_number() over (partition by run_id, sha order by pos) as island from p),
    g as (select run_id, sha, author, date, min(pos) as pos, min(num) as first_line, count(*) as n_lines from n group by run_id, sha, author, date, island)
    select *, pos = min(pos) over (partition by run_id, sha) as is_first from g"""
)
def blame_runs(spark, sf_dir):
    return R.blame_runs(captures(spark, sf_dir, BLAME))


LOCK = "concat(case when event_id % 2 = 0 then '+' else '-' end, 'example.com/p', event_id % 40, ' v1.', event_id % 7, ' h1:abc=')"


@query(
    """with l as (select distinct user_id as run_id, event_id % 2 = 0 as came, concat('example.com/p', event_id % 40) as package, concat('1.', event_id % 7) as version from events),
    s as (select run_id, package, came, version from l a where not exists (select 1 from l b where b.run_id = a.run_id and b.package = a.package and b.version = a.version and b.came <> a.came)),
    k as (select run_id, package, list(version) filter (came) as new, list(version) filter (not came) as old from s group by 1, 2)
    select run_id, package, 'changed' as state, old[1] as old, new[1] as new from k where len(old) = 1 and len(new) = 1
    union all select run_id, package, 'added', null, unnest(new) from k where not coalesce(len(old) = 1 and len(new) = 1, false)
    union all select run_id, package, 'removed', unnest(old), null from k where not coalesce(len(old) = 1 and len(new) = 1, false)"""
)
def lock_changes(spark, sf_dir):
    return R.lock_changes(captures(spark, sf_dir, LOCK))


ACTION = """concat('{"Action":"', case event_type when 'click' then 'run' when 'view' then 'output' when 'error' then 'fail' when 'purchase' then 'pass' else 'skip' end,
  '","Package":"p', event_id % 3, '","Test":"T', event_id % 4, '"', case when event_type = 'view' then concat(',"Output":"got ', event_id, '"') else '' end, '}')"""


@query(
    """with e as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as pos, concat('p', event_id % 3) as package, concat('T', event_id % 4) as test,
      event_type as a, event_id from events),
    s as (select run_id, package, test, coalesce(arg_max(case a when 'error' then 'fail' when 'purchase' then 'pass' else 'skip' end, pos) filter (a not in ('click', 'view')), 'unfinished') as state,
      string_agg(concat('got ', event_id), '' order by pos) filter (a = 'view') as said from e group by 1, 2, 3)
    select run_id, package, test, state, case when state in ('fail', 'unfinished') then coalesce(said, '') else '' end as output from s"""
)
def go_test_events(spark, sf_dir):
    return R.go_test_events(captures(spark, sf_dir, ACTION))


@query(
    """with e as (select user_id % 3 as run_id, case event_type when 'error' then 'Warning' else 'Normal' end as type, event_type as reason, user_id as o, max(event_id) as pos, count(*) as n from events group by 1, 2, 3, 4),
    r as (select *, count(*) over (partition by run_id) as k, row_number() over (partition by run_id, type order by pos desc) as i from e),
    h as (select run_id, reason, sum(n) as n from r where k > 60 and type = 'Normal' and i > 20 group by 1, 2)
    select run_id, sum(n)::bigint as n, string_agg(concat(reason, ' ', n::bigint), ', ' order by n desc, reason) as summary from h group by 1"""
)
def hidden_events(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        (F.col("user_id") % 3).alias("run_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "Warning").otherwise("Normal").alias("type"),
        F.col("event_type").alias("reason"), F.col("user_id").cast("string").alias("object"), F.lit("m").alias("message"),
    )
    return R.hidden_events(R.merged_events(rows))


WATCH = "case event_type when 'signup' then 'Refreshing run status every 3 seconds' else concat('step ', event_id) end"


@query(
    f"""with {lines_sql(WATCH)}, l as (select run_id, max(pos) as last, count(*) as n_refreshes from lines where line like 'Refreshing%' group by 1)
    select lines.run_id, pos, line, n_refreshes from lines join l on l.run_id = lines.run_id and pos >= last"""
)
def last_refresh(spark, sf_dir):
    return R.last_refresh(captures(spark, sf_dir, WATCH), "^Refreshing ")


KLOG = """case when event_type in ('click', 'error') or (event_type = 'view' and user_id % 2 = 0)
  then concat(case event_type when 'error' then 'E' else 'I' end, '0102 03:04:05.678901    1 a.go:', event_id, '] said') else concat('said ', event_id) end"""


@query(
    f"""with {lines_sql(KLOG)}, m as (select run_id, count(*) filter (line like '%] said') * 2 > count(*) as most from lines group by 1)
    select lines.run_id, pos, case when most and line like '%] said' then concat('[', line[1], '] ', line) else line end as line from lines join m using (run_id)"""
)
def tagged_klog(spark, sf_dir):
    return R.tagged_klog(captures(spark, sf_dir, KLOG))


COVERED = "concat(' src/f', event_id, '.ts | ', event_id % 101, ' | ', (event_id * 7) % 101, '.5 | 100 | ', (event_id * 3) % 101, ' | 1-3')"


@query(
    """with e as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) * 100 as pos, concat('src/f', event_id, '.ts') as file, (event_id % 101)::double as statements,
      (event_id * 7) % 101 + 0.5::double as branches, 100::double as functions, ((event_id * 3) % 101)::double as lines from events)
    select *, least(statements, branches, functions, lines) as least from e where least(statements, branches, functions, lines) < 80"""
)
def low_coverage(spark, sf_dir):
    return R.low_coverage(captures(spark, sf_dir, COVERED))


PLACED = """concat('see ', case event_type when 'click' then '/srv/app/' when 'view' then '/home/u/' when 'error' then 'https://e.com/srv/app/' else '/opt/srv/app/' end, 'm', event_id % 9, '.go:', event_id % 70)"""


@query(
    f"""select event_id, case event_type when 'click' then replace({PLACED}, '/srv/app/', '') when 'view' then replace({PLACED}, '/home/u/', '~/') else {PLACED} end as line from events"""
)
def relative_paths(spark, sf_dir):
    line = F.expr(PLACED)
    return events(spark, sf_dir).select("event_id", text.relativize(line, F.lit("/srv/app"), F.lit("/home/u")).alias("line"))


@query(
    """with w as (select l_orderkey % 50 as k, concat(l_shipdate::date, '  item ', l_partkey, ' status ', l_linestatus, ' at ', l_returnflag, l_linenumber) as line from lineitem),
    m as (select k, array_to_string(list_filter(regexp_extract_all(line, '\\S+'), lambda x: not regexp_matches(x, '[0-9]')), ' ') as message from w)
    select k, message, count(*) as n from m group by 1, 2"""
)
def message_kinds(spark, sf_dir):
    """Lines by their words without digits."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.concat(F.to_date("l_shipdate").cast("string"), F.lit("  item "), F.col("l_partkey").cast("string"), F.lit(" status "), "l_linestatus", F.lit(" at "), "l_returnflag", F.col("l_linenumber").cast("string"))
    return lines.select((F.col("l_orderkey") % 50).alias("k"), text.message_key(line).alias("message")).groupBy("k", "message").agg(F.count("*").alias("n"))
