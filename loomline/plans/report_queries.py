"""The registered queries over readers' reports: captures made of all events, a run a user, read as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.readers import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def captures(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """lines(run_id, pos, line): each event of a user gives the lines of ``text``, an expression that both engines read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    found = events.select(F.col("user_id").alias("run_id"), at.alias("at"), F.split(F.expr(text), "\n").alias("ls"))
    return found.select("run_id", "at", F.posexplode("ls").alias("i", "line")).select("run_id", (F.col("at") * 100 + F.col("i")).alias("pos"), "line")


def lines_sql(text: str) -> str:
    return f"""lines as (select run_id, nth * 100 + unnest(range(len(ls))) as pos, unnest(ls) as line from (
      select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as nth,
      string_split({text}, chr(10)) as ls from events))"""


GO_TEST = """case event_type
  when 'click' then concat('=== RUN   TestA', event_id, chr(10), '--- PASS: TestA', event_id, ' (0.01s)')
  when 'error' then concat('--- FAIL: TestB', event_id, ' (0.2s)', chr(10), '    b_test.go:', event_id % 90, ': got ', event_id % 7, chr(10), '        want 3')
  when 'purchase' then concat('FAIL', chr(9), 'example.com/p', event_id % 11, chr(9), '0.3s')
  when 'signup' then concat('--- SKIP: TestC', event_id, ' (0.00s)', chr(10), 'ok  ', chr(9), 'example.com/q', event_id % 5, chr(9), '0.1s')
  else concat('?   ', chr(9), 'example.com/r', chr(9), '[no test files]') end"""
SEEN = "regexp_extract(line, '^(ok|FAIL|\\?)\\s+(\\S+)(?:\\s+(.*))?$', {})"
TEST = "regexp_extract(line, '^\\s*--- (PASS|FAIL|SKIP): (\\S+) \\(([0-9.]+)s\\)', {})"


@query(
    f"""with {lines_sql(GO_TEST)}, k as (select run_id, {SEEN.format(1)} as k, {TEST.format(1)} as t from lines)
    select run_id, count(*) filter (k = 'ok') as n_ok, count(*) filter (k = 'FAIL') as n_fail, count(*) filter (k = '?') as n_without,
      count(*) filter (t = 'PASS') as n_passed, count(*) filter (t = 'FAIL') as n_failed, count(*) filter (t = 'SKIP') as n_skipped
    from k where k <> '' or t <> '' group by 1"""
)
def go_test_summary(spark, sf_dir):
    return R.go_test_summary(captures(spark, sf_dir, GO_TEST))


@query(
    f"""with {lines_sql(GO_TEST)},
    v as (select run_id, pos, {SEEN.format(2)} as package from lines where {SEEN.format(1)} <> ''),
    f as (select run_id, pos, {TEST.format(2)} as test from lines where {TEST.format(1)} = 'FAIL')
    select f.run_id, f.pos, test, (select arg_min(v.package, v.pos) from v where v.run_id = f.run_id and v.pos > f.pos) as package,
      (select string_agg(l.line, chr(10) order by l.pos) from lines l where l.run_id = f.run_id and l.pos between f.pos + 1 and f.pos + 2) as output
    from f"""
)
def go_test_failures(spark, sf_dir):
    return R.go_test_failures(captures(spark, sf_dir, GO_TEST))


PYTEST = """case event_type
  when 'error' then concat('FAILED tests/test_', event_id % 9, '.py::test_', event_id, ' - AssertionError: ', event_id % 4)
  when 'purchase' then concat('ERROR tests/test_', event_id % 9, '.py')
  when 'signup' then concat('=== ', event_id % 5 + 1, ' failed, ', event_id % 90, ' passed, 1 skipped in 0.5', event_id % 10, 's ===')
  else concat('tests/test_', event_id % 9, '.py ....') end"""


@query(
    f"""with {lines_sql(PYTEST)}, e as (select run_id, arg_max(line, pos) as line from lines where regexp_matches(line, '^=== .* in ') group by 1)
    select run_id, regexp_extract(line, '(\\d+) passed', 1)::bigint as n_passed, regexp_extract(line, '(\\d+) failed', 1)::bigint as n_failed,
      0::bigint as n_errors, regexp_extract(line, '(\\d+) skipped', 1)::bigint as n_skipped from e"""
)
def pytest_summary(spark, sf_dir):
    return R.pytest_summary(captures(spark, sf_dir, PYTEST))


@query(
    f"""with {lines_sql(PYTEST)} select run_id, pos, split_part(line, ' ', 1) as state, regexp_extract(line, 'tests/test_\\d\\.py') as file,
      regexp_extract(line, '::(\\S+)', 1) as test, regexp_extract(line, ' - (.*)', 1) as message from lines
    where line like 'FAILED %' or line like 'ERROR %'"""
)
def pytest_failures(spark, sf_dir):
    return R.pytest_failures(captures(spark, sf_dir, PYTEST))


STATUS = """case event_type
  when 'error' then 'Changes to be committed:' when 'signup' then 'Untracked files:'
  when 'purchase' then concat('Changes not staged for commit:', chr(10), '  (use "git add" to update)')
  when 'click' then concat(chr(9), 'modified:   src/f', event_id % 40, '.go', chr(10), chr(9), 'renamed:    a', event_id, ' -> b', event_id)
  else concat(chr(9), 'notes/n', event_id, '.txt') end"""


@query(
    f"""with {lines_sql(STATUS)}, h as (select *, case when line like 'Changes to be%' then 'staged' when line like 'Untracked%' then 'untracked'
      when line like 'Changes not%' then 'unstaged' end as h from lines),
    a as (select *, last_value(h ignore nulls) over (partition by run_id order by pos) as area from h)
    select run_id, pos, area, case when line like chr(9) || 'modified%' then 'modified' when line like chr(9) || 'renamed%' then 'renamed' else area end as state,
      case when line like chr(9) || 'modified%' then regexp_extract(line, 'src/\\S+') when line like chr(9) || 'renamed%'
        then regexp_extract(line, '-> (\\S+)', 1) else ltrim(line, chr(9)) end as path,
      nullif(regexp_extract(line, '(\\S+) ->', 1), '') as source
    from a where line like chr(9) || '%' and area is not null"""
)
def git_status_entries(spark, sf_dir):
    return R.git_status(captures(spark, sf_dir, STATUS))


DIFF = """case event_type
  when 'error' then concat('diff --git a/s', event_id, '.go b/s', event_id, '.go', chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/s', event_id, '.go')
  when 'signup' then concat('diff --git a/t', event_id, ' b/t', event_id, chr(10), 'index 1..2', chr(10), '--- a/t', event_id, chr(10), '+++ b/t', event_id)
  when 'purchase' then concat('@@ -1,2 +1,3 @@', chr(10), ' same', chr(10), '+++ more', chr(10), '-less')
  when 'click' then concat('@@ -9 +9 @@ f', chr(10), '+new ', event_id)
  else ' context' end"""


@query(
    f"""with {lines_sql(DIFF)},
    b as (select *, count(*) filter (line like 'diff --git %') over (partition by run_id order by pos) as block from lines),
    c as (select *, count(*) filter (line like '@@ %') over (partition by run_id, block order by pos) as hunk from b where block > 0)
    select run_id, max(case when line like 'diff --git %' then regexp_extract(line, ' b/(.*)$', 1) end) as file,
      case when bool_or(line like 'new file mode%') then 'new' else 'changed' end as kind, max(hunk) as n_hunks,
      count(*) filter (hunk > 0 and line like '+%') as n_added, count(*) filter (hunk > 0 and line like '-%') as n_removed
    from c group by run_id, block"""
)
def git_diff_files(spark, sf_dir):
    return R.git_diff(captures(spark, sf_dir, DIFF))


LOG = """case event_type
  when 'view' then '' when 'click' then concat('    More on ', event_id)
  else concat('commit ', substr(md5(cast(event_id as string)), 1, 12), chr(10), 'Author: User ', event_id % 6, ' <u@example.com>', chr(10), 'Date: now', chr(10), '',
    chr(10), '    Change ', event_id) end"""


@query(
    f"""with {lines_sql(LOG)}, b as (select *, count(*) filter (line like 'commit %') over (partition by run_id order by pos) as block from lines)
    select run_id, min(pos) as pos, max(case when line like 'commit %' then substr(line, 8) end) as sha,
      max(case when line like 'Author:%' then regexp_extract(line, 'Author: (.*) <', 1) end) as author,
      arg_min(substr(line, 5), pos) filter (line like '    %') as subject, count(*) filter (line like '    %') as n_lines
    from b where block > 0 group by run_id, block"""
)
def git_log_commits(spark, sf_dir):
    return R.git_log(captures(spark, sf_dir, LOG))


TSC = """case event_type when 'error' then concat('src/a', event_id % 30, '.ts(', event_id % 200, ',', event_id % 80, '): error TS', 2300 + event_id % 9, ': Type ', event_id % 3)
  when 'purchase' then concat('src/b.ts(1,2): warning TS6133: unused ', event_id) else concat('Found ', event_id, ' files') end"""
PLACED = "regexp_extract(line, '^(\\S+?)\\((\\d+),(\\d+)\\): (error|warning) (TS\\d+): (.*)$', {})"


@query(
    f"""with {lines_sql(TSC)}, d as (select run_id, pos, {PLACED.format(1)} as file, {PLACED.format(4)} as severity, {PLACED.format(5)} as code,
      {PLACED.format(6)} as message from lines where {PLACED.format(5)} <> '')
    select run_id, code, severity, count(*) as n, count(distinct file) as n_files, arg_min(message, pos) as example from d group by 1, 2, 3"""
)
def tsc_by_code(spark, sf_dir):
    return R.by_kind(R.tsc(captures(spark, sf_dir, TSC)), "code")


ESLINT = """case event_type when 'signup' then concat('/srv/app/m', event_id % 20, '.js')
  when 'error' then concat('  ', event_id % 300, ':', event_id % 70, '  error    Missing name ', event_id % 4, '  no-undef')
  when 'click' then concat('  ', event_id % 300, ':7  warning  Long line  max-len') else '' end"""


@query(
    f"""with {lines_sql(ESLINT)}, f as (select *, last_value(case when line like '/srv/%' then line end ignore nulls) over (partition by run_id order by pos) as file from lines)
    select run_id, pos, file, regexp_extract(line, '(\\d+):', 1)::bigint as at_line, regexp_extract(line, ':(\\d+)', 1)::bigint as at_column,
      regexp_extract(line, 'error|warning') as severity, regexp_extract(line, '(Missing name \\d|Long line)', 1) as message,
      regexp_extract(line, '\\S+$') as rule from f where line like '  %'"""
)
def eslint_rows(spark, sf_dir):
    return R.eslint(captures(spark, sf_dir, ESLINT))


CC = """case event_type when 'error' then concat('src/m', event_id % 12, '.c:', event_id % 500, ':', event_id % 60, ': error: no member ', event_id % 6)
  when 'purchase' then concat('src/n.c:3:', event_id % 9, ': warning: unused variable') when 'click' then concat('gcc -c f', event_id, '.c') else 'make: Nothing' end"""


@query(
    f"""with {lines_sql(CC)} select run_id, pos, split_part(line, ':', 1) as file, split_part(line, ':', 2)::bigint as at_line,
      split_part(line, ':', 3)::bigint as at_column, trim(split_part(line, ':', 4)) as severity, trim(split_part(line, ':', 5)) as message
    from lines where line like 'src/%'"""
)
def cc_diagnostics(spark, sf_dir):
    return R.cc(captures(spark, sf_dir, CC))


SEARCH = """case event_type when 'view' then '--' when 'signup' then concat('pkg/d', event_id % 8, '/f', event_id % 30, '.go-', event_id % 400, '-context')
  else concat('pkg/d', event_id % 8, '/f', event_id % 30, '.go:', event_id % 400, ':func x', event_id % 5, '() {') end"""


@query(
    f"""with {lines_sql(SEARCH)}, m as (select run_id, split_part(line, ':', 1) as file from lines where regexp_matches(line, '^[^:]+:\\d+:'))
    select run_id, regexp_extract(file, '^(.*)/', 1) as directory, count(distinct file) as n_files, count(*) as n_hits from m group by 1, 2"""
)
def search_directories(spark, sf_dir):
    return R.search_files(R.search(captures(spark, sf_dir, SEARCH)))


DU = """case event_type when 'view' then concat(event_id % 900, chr(9), './v', event_id) when 'click' then concat(event_id % 50, '.5M', chr(9), './c', event_id)
  when 'error' then 'du: cannot read' else concat(event_id % 9, 'G', chr(9), './g', event_id) end"""


@query(
    f"""with {lines_sql(DU)} select run_id, pos, split_part(line, chr(9), 2) as path,
      round(regexp_extract(line, '^[0-9.]+')::double * case when line like '%M' || chr(9) || '%' then 1048576 when line like '%G' || chr(9) || '%' then 1073741824 else 1024 end)::bigint as bytes
    from lines where line not like 'du:%'"""
)
def du_sizes(spark, sf_dir):
    return R.du(captures(spark, sf_dir, DU))


TRACE = """case event_type when 'error' then concat('Traceback (most recent call last):', chr(10), '  File "/srv/a.py", line ', event_id % 70, ', in main', chr(10), '    run()', chr(10),
    '  File "/srv/b', event_id % 5, '.py", line 9, in run', chr(10), '    raise', chr(10), 'ValueError: bad ', event_id % 13) else concat('step ', event_id) end"""


@query(
    f"""with {lines_sql(TRACE)} select l.run_id, l.pos, 'ValueError' as error, regexp_extract(e.line, ': (.*)', 1) as message, 2::bigint as n_frames,
      regexp_extract(f.line, '"(.*)"', 1) as file, 9::bigint as at_line, 'run' as function
    from lines l join lines e on e.run_id = l.run_id and e.pos = l.pos + 5 join lines f on f.run_id = l.run_id and f.pos = l.pos + 3
    where l.line like 'Traceback%'"""
)
def python_tracebacks(spark, sf_dir):
    return R.tracebacks(captures(spark, sf_dir, TRACE))
