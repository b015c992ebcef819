import pandas as pd
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import compare, templates
from loomline.readers import reports
from loomline.sources import store


def run_lines(spark, rows, run=1):
    return spark.createDataFrame([(run, i, x) for i, x in enumerate(rows)], "run_id int, pos int, line string")


def test_null_lines_make_no_template(spark):
    rows = run_lines(spark, [None, "task 11 done", None, "task 12 done", ""])
    assert {(r.template, r.cnt) for r in templates.merged(rows).collect()} == {("task <N> done", 2), ("", 1)}
    assert templates.merged(rows.limit(0)).count() == 0


def test_marks_in_a_line_stay(spark):
    cases = {"id 12 x end": "id <N> x end", "⠀ 77 ": "⠀ <N> "}
    df = spark.createDataFrame([(x,) for x in cases], "line string")
    assert {r.line: r.m for r in df.select("line", text.mask(F.col("line")).alias("m")).collect()} == cases


def test_the_guard_looks_within_longer_lines(spark):
    lines = run_lines(spark, ["error: disk full", "error: no route", "ok", None])
    view = run_lines(spark, ["  1 | error:  disk full (twice)"])
    assert [r.line for r in compare.missing_errors(lines, view).collect()] == ["error: no route"]


def test_ties_in_time(spark):
    runs = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 5), (4, "b", 5)], "run_id int, cmd string, t int")
    got = compare.previous(runs, ["cmd"], "t", F.col("run_id"))
    assert {r.run_id: r.previous for r in got.collect()} == {1: None, 2: 1, 3: 2, 4: None}


def test_a_run_stored_twice_is_read_once(spark, tmp_path):
    runs = spark.createDataFrame([(1, 10, "old"), (2, 20, "x"), (1, 30, "new")], "run_id int, t int, view string")
    store.write_runs(runs.withColumn("t", F.timestamp_seconds("t")), str(tmp_path / "s"))
    assert {r.run_id: r.view for r in store.read_runs(spark, str(tmp_path / "s")).collect()} == {1: "new", 2: "x"}


def test_reports(spark):
    go = ["--- FAIL: TestA (0.00s)", "    a_test.go:7: got 1", "    --- FAIL: TestA/sub (0.00s)", "        a_test.go:9: no", "FAIL", "FAIL\tpkg/a\t0.1s", "ok  \tpkg/b\t(cached)", None]
    rows = run_lines(spark, go)
    assert [tuple(r) for r in reports.go_test_failures(rows).orderBy("pos").collect()] == [
        (1, 0, "TestA", "pkg/a", "    a_test.go:7: got 1"), (1, 2, "TestA/sub", "pkg/a", "        a_test.go:9: no"),
    ]
    assert tuple(reports.go_test_summary(rows).first()) == (1, 1, 1, 0, 0, 2, 0)
    end = run_lines(spark, ["===== 1 failed, 12 passed, 2 warnings in 3.21s =====", "x"])
    assert tuple(reports.pytest_summary(end).first()) == (1, 12, 1, 0, 0)
    diff = ["diff --git a/x.go b/x.go", "--- a/x.go", "+++ b/x.go", "@@ -1 +1 @@", "-a", "+b", "+++c", "diff --git a/i.png b/i.png", "Binary files a/i.png and b/i.png differ"]
    assert {tuple(r) for r in reports.git_diff(run_lines(spark, diff)).collect()} == {(1, "x.go", "changed", 1, 2, 1), (1, "i.png", "binary", 0, 0, 0)}
    trace = ["Traceback (most recent call last):", '  File "a.py", line 3, in main', "    f()", '  File "b.py", line 9, in f', "    raise", "KeyError", "KeyError: later"]
    assert tuple(reports.tracebacks(run_lines(spark, trace)).first()) == (1, 0, "KeyError", "", 2, "b.py", 9, "f")
    for reader in (reports.go_test_summary, reports.go_test_failures, reports.pytest_summary, reports.pytest_failures, reports.git_status, reports.git_diff, reports.git_log, reports.tsc, reports.cc, reports.eslint, reports.search, reports.du, reports.tracebacks):
        assert isinstance(reader(rows.limit(0)).toPandas(), pd.DataFrame) and reader(run_lines(spark, [None, ""])).count() == 0
