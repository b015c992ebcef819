import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import classify, text
from loomline.functions.tokens import estimate
from loomline.operators import budget, lines as L, stacks, tables, templates
from loomline.plans import queries
from loomline.plans.condense import Options, condense
from loomline.readers import apply, assign
from loomline.sources import store


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_mask(spark):
    cases = {
        "2024-01-02 03:04:05.6 took 12ms for 10.0.0.1:80": "<TS> took <DUR> for <IP>",
        "id 7 of 42, 3.5MB at 0xff": "id 7 of <N>, <SIZE> at <HEX>",
        "deadbeef cafe1234 12345678": "deadbeef <HEX> <N>",
        "123e4567-e89b-12d3-a456-426614174000 on 2024/01/02": "<UUID> on <DATE>",
        "12.2024-01-01": "<N>-<N>-<N>",
        "v1.2.3.4 at 12:30:45": "v<N> at <TIME>",
        "none": "none",
        "": "",
    }
    assert column(spark, list(cases), text.mask) == list(cases.values())


def test_level(spark):
    cases = {
        "ERROR: disk full": 2,
        "0 errors, 0 warnings": 0,
        "--- FAIL: TestX": 2,
        "ok  pkg 0.1s": 0,
        "npm ERR! code 1": 2,
        "warning: deprecated": 1,
        "see docs/errors.go for error_handling": 0,
        "if err != nil {": 0,
        "": 0,
        "TypeError: x is undefined": 2,
        "all good": 0,
    }
    assert column(spark, list(cases), classify.level) == list(cases.values())


def test_clean(spark):
    cases = {
        "\x1b[31mred\x1b[0m  \n\n": "red",
        "10%\r50%\r100%": "100%",
        "a\r\nb": "a\nb",
        "x\r   ": "x",
        "abc\b\bd": "ad",
        "\x1b]0;title\x07text": "text",
    }
    assert column(spark, list(cases), text.clean) == list(cases.values())


def test_estimate(spark):
    assert column(spark, ["", "the cat", "1234567", "it's", "!!!!", "\n\n"], estimate) == [0, 2, 3, 2, 1, 1]


def run_lines(spark, rows, run=1):
    return spark.createDataFrame([(run, i, x) for i, x in enumerate(rows)], "run_id int, pos int, line string")


def shown(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_runs_and_similar_lines(spark):
    rows = run_lines(spark, ["a", "a", "a", "", " ", "b"])
    assert shown(L.collapse_runs(rows)) == ["a [×3]", "", "b"]
    rows = run_lines(spark, [f"got {i * 11} of 50" for i in range(10, 16)] + ["end", "error 22", "error 33", "error 44", "error 55"])
    assert shown(L.collapse_similar(rows)) == [
        "got 110 of 50", "… 4 similar lines …", "got 165 of 50", "end", "error 22", "error 33", "error 44", "error 55",
    ]


def test_show(spark):
    rows = run_lines(spark, ["a", "error: x", "b", "c", "d", "error: y", "e"])
    got = L.show(rows, errors=True, around=1).orderBy("pos").collect()
    assert [(r.pos, r.hit, r.omitted) for r in got] == [(0, False, 0), (1, True, 0), (2, False, 0), (4, False, 1), (5, True, 0), (6, False, 0)]


def test_stacks(spark):
    frames = ["TypeError: boom", "    at a (/srv/app/x.js:1:1)"] + [f"    at l{i} (/srv/node_modules/l/y.js:{i}:1)" for i in range(6)] + ["    at z (/srv/app/z.js:9:1)", "done"]
    assert shown(stacks.fold_stacks(run_lines(spark, frames))) == [
        frames[0], frames[1], frames[2], "    … 4 library frames", frames[7], frames[8], "done",
    ]
    dump = []
    for i in range(3):
        dump += [f"goroutine {i + 1} [chan receive]:", f"main.wait(0xc00{i})", f"\t/app/m.go:{9} +0x{i}a", ""]
    got = stacks.goroutines(run_lines(spark, dump)).collect()
    assert [(r.n, r.states) for r in got] == [(3, "chan receive")]


def test_merge_is_greedy_and_whole(spark):
    rows = [f"2024-01-01 00:00:{i:02d} INFO task {w} done in {i + 10}ms" for i, w in enumerate(["alpha", "beta", "alpha", "gamma"] * 3)]
    got = templates.merged(run_lines(spark, rows)).collect()
    assert sum(r.cnt for r in got) == 12
    assert [r.template for r in got] == ["<TS> INFO task <*> done in <DUR>"]


@pytest.mark.parametrize("most", [150, 400, 5000])
def test_budget_keeps_errors(spark, most):
    rows = [f"line {i} with some words in it" for i in range(300)]
    rows[100] = "ERROR: the one that matters"
    kept = budget.pick(run_lines(spark, rows), most)
    got = kept.select(F.sum(estimate(F.col("line")) + 1).alias("n"), F.max((F.col("pos") == 100).cast("int")).alias("e")).first()
    assert got.n <= most and got.e == 1


def test_fixed_width_and_braces(spark):
    rows = run_lines(spark, ["NAME      STATUS   AGE", "api-1     Running  3d", "api-2     Failed   1h"])
    got = tables.fixed_width(rows).orderBy("pos").collect()
    assert [[(c.name, c.text) for c in r.cells] for r in got] == [
        [("NAME", "api-1"), ("STATUS", "Running"), ("AGE", "3d")],
        [("NAME", "api-2"), ("STATUS", "Failed"), ("AGE", "1h")],
    ]
    names = spark.createDataFrame([(f"img{i}.png",) for i in range(3, 12)], "name string")
    assert [r.shown for r in tables.brace_ranges(names).collect()] == ["img{3..11}.png"]


def test_readers(spark):
    runs = spark.createDataFrame(
        [(1, "sudo pip install x"), (2, "timeout 5 go test ./..."), (3, "unknown"), (4, "kubectl get pods")], "run_id int, command string"
    )
    assert [r.reader for r in assign(runs).orderBy("run_id").collect()] == ["pip-install", "go-test", None, "kubectl-get"]
    rows = ["=== RUN TestA", "--- PASS: TestA", "=== RUN TestB", "--- FAIL: TestB", "FAIL"]
    lines = run_lines(spark, rows, 2).join(assign(runs), "run_id")
    assert shown(apply(lines)) == ["[2 run lines]", "--- PASS: TestA", "--- FAIL: TestB", "FAIL"]
    pods = ["NAME  READY  STATUS"] + [f"p{i}  1/1  Running" for i in range(70)] + ["q  0/1  CrashLoopBackOff"]
    assert shown(apply(run_lines(spark, pods, 4).join(assign(runs), "run_id"))) == [pods[0], "[+70 rows: Running]", pods[-1]]


def test_condense(spark):
    log = "\n".join(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d} INFO request {i + 100} served in {i % 90 + 10}ms" for i in range(400))
    log += "\n2024-01-01 01:00:00 ERROR disk /dev/sda1 failed\n"
    rows = [(1, "tail app.txt", 0, "short"), (2, "unknown-tool", 0, log), (3, "x", 1, None), (4, "pip install a", 0, "\n".join(["Requirement already satisfied: p%d in /l" % i for i in range(90)] + ["Successfully installed a"]))]
    runs = spark.createDataFrame(rows, "run_id int, command string, exit int, raw string")
    got = {r.run_id: r for r in condense(runs, Options(budget=500)).collect()}
    assert got[1].view == "short" and not got[1].lossy
    assert got[3].view == "" and got[3].n_out == 0
    assert got[2].shape == "log" and "disk /dev/sda1 failed" in got[2].view and got[2].n_out < got[2].n_raw / 10
    assert got[4].shape == "pip-install" and got[4].view.splitlines()[-1] == "Successfully installed a" and "[90 requirements already met]" in got[4].view
    assert condense(runs.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "c" / "go").mkdir(parents=True)
    (tmp_path / "c" / "go" / "a.txt").write_text("x\ny")
    (tmp_path / "c" / "go" / "a.meta.json").write_text(json.dumps({"argv": ["go", "test"], "exit_code": 1}))
    got = store.read_captures(spark, str(tmp_path / "c")).collect()
    assert [(r.category, r.name, r.raw, r.argv, r.exit_code) for r in got] == [("go", "a", "x\ny", ["go", "test"], 1)]
    (tmp_path / "h.jsonl").write_text('{"t": 5, "cmd": "a", "raw": 9, "out": 1}\nnot json\n{"t": 7, "cmd": "b"}\n')
    assert [(r.t, r.cmd) for r in store.read_history(spark, str(tmp_path / "h.jsonl")).orderBy("t").collect()] == [(5, "a"), (7, "b")]
    runs = spark.createDataFrame([(1, 10), (2, 20), (1, 30)], "run_id int, t int").withColumn("t", F.timestamp_seconds("t"))
    store.write_runs(runs, str(tmp_path / "s"))
    assert [r.run_id for r in store.newest(store.read_runs(spark, str(tmp_path / "s"), "1970-01-01"), 5).collect()] == [1, 2]
    (tmp_path / "t").mkdir()
    use = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"command": "ls"}}]}}
    result = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": "a b"}]}}
    (tmp_path / "t" / "s.jsonl").write_text(json.dumps(use) + "\n" + json.dumps(result) + "\n{bad\n")
    seen = store.read_transcripts(spark, str(tmp_path / "t"))
    assert [(r.tool, r.content) for r in store.tool_calls(seen).collect()] == [("Bash", "a b")]


def test_gain_daily_counts_all_runs_and_fills_gaps(spark, tmp_path):
    import duckdb

    rows = [(1, "click", "2024-01-01 10:00:00", 1.0), (2, "error", "2024-01-01 11:00:00", 500.0), (3, "view", "2024-01-04 23:59:59", 2.5), (4, "view", "2024-01-06 00:00:00", 0.0)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, ts string, value double")
    events = events.selectExpr("event_id", "event_type", "cast(ts as timestamp_ntz) as ts", "value", "1L as user_id", "'{}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.day: (r.n, r.raw, r.out, r.saved, r.pct, r.failures) for r in queries.QUERIES["gain_daily"](spark, str(tmp_path)).collect()}
    none = (0, 0, 0, 0, 0, 0)
    assert got == {
        "2024-01-01": (2, 50100, 10020, 40080, 80, 1), "2024-01-02": none, "2024-01-03": none, "2024-01-04": (1, 250, 50, 200, 80, 0),
        "2024-01-05": none, "2024-01-06": (1, 0, 0, 0, 0, 0),
    }
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.SQL["gain_daily"]).fetchall()} == got


def test_condense_groups_goroutines(spark):
    def block(i, state, f):
        return f"goroutine {i} [{state}]:\nmain.{f}(0xc{i:06x}, 0x1)\n\t/srv/app/{f}.go:{len(f)} +0x{i:x}\ncreated by main.start in goroutine {i % 7}\n\t/srv/app/start.go:9 +0x2b\n"

    dump = "panic: all goroutines are stuck\n\n" + block(1, "running", "first")
    dump += "\n".join([block(i, "select" if i % 2 else "IO wait, 3 minutes", "work") for i in range(2, 62)] + [block(99, "sleep", "rare")]) + "\nexit status 2"
    runs = spark.createDataFrame([(1, "unknown-tool", 2, dump)], "run_id int, command string, exit int, raw string")
    view = condense(runs, Options(budget=8000)).collect()[0].view.splitlines()
    assert [x for x in view if x.startswith("goroutine ") or " goroutines [" in x] == [
        "goroutine 1 [running]:", "60 goroutines [IO wait, 3 minutes, select]:", "goroutine 99 [sleep]:",
    ]
    assert sum(x.startswith("main.work(") for x in view) == 1 and view[0].startswith("panic:") and view[-1] == "exit status 2"
    one = run_lines(spark, block(1, "running", "first").splitlines() + ["", "done"])
    assert shown(stacks.group_goroutines(one)) == block(1, "running", "first").splitlines() + ["", "done"]


def test_constant_columns_of_a_large_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    got = queries.QUERIES["constant_columns_lineitem"](spark, sf).collect()
    assert [tuple(r) for r in got] == con.execute(queries.SQL["constant_columns_lineitem"]).fetchall()
    assert [(r.column, r.value) for r in got] == [("x_hundreds", "0")] and got[0].n > 5000
