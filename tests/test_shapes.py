"""Paths, JSON tables, detection, line functions and reports against small cases with known results."""

import json

from pyspark.sql import functions as F

from loomline.functions import classify, shown
from loomline.operators import paths
from loomline.operators.json_tables import json_view
from loomline.plans.condense import Options, condense
from loomline.readers import assign, detect, reports


def run_lines(spark, rows, run=1):
    return spark.createDataFrame([(run, i, x) for i, x in enumerate(rows)], "run_id int, pos int, line string")


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_path_like(spark):
    cases = {"a/b.go": True, "my file.txt": True, "two words": False, "a b/c": True, "x: y": False, " a": False, "--": False, "": False, "a  b/c": False}
    assert column(spark, list(cases), paths.is_path_like) == list(cases.values())
    rows = run_lines(spark, ["a/b", "c/d", "e/f", "g", "", None, "one: two"])
    assert [(r.n, r.n_like, r.is_list) for r in paths.path_lists(rows).collect()] == [(5, 4, True)]
    assert paths.path_lists(rows.limit(0)).count() == 0


def test_recursive_listing(spark):
    rows = run_lines(spark, [".:", "a.go", "sub", "", "./sub:", "b.go", "c.go", None])
    assert [r.path for r in paths.recursive_listing(rows).orderBy("pos").collect()] == ["./a.go", "./sub", "./sub/b.go", "./sub/c.go"]
    assert paths.recursive_listing(run_lines(spark, ["a", "b", "c", "d"])).count() == 0


def test_factored_paths(spark):
    names = [f"img/p{i}.png" for i in range(1, 31)] + [f"s/{c}.go" for c in "ab"] + [f"big/{chr(97 + i)}x.{'go' if i % 2 else 'md'}" for i in range(24)]
    names += [f"gap/n{i}" for i in (1, 2, 3, 4, 5, 9)] + ["top", "top", None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(names)], "run_id int, pos int, path string")
    got = {r.directory: (r.n_files, r.shown) for r in paths.factored(df).collect()}
    assert got == {
        "img": (30, "p{1..30}.png"), "s": (2, "a.go, b.go"), "big": (24, "[24 files: go 12, md 12]"),
        "gap": (6, "n* (6)"), "": (2, "top"),
    }
    assert paths.factored_lines(df).orderBy("pos").first().line == "img/: p{1..30}.png"
    assert paths.factored(df.limit(0)).count() == 0


def test_json_tables(spark):
    items = [{"id": i, "kind": "x", "url": f"https://e.com/{i}", "note": "a\nb" if i else None} for i in range(35)]
    many = json.dumps({f"k{i}": {"v": i, "w": {"deep": "z" * 60}} for i in range(3)})
    texts = [json.dumps(items), many, "[1, 2, 3]", "{", None, "", '[{"a": 1}, {"a": 2}]', '[{"a": 1}, {"b": 2}, {"c": 3}]', '[{"a": 1}, null, {"a": 3}]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.view for r in json_view(df, "x").orderBy("i").collect()]
    first = got[0].split("\n")
    assert first[:5] == ["[table: 35 items]", "keys: id, note", "all: kind=x", "0 | ", "1 | a\\nb"] and first[-1] == "… +15 more items" and len(first) == 24
    assert got[1].split("\n") == ["[table: 3 items]", "keys: (key), v, w"] + [f"k{i} | {i} | {{…1 keys}}" for i in range(3)]
    assert got[2:] == [None] * 7


def test_detection_by_marks(spark):
    texts = ["x\n--- FAIL: TestA (0.01s)\nFAIL", "no marks here", None, "Test Suites: 1 failed, 2 total", "a.ts(1,2): error TS2304: no"]
    df = spark.createDataFrame([(i, "run.sh", t) for i, t in enumerate(texts)], "run_id int, command string, text string")
    got = [(r.reader, r.kind) for r in detect(assign(df)).orderBy("run_id").collect()]
    assert got == [("go-test", "noise"), (None, None), (None, None), ("jest", "noise"), ("tsc", "repeat")]
    known = detect(assign(df.withColumn("command", F.lit("git log")))).collect()
    assert {r.reader for r in known} == {"git-log"}


def test_line_functions(spark):
    assert column(spark, ["aé😀b", "ab", "", None], lambda x: shown.shorten_bytes(x, 5)) == ["aé", "ab", "", None]
    assert column(spark, ["😀😀", "é" * 9], lambda x: shown.shorten_bytes(x, 3)) == ["", "é"]
    line = "x" * 300 + "HIT" + "y" * 300
    got = column(spark, [line, "HIT", None, "HIT" + "z" * 400], lambda x: shown.around(x, "HIT"))
    assert "HIT" in got[0] and len(got[0]) == 162 and got[0][0] == got[0][-1] == "…" and got[1:3] == ["HIT", None] and got[3] == "HIT" + "z" * 157 + "…"
    assert column(spark, ["text\n", "\x01\x02a", "\0" * 9, "", None], shown.looks_binary) == [False, True, True, False, None]
    assert column(spark, ["lvl=crit x", "all fine", "ERROR: x", "{\"level\":50}"], shown.alarming) == [True, False, True, True]
    assert column(spark, ["a\nContinue? [y/N] ", "a?\n", "done", "Password:", None], shown.prompt) == ["Continue? [y/N] ", None, None, "Password:", None]
    assert column(spark, ["ok  \tpkg", "Tests: 3 passed", "ok"], shown.is_summary) == [True, True, False]
    argv = spark.createDataFrame([(0, ["git", "status", "--porcelain"]), (1, ["k", "get", "-o", "json"]), (2, ["git", "--", "--json"]), (3, []), (4, ["--"])], "i int, a array<string>")
    assert [r.m for r in argv.select("i", shown.machine_readable(F.col("a")).alias("m")).orderBy("i").collect()] == [True, True, False, False, False]
    n = spark.createDataFrame([(0, 999), (1, 1234), (2, 5600000), (3, -2500)], "i int, n long")
    assert [r.h for r in n.select("i", shown.human(F.col("n")).alias("h")).orderBy("i").collect()] == ["999", "1.2k", "5.6M", "-2.5k"]
    assert n.select(shown.receipt(F.lit(1200), F.lit(30), F.lit(0.975), F.lit(None), F.lit("error")).alias("r")).first().r == "[1,200→30 lines (−98%) · error]"
    days = spark.createDataFrame([(1, 0), (2, 7), (3, 3)], "d int, v long")
    assert shown.sparkline(days, "d", "v").first().line == "·█▄"


def test_more_reports(spark):
    blame = run_lines(spark, [f"{s} (Ann Lee 2024-01-02 {i}) code" for i, s in enumerate(["aaaaaaa1", "aaaaaaa1", "bbbbbbb2", "aaaaaaa1"], 1)] + [None])
    got = [(r.sha, r.author, r.first_line, r.n_lines, r.is_first) for r in reports.blame_runs(blame).orderBy("pos").collect()]
    assert got == [("aaaaaaa1", "Ann Lee", 1, 2, True), ("bbbbbbb2", "Ann Lee", 3, 1, True), ("aaaaaaa1", "Ann Lee", 4, 1, False)]
    lock = run_lines(spark, ["-a v1.0 h1:x=", "+a v1.1 h1:y=", "+b v2.0 h1:z=", "-c v3.0 h1:w=", "-d v1.0 h1:q=", "+d v1.0 h1:q="])
    got = {(r.package, r.state, r.old, r.new) for r in reports.lock_changes(lock).collect()}
    assert got == {("a", "changed", "1.0", "1.1"), ("b", "added", None, "2.0"), ("c", "removed", "3.0", None)}
    events = [{"Action": "run", "Package": "p", "Test": "T"}, {"Action": "output", "Package": "p", "Test": "T", "Output": "bad\n"},
              {"Action": "fail", "Package": "p", "Test": "T"}, {"Action": "pass", "Package": "q", "Elapsed": 0.1}, {"Action": "run", "Package": "p", "Test": "U"}]
    got = {(r.package, r.test, r.state, r.output) for r in reports.go_test_events(run_lines(spark, [json.dumps(e) for e in events] + ["text", "{"])).collect()}
    assert got == {("p", "T", "fail", "bad\n"), ("q", "", "pass", ""), ("p", "U", "unfinished", "")}
    kube = spark.createDataFrame([(1, i, "Normal", f"R{i % 3}", f"o{i // 2}", "m") for i in range(140)] + [(1, 200, "Warning", "W", "o", "m")], "run_id int, pos int, type string, reason string, object string, message string")
    merged = reports.merged_events(kube)
    assert merged.where("shown").count() == 21 and reports.hidden_events(merged).first().n == 120
    assert [r.line for r in reports.last_refresh(run_lines(spark, ["R", "a", "R", "b"]), "^R$").orderBy("pos").collect()] == ["R", "b"]
    klog = "E0102 03:04:05.678901    1 a.go:7] failed"
    assert [r.line for r in reports.tagged_klog(run_lines(spark, [klog, klog, "x"])).orderBy("pos").collect()] == [f"[E] {klog}"] * 2 + ["x"]
    table = run_lines(spark, ["File | % Stmts | % Branch | % Funcs | % Lines | Un", "All files | 70 | 70 | 70 | 70 |", " a.ts | 90 | 50.5 | 100 | 90 | 3", " b.ts | 99 | 99 | 99 | 99 |"])
    assert [(r.file, r.least) for r in reports.low_coverage(table).collect()] == [("a.ts", 50.5)]


def test_condense_by_shape(spark):
    listing = "\n".join(f"src/pkg{d}/file{i}.go" for d in range(4) for i in range(60))
    table = json.dumps([{"id": i, "state": "ready", "name": f"node {i}"} for i in range(200)])
    test = "\n".join([f"--- PASS: Test{i} (0.00s)" for i in range(90)] + ["--- FAIL: TestX (0.1s)", "FAIL\tp\t0.2s"])
    recursive = "\n\n".join(f"./d{d}:\n" + "\n".join(f"f{i}.txt" for i in range(50)) for d in range(4))
    rows = [(1, "find .", listing), (2, "fetch", table), (3, "run.sh", test), (4, "ls -lR", recursive), (5, "x", None)]
    runs = spark.createDataFrame(rows, "run_id int, command string, raw string").withColumn("exit", F.lit(0))
    got = {r.run_id: r for r in condense(runs, Options(budget=600)).collect()}
    assert {i: r.shape for i, r in got.items()} == {1: "paths", 2: "json", 3: "go-test", 4: "paths", 5: "small"}
    assert got[1].view.split("\n")[0] == "src/pkg0/: file{0..59}.go" and len(got[1].view.split("\n")) == 4
    assert got[2].view.startswith("[table: 200 items]\nkeys: id, name\nall: state=ready\n0 | node 0")
    assert "[90 passed tests]" in got[3].view and "--- FAIL: TestX" in got[3].view
    assert got[4].view.split("\n")[0] == "./d0/: f{0..49}.txt" and got[5].view == ""


def test_modes_by_cues(spark):
    cases = {
        "why did the test fail?": "error", "start the debug server": "auto", "debug it": "error", "please verify": "verify",
        "don't verify, confirm": "auto", "I'm not sure; verify": "verify", "verify, then debug": "auto", "run the tests again": "verify",
        "verify" + " x" * 300: "auto", "no need to debug at all, but verify": "verify", "no need to debug, but verify": "auto", "": "auto", None: "auto",
    }
    assert column(spark, list(cases), classify.mode_of) == list(cases.values())
