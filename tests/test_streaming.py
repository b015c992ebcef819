import json
from datetime import datetime

from loomline.streaming import histories as H


def test_savings_by_day(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"t": 100 + i * 40_000, "cmd": "a" if i % 2 else "b", "raw": 10, "out": 2} for i in range(6)]
    (tmp_path / "in" / "h.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = H.savings(H.history_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("savings").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("savings").collect()
    assert sum(r.n for r in got) == 6 and sum(r.raw for r in got) == 60
    assert len({(r.start, r.cmd) for r in got}) == len(got)


def test_rerun_deltas(spark, tmp_path):
    schema = "command string, cwd string, run_id long, at timestamp, items array<string>"
    for i, items in enumerate([["x", "y"], ["y", "z"]]):
        row = [("go test", "/p", i, datetime(2024, 1, 1, i), items)]
        spark.createDataFrame(row, schema).write.mode("append").parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    q = H.rerun_deltas(stream).writeStream.format("memory").queryName("deltas").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.run_id: (r.n_new, r.n_fixed, r.n_still) for r in spark.table("deltas").collect()}
    assert got == {0: (2, 0, 0), 1: (1, 1, 1)}
