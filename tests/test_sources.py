"""Readers on small files."""

import json

from pyspark.sql import functions as F

from gaugefleet import sources as SO
from gaugefleet.operators import steps as ST


def test_trace_lines_tolerate_noise(spark, tmp_path):
    good = {"event_id": "a", "run_id": "r", "event_type": "step_end", "timestamp_ns": 5, "step_id": 1, "payload": {"status": "ok", "loss": 1.5, "flag": True}}
    (tmp_path / "t.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    (row,) = SO.read_trace_jsonl(spark, str(tmp_path / "t.jsonl")).collect()
    assert (row.event_id, row.payload["status"], row.payload["loss"], tuple(row.seq)) == ("a", "ok", "1.5", (5, "a"))


def test_gpu_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("timestamp, index, utilization.gpu [%], memory.used [MiB], memory.total [MiB]\nx, 0, 50 %, 2 MiB, 4 MiB\nx, 1, , , \n")
    (row,) = SO.read_gpu_csv(spark, str(tmp_path / "g.csv"), "r").collect()
    assert (row.gpu_id, row.utilization_gpu_pct, row.memory_used_bytes) == (0, 50.0, 2.0 * SO.MIB)


def test_chrome_trace(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"traceEvents": [{"name": "k", "cat": "kernel", "ph": "X", "ts": 1.5, "dur": 2, "args": {"a": 1}}, {"ph": "M"}]}))
    a, b = SO.read_chrome_trace(spark, str(tmp_path / "c.json")).orderBy("idx").collect()
    assert (a.name, a.ts_us, a.dur_us, a.args["a"], b.name) == ("k", 1.5, 2.0, "1", "")


def test_kernel_csv_tall_and_wide(spark, tmp_path):
    (tmp_path / "tall.csv").write_text('\ufeff# note\n==PROF== done\nbare output\n"ID","Kernel Name","Metric Name","Metric Unit","Metric Value"\n"0","k","dram__throughput.avg.pct_of_peak_sustained_elapsed","%","1,234.5"\n"0","k","odd","","n/a"\n')
    (tmp_path / "wide.csv").write_text("Kernel Name,Duration,Mem Busy\n,us,%\nk,80,1\nk,90,\nk,100,3\n")
    got = {(r.kernel_name, r.metric_name): (r.metric_unit, r.value) for r in SO.read_kernel_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("k", "dram__throughput.avg.pct_of_peak_sustained_elapsed"): ("%", 1234.5), ("k", "Duration"): ("us", 90.0), ("k", "Mem Busy"): ("%", 2.0)}


def test_trace_order_breaks_ties_by_event_id(spark, tmp_path):
    lines = [{"event_id": e, "run_id": "1", "event_type": "step_end", "timestamp_ns": 5, "step_id": 1, "duration_ns": n, "payload": {"status": s}} for e, n, s in (("b", 2, "error"), ("a", 1, "ok"))]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (row,) = ST.step_metrics(SO.read_trace_jsonl(spark, str(tmp_path / "t.jsonl")).withColumn("shapes", F.lit(None).cast("map<string,array<int>>"))).collect()
    assert (row.status, row.step_wall_time_ns) == ("error", 2)


def small_splits(spark, n):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return old


def restore(spark, old):
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def odd_trace(rng, n):
    """Events with nested args, braces, quotes and backslashes in texts, beside other objects and arrays that are no events."""
    texts = ["plain", "a } brace", '"quoted"', "back\\slash\\", "[{", '}],"traceEvents":[{', "é\U0001f600", "line\nend", "\\\" }"]
    event = lambda i: {"name": f"{rng.choice(texts)}{i}", "cat": "kernel", "ph": "X", "ts": i + 0.5, "dur": i % 7, "pid": 1, "tid": i % 3, "args": {rng.choice(texts): rng.choice(texts), "k": i, "deep": {"a": [{"b": {}}, {}]}}}
    events = [event(i) for i in range(n)]
    return events, {"deviceProperties": [{"id": 0, "name": "x"}], "meta": {"a": {"name": "no"}, "traceEvents": [{"name": "no"}]}, "schemaVersion": 1, "traceEvents": events, "other": [{"name": "no"}, {"traceEvents": 1}], "traceName": "a { b"}


def test_one_trace_is_read_by_many_tasks(spark, tmp_path):
    import random

    rng = random.Random(3)
    for k, indent in enumerate((None, 1)):
        events, document = odd_trace(rng, 300)
        (tmp_path / f"t{k}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=k == 1) + "\n" * k)
        for size in (200, 5_000, 10_000_000):  # events longer than a split, some, one task
            old = small_splits(spark, size)
            try:
                df = SO.read_chrome_trace(spark, str(tmp_path / f"t{k}.json"))
                rows = df.orderBy("idx").collect()
                parts = spark.read.option("lineSep", "}").text(str(tmp_path / f"t{k}.json")).rdd.getNumPartitions()
            finally:
                restore(spark, old)
            assert parts > 3
            assert [(r.name, r.ts_us, r.dur_us, r.pid, r.tid) for r in rows] == [(e["name"], e["ts"], float(e["dur"]), str(e["pid"]), str(e["tid"])) for e in events]
            assert [r.args["k"] for r in rows] == [str(i) for i in range(300)] and json.loads(rows[0].args["deep"]) == {"a": [{"b": {}}, {}]}
            assert len({r.idx for r in rows}) == 300


def test_traces_without_events(spark, tmp_path):
    for k, text in enumerate(("", "{}", "[]", '{"traceEvents": []}', '{"traceEvents": {"a": {}}}', "no json }} {")):
        (tmp_path / f"{k}.json").write_text(text)
    assert SO.read_chrome_trace(spark, str(tmp_path)).collect() == []


def test_one_kernel_table_is_read_by_many_tasks(spark, tmp_path):
    tall = ["==PROF== x", '"Kernel Name","Metric Name","Metric Unit","Metric Value"', *(f'"k,{i % 5}","m{i}","%","{i},000.5"' for i in range(400)), "noise", '"k","bad","","n/a"', '"","m","","1"']
    wide = ["# note", "Kernel Name,Duration,Mem Busy,", ",us,%,", *(f"k{i % 4},{i},{'' if i % 2 else i}," for i in range(400)), ",7,7,", "k9"]
    (tmp_path / "tall.csv").write_text("\n".join(tall))
    (tmp_path / "wide.csv").write_text("﻿" + "\r\n".join(wide))
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    (tmp_path / "blank.csv").write_text("\n\n")
    want = [(f"k,{i % 5}", f"m{i}", "%", i * 1000 + 0.5) for i in range(400)]
    mean = lambda v: sum(v) / len(v)
    want += [(f"k{k}", "Duration", "us", mean([i for i in range(400) if i % 4 == k])) for k in range(4)] + [(f"k{k}", "Mem Busy", "%", mean([i for i in range(400) if i % 4 == k])) for k in (0, 2)]
    want[1:400] = [(a, b, c, float(b[1:] + "000.5")) for a, b, c, _ in want[1:400]]
    want[0] = ("k,0", "m0", "%", 0.5)
    for size in (500, 10_000_000):
        old = small_splits(spark, size)
        try:
            rows = SO.read_kernel_csv(spark, str(tmp_path / "*.csv")).orderBy("file", "seq").collect()
        finally:
            restore(spark, old)
        assert sorted((r.kernel_name, r.metric_name, r.metric_unit, r.value) for r in rows) == sorted(want)
        assert [r.metric_name for r in rows if r.file.endswith("tall.csv")] == [f"m{i}" for i in range(400)]


def test_a_run_written_again_replaces_that_run_only(spark, tmp_path):
    path = str(tmp_path / "summaries")
    frame = lambda *rows: spark.createDataFrame(rows, "run_id long, summary string, day string")
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("run_id", "summary", "day").collect())
    SO.write_run_summary(frame((1, "a", "x"), (2, "b", "x")), path)
    SO.write_run_summary(frame((2, "new", "y"), (3, "c", "y")), path)
    for _ in range(2):
        assert rows() == [(1, "a", "x"), (2, "new", "y"), (3, "c", "y")]
        SO.write_run_summary(frame((2, "new", "y"), (3, "c", "y")), path)
    SO.write_run_summary(frame((1, "z", "x")).limit(0), path)
    assert len(rows()) == 3
    path = str(tmp_path / "by_day")
    SO.write_run_summary(frame((1, "a", "x"), (2, "b", "x"), (1, "c", "y")), path, ("day", "run_id"))
    SO.write_run_summary(frame((1, "d", "x")), path, ("day", "run_id"))
    assert rows() == [(1, "c", "y"), (1, "d", "x"), (2, "b", "x")]


def test_several_traces_in_a_file(spark, tmp_path):
    import random

    rng, want, lines = random.Random(7), [], []
    for k in range(12):
        events, document = odd_trace(rng, rng.randrange(0, 30))
        want += [(e["name"], e["ts"], e["args"]["k"]) for e in events]
        lines += [json.dumps(document), '{"meta": {"name": "no"}, "list": [{"name": "no"}]}']
    for end in ("\n", "", "\n\n "):
        path = tmp_path / f"t{len(end)}.json"
        path.write_text(end.join(lines))
        for size in (300, 7_000, 10_000_000):  # splits within a document, over several, one
            old = small_splits(spark, size)
            try:
                rows = SO.read_chrome_trace(spark, str(path)).orderBy("idx").collect()
            finally:
                restore(spark, old)
            assert [(r.name, r.ts_us, int(r.args["k"])) for r in rows] == want and len({r.idx for r in rows}) == len(rows)


def test_files_of_one_split_send_nothing_to_the_driver(spark, tmp_path, monkeypatch):
    from gaugefleet.sources import trace as TR

    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"traceEvents": [{"name": f"{k}-{i}", "args": {"a": 1}} for i in range(k * 10)]}))
    sent, chain = [], TR._starts
    monkeypatch.setattr(TR, "_starts", lambda rows: sent.append({r.file.rsplit("/", 1)[1] for r in rows}) or chain(rows))
    for size, cut in ((100_000, set()), (8_000, {f"{k}.json" for k in range(30) if (tmp_path / "in" / f"{k}.json").stat().st_size > 8_000})):
        old = small_splits(spark, size)
        try:
            names = sorted(r.name for r in SO.read_chrome_trace(spark, str(tmp_path / "in")).collect())
        finally:
            restore(spark, old)
        assert names == sorted(f"{k}-{i}" for k in range(30) for i in range(k * 10)) and sent.pop() == cut
