"""Streams over several batches, restarts and late events, against the batch result of all events."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugefleet import streaming as SM
from gaugefleet.operators import steps as S

T = datetime(2024, 1, 1, 11, 59)
EVENT = "run_id string, event_id string, seq long, ts timestamp, event_type string, step_id long, span_id string, duration_ns long, payload map<string,string>"


def minutes(n):
    return T + timedelta(minutes=n)


def forget_last_batch(state):
    """As after a crash between the output of a batch and its commit: the commit and its checksum are gone."""
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def line(n, at, **more):
    return json.dumps({"run_id": "r", "event_id": f"e{n}", "event_type": "sync_wait", "step_id": n // 3, "duration_ns": n, "timestamp_ns": at * 1_000_000_000, "payload": {"loss": 1.5}} | more)


def test_ingest_takes_files_in_as_they_come(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    assert [df.count() for df in SM.ingest_traces(spark, str(folder), out)] == [0, 0]
    (folder / "a.jsonl").write_text("\n".join([line(1, 60), line(2, 61), line(1, 60), "{broken", "{broken", "", '{"event_id": "x"}']))
    events, aside = SM.ingest_traces(spark, str(folder), out)
    assert sorted(r.event_id for r in events.collect()) == ["e1", "e2"]
    assert sorted(r.line for r in aside.collect())[1:] == ["{broken", "{broken"] and aside.count() == 3
    (folder / "b.jsonl").write_text("\n".join([line(2, 61), line(3, 62), "no json", line(4, 63, event_type=None)]))
    for _ in range(2):  # the second call has nothing new
        events, aside = SM.ingest_traces(spark, str(folder), out)
        assert Counter(r.event_id for r in events.collect()) == Counter(("e1", "e2", "e3")) and aside.count() == 5
    for part in ("lines", "once"):
        forget_last_batch(tmp_path / "out" / part / "state")
    events, aside = SM.ingest_traces(spark, str(folder), out)
    assert Counter(r.event_id for r in events.collect()) == Counter(("e1", "e2", "e3")) and aside.count() == 5
    row = events.where("event_id = 'e3'").first()
    assert (row.ts, row.payload, row.step_id) == (datetime(1970, 1, 1, 0, 1, 2), {"loss": "1.5"}, 1)


def test_ingest_sets_the_clock(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line(1, 60))
    events, _ = SM.ingest_traces(spark, str(tmp_path / "in"), str(tmp_path / "out"), anchor_ns=F.lit(1_704_110_400_000_000_000))
    assert events.first().ts == datetime(2024, 1, 1, 12, 1)


def step_events(n_runs=3, n_steps=12):
    """Steps of five events over an hour each; their ends, phases, copies, shapes, windows and samples."""
    rows = []
    for run in range(n_runs):
        for step in range(n_steps):
            at = lambda k: minutes(run + step * 9 + k)  # noqa: B023, E731
            events = [
                ("dataloader_span", 100 * step + run, {"stage": "next"}), ("phase_span", 40, {"phase_name": "forward"}), ("memcpy_span", 30, {"copy_kind": "h2d"}), ("phase_span", 50, {"phase_name": "backward"}),
                ("profiler_window", 0, {"window_state": "exported", "kernel_count": "7", "median_cuda_kernel_duration_us": str(3.5 + step), "small_kernel_fraction": "0.25"}),
                ("gpu_sample", 0, {"utilization_gpu_pct": str(10 * run + step), "memory_used_bytes": str(step), "memory_total_bytes": "50"}), ("step_end", 1000 + step, {"status": "ok" if step % 5 else "error"}),
            ]
            rows += [(f"r{run}", f"{run}-{step}-{k}", step * 10 + k, at(k), kind, step, None, d, p) for k, (kind, d, p) in enumerate(events)]
    return rows


def stream(spark, path, schema=EVENT, files=None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(str(path))


def plain(df, *without):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop(*without).collect())


def test_steps_over_batches_equal_batch(spark, tmp_path):
    rows = step_events()
    cut = len(rows) // 2 + 3  # within a step
    batch = spark.createDataFrame(rows, EVENT).withColumn("shapes", F.lit(None).cast("map<string,array<int>>"))
    write(spark, rows[:cut], EVENT, tmp_path / "in")
    SM.collect_partials(stream(spark, tmp_path / "in", files=1), str(tmp_path / "out"))
    early = SM.step_metrics_so_far(spark, str(tmp_path / "out"))
    assert 0 < early.where("step_wall_time_ns = 0").count() < early.count()  # a step without its end is there, as far as it came
    write(spark, rows[cut:], EVENT, tmp_path / "in")
    SM.collect_partials(stream(spark, tmp_path / "in", files=1), str(tmp_path / "out"))
    assert plain(SM.step_metrics_so_far(spark, str(tmp_path / "out"))) == plain(S.step_metrics(batch))
    forget_last_batch(tmp_path / "out" / "state")
    SM.collect_partials(stream(spark, tmp_path / "in", files=1), str(tmp_path / "out"))
    assert plain(SM.step_metrics_so_far(spark, str(tmp_path / "out"))) == plain(S.step_metrics(batch))
    assert SM.step_metrics_so_far(spark, str(tmp_path / "out")).where("gpu_active_fraction_proxy = 0.09").count() > 0


def summary_of(spark, rows):
    events = spark.createDataFrame(rows, EVENT).withColumn("shapes", F.lit(None).cast("map<string,array<int>>"))
    samples = SM.numbers(events.where("event_type = 'gpu_sample'"), "utilization_gpu_pct", "utilization_mem_pct", "memory_used_bytes", "memory_total_bytes")
    return S.run_summary(S.step_metrics(events), samples)


def test_sessions_equal_the_summary_of_their_events(spark, tmp_path):
    rows = step_events(2, 8)
    early, late = [r for r in rows if r[5] in (0, 1, 2)], [r for r in rows if r[5] in (5, 6, 7)]
    between = [r for r in rows if r[5] in (3, 4)]
    out = str(tmp_path / "out")
    write(spark, early + late, EVENT, tmp_path / "in")
    SM.collect_partials(stream(spark, tmp_path / "in"), out, "10 minutes")
    found = SM.open_and_closed_sessions(spark, out, "5 minutes")
    assert found.groupBy("run_id").count().collect()[0]["count"] == 2 and found.agg(F.sum("events")).first()[0] == len(early + late)
    assert {(r.run_id, r.closed) for r in found.collect()} == {("r0", True), ("r0", False), ("r1", True), ("r1", False)}
    for part in (early, late):
        first = min(r[3] for r in part)
        one = found.where(F.abs(F.unix_seconds("start") - F.unix_seconds(F.lit(first))) < 120)
        assert plain(one, "start", "end", "events", "closed") == plain(summary_of(spark, part), "scope")
    write(spark, between, EVENT, tmp_path / "in")  # what comes late joins both
    SM.collect_partials(stream(spark, tmp_path / "in"), out, "10 minutes")
    for _ in range(2):
        joined = SM.open_and_closed_sessions(spark, out, "5 minutes")
        assert joined.count() == 2 and plain(joined, "start", "end", "events", "closed") == plain(summary_of(spark, rows), "scope")
        forget_last_batch(tmp_path / "out" / "state")
        SM.collect_partials(stream(spark, tmp_path / "in"), out, "10 minutes")


MARKER = "run_id string, span_id string, ts timestamp, duration_ns long"


def spans(spark, tmp_path, files=1):
    return SM.run_to_table(SM.stream_span_pairing(stream(spark, tmp_path / "in", MARKER, files), "30 minutes", "1 minute"), str(tmp_path / "out"))


def test_spans_cross_every_edge_and_expire_alone(spark, tmp_path):
    write(spark, [("r", "edge", T, 0), ("r", "never", minutes(-60), 0), ("r", "twice", T, 0), ("r", "twice", T, 0), ("r", None, T, 0), (None, "x", T, 5)], MARKER, tmp_path / "in")
    assert {(r.span_id, r.closed) for r in spans(spark, tmp_path).collect()} == {("never", False)}
    write(spark, [("r", "edge", minutes(2), 7), ("other", "edge", minutes(2), 0), ("r", "twice", minutes(1), 4), ("r", "twice", minutes(1), 4), ("r", "zero", minutes(2), 3)], MARKER, tmp_path / "in")
    got = {(r.run_id, r.span_id): (r.start, r.end, r.duration_ns, r.closed) for r in spans(spark, tmp_path).collect()}
    assert got == {("r", "never"): (minutes(-60), None, None, False), ("r", "edge"): (T, minutes(2), 7, True), ("r", "twice"): (T, minutes(1), 4, True)}
    write(spark, [("r", "clock", minutes(120), 0), ("r", "edge", minutes(119), 0)], MARKER, tmp_path / "in")
    for _ in range(2):
        rows = spans(spark, tmp_path).collect()
        got = Counter((r.run_id, r.span_id, r.start, r.closed) for r in rows)
        assert got == Counter([("r", "never", minutes(-60), False), ("r", "edge", T, True), ("r", "twice", T, True), ("other", "edge", minutes(2), False), ("r", "zero", None, True)])
        forget_last_batch(tmp_path / "out" / "state")


def test_a_span_is_the_same_in_one_batch_or_many(spark, tmp_path):
    rows = [("r", f"s{k % 40}", minutes(k * 1.5), 0 if k // 40 % 2 == 0 else k) for k in range(240)] + [("r", "end", minutes(600), 0)]
    (tmp_path / "many").mkdir()
    (tmp_path / "one").mkdir()
    for k in range(0, len(rows), 60):
        write(spark, rows[k : k + 60], MARKER, tmp_path / "many" / "in")
    write(spark, rows, MARKER, tmp_path / "one" / "in")
    one, many = (plain(spans(spark, tmp_path / x)) for x in ("one", "many"))
    assert one == many and len(one) > 100


def test_many_spans_of_a_bucket_keep_their_own_times(spark, tmp_path):
    """Spans of one bucket and of many: each is told once, by its own time, over batches and restarts."""
    rows = [(f"r{k % 3}", f"s{k}", minutes(k % 50 - 25), 0) for k in range(300)] + [(f"r{k % 3}", f"s{k}", minutes(k % 50 - 25 + k % 45), 5 + k) for k in range(0, 300, 2)]
    late = [("r", "clock", minutes(70), 0)]
    found = []
    for n in (1, 7, 512):
        write(spark, rows, MARKER, tmp_path / f"{n}" / "in")
        run = lambda: SM.run_to_table(SM.stream_span_pairing(stream(spark, tmp_path / f"{n}" / "in", MARKER), "30 minutes", "1 minute", n), str(tmp_path / f"{n}" / "out"))  # noqa: B023, E731
        some = run().count()
        write(spark, late, MARKER, tmp_path / f"{n}" / "in")
        found.append(plain(run()))
        forget_last_batch(tmp_path / f"{n}" / "out" / "state")
        assert plain(run()) == found[-1] and some < sum(found[-1].values())
    assert found[0] == found[1] == found[2] and max(found[0].values()) == 1
    inside = [k for k in range(0, 300, 2) if k % 45 <= 30]
    closed = {r[1]: r[4] for r in found[0] if r[5] and r[2] is not None}
    assert closed == {f"s{k}": 5 + k for k in inside}  # both markers within half an hour
    assert {r[1] for r in found[0] if not r[5]} == {f"s{k}" for k in range(300) if k not in inside}


@pytest.mark.parametrize(("width", "slide"), [(60, None), (60, 20)])
def test_device_windows(spark, tmp_path, width, slide):
    rows = [("r", k % 2, T + timedelta(seconds=7 * k), float(k * (1 + k % 2)), float(k), 200.0) for k in range(120)]
    schema = "run_id string, gpu_id int, ts timestamp, utilization_gpu_pct double, memory_used_bytes double, memory_total_bytes double"
    write(spark, rows[:50], schema, tmp_path / "in")
    run = lambda: SM.run_to_table(SM.stream_gpu_windows(stream(spark, tmp_path / "in", schema), f"{width} seconds", f"{slide} seconds" if slide else None, "5 seconds"), str(tmp_path / "out"))
    some = run().count()
    write(spark, rows[50:], schema, tmp_path / "in")
    got = {(r.gpu_id, r.start): (r.n, round(r.avg_util, 6), r.spread, r.memory_ratio) for r in run().collect()}
    step, mark, want = slide or width, rows[-1][2] - timedelta(seconds=5), {}
    for gpu in (0, 1):
        start = T.replace(second=0) - timedelta(seconds=width)
        while start + timedelta(seconds=width) <= mark:
            inside = [r for r in rows if r[1] == gpu and start <= r[2] < start + timedelta(seconds=width)]
            if inside:
                u = [r[3] for r in inside]
                want[gpu, start] = (len(u), round(sum(u) / len(u), 6), max(u) - min(u), max(r[4] / 200 for r in inside))
            start += timedelta(seconds=step)
    assert got == want and 0 < some < len(got)


def test_alerts_and_repeated_batches(spark, tmp_path):
    spark.range(5).selectExpr("id AS run_id", "timestamp_seconds(id) AS ts", "95.0D AS memory_used_bytes", "100.0D AS memory_total_bytes", "90.0D AS temperature_c").write.parquet(str(tmp_path / "in"))
    alerts = lambda: SM.stream_health_alerts(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    for _ in range(2):
        assert plain(SM.run_to_table(alerts(), str(tmp_path / "a")).groupBy("label").count()) == Counter([("memory_pressure", 5), ("thermal_pressure", 5)])
        forget_last_batch(tmp_path / "a" / "state")
