"""Golden cases for steps, runs, labels and diagnosis."""

import pytest
from pyspark.sql import Row

from gaugefleet.operators import classify as C
from gaugefleet.operators import steps as S

EVENTS = "run_id long, step_id long, seq long, event_type string, duration_ns long, payload map<string,string>, shapes map<string,array<int>>"
SAMPLES = "run_id long, utilization_gpu_pct double, utilization_mem_pct double, memory_used_bytes double, memory_total_bytes double"


def step(n, wall, *spans, shape=None, status="ok"):
    rows = [(1, n, 0, "step_start", 0, {"step_kind": "train"}, None)]
    rows += [(1, n, i + 1, kind, d, payload, None) for i, (kind, d, payload) in enumerate(spans)]
    if shape:
        rows.append((1, n, 90, "shape_snapshot", 0, {"batch_size": str(shape[0])}, {"x": list(shape)}))
    return [*rows, (1, n, 99, "step_end", wall, {"status": status}, None)]


def loader(ns):
    return ("dataloader_span", ns, {"stage": "next"})


def diagnose(spark, rows, samples=()):
    steps = S.step_metrics(spark.createDataFrame(rows, EVENTS))
    runs = S.run_summary(steps, spark.createDataFrame(list(samples), SAMPLES))
    ranked = C.rank_bottlenecks(C.classify_run(runs))
    return runs.first(), [(r.label, r.score) for r in ranked.orderBy("place").collect()], C.diagnose_run(ranked, runs).first()


def test_input_bound(spark):
    run, labels, d = diagnose(spark, [*step(1, 1000, loader(300)), *step(2, 1000, loader(350))], [(1, 80.0, 40.0, 1.0, 10.0)])
    assert run.dominant_stall_type == "input_bound"
    assert labels == [("input_bound", 0.325)]
    assert d.primary_bottleneck == "input_bound" and d.confidence_level == "medium" and d.secondary_bottlenecks == ""


def test_cuts_are_inclusive(spark):
    at, below = [*step(1, 1000, loader(200))], [*step(1, 1000, loader(199))]
    assert diagnose(spark, at, [(1, 80.0, 0.0, 0.0, 1.0)])[1] == [("input_bound", 0.2)]
    assert diagnose(spark, below, [(1, 80.0, 0.0, 0.0, 1.0)])[1] == []


def test_shape_changes_and_memory(spark):
    rows = [*step(1, 1000, shape=(8, 16)), *step(2, 1000, shape=(16, 16)), *step(3, 1000, shape=(8, 16))]
    run, labels, _ = diagnose(spark, rows, [(1, 90.0, 10.0, 95.0, 100.0)])
    assert run.shape_volatility_ratio == 1.0
    assert [x[0] for x in labels] == ["shape_instability", "memory_pressure"]
    changed = S.shape_changes(S.step_metrics(spark.createDataFrame(rows, EVENTS))).orderBy("step_id").collect()
    assert [r.shape_changed for r in changed] == [False, True, True]
    assert changed[0].shape_signature == "x:[8, 16]"


def test_sparse_telemetry(spark):
    _, labels, d = diagnose(spark, step(1, 1000))
    assert labels == [("insufficient_telemetry", 1.0)] and d.confidence_level == "high"


def test_symptom_shows_root_cause(spark):
    _, labels, d = diagnose(spark, step(1, 1000, loader(250)), [(1, 20.0, 0.0, 0.0, 1.0), (1, 22.0, 0.0, 0.0, 1.0)])
    assert labels[0][0] == "underutilized_gpu" and d.user_facing_bottleneck == "input_bound"


def test_phases_take_the_maximum_and_count_before_the_end(spark):
    rows = step(1, 1000, ("phase_span", 0, {"phase_name": "forward"}), ("phase_span", 400, {"phase_name": "forward"}))
    rows.append((1, 1, 120, "phase_span", 300, {"phase_name": "backward"}, None))
    r = S.step_metrics(spark.createDataFrame(rows, EVENTS)).first()
    assert (r.forward_time_ns, r.backward_time_ns, r.gpu_active_fraction_proxy) == (400, 300, 0.4)


def test_numbers_as_text_and_booleans(spark):
    rows = step(1, 1000, ("profiler_window", 0, {"window_state": "exported", "kernel_count": "12", "small_kernel_fraction": "true", "median_cuda_kernel_duration_us": "7.5"}))
    r = S.step_metrics(spark.createDataFrame(rows, EVENTS)).first()
    assert (r.kernel_count, r.small_kernel_fraction, r.median_cuda_kernel_duration_us) == (12, 0.0, 7.5)


def test_steady_state_skips_and_keeps_last(spark):
    steps = S.step_metrics(spark.createDataFrame([r for i in range(6) for r in step(i, 100, status="ok" if i != 3 else "error")], EVENTS))
    assert [r.step_id for r in S.steady_state_steps(steps).orderBy("step_id").collect()] == [2, 4, 5]
    assert [r.step_id for r in S.steady_state_steps(steps, 0, 2).orderBy("step_id").collect()] == [4, 5]


def test_empty_tables(spark):
    steps = S.step_metrics(spark.createDataFrame([], EVENTS))
    assert S.run_summary(steps, spark.createDataFrame([], SAMPLES)).count() == 0
    assert isinstance(Row(), tuple) and steps.count() == 0


@pytest.mark.parametrize("skip", [0, 2])
def test_measurement_window(spark, skip):
    steps = S.step_metrics(spark.createDataFrame([r for i in range(5) for r in step(i, 100)], EVENTS))
    assert S.measurement_window(steps, skip, 10).first().step_count == 5 - skip
