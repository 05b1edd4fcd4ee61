"""Rules, texts, layers, versions and the event model on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gaugefleet.operators import compare as D
from gaugefleet.operators import evaluate as V
from gaugefleet.operators import ir as I
from gaugefleet.operators import presets as S
from gaugefleet.operators import ptx as X
from gaugefleet.operators import recommend as R
from gaugefleet.operators import reconcile as E
from gaugefleet.operators import source as C


def signals(spark, run, true=(), false=()):
    values = {**dict.fromkeys(true, "true"), **dict.fromkeys(false, "false")}
    return spark.createDataFrame([(run, values)], "run_id long, signals map<string,string>")


def test_severe_input_starvation(spark):
    labels = spark.createDataFrame([(1, "input_bound", 0.45)], "run_id long, label string, score double")
    held = signals(spark, 1, ["input_pipeline_severe", "input_pipeline_stalled", "low_gpu_activity"], ["h2d_copy_stalled"])
    best = R.best_rule_per_rec(R.rule_match_join(labels, held))
    assert {(r.rec, r.rule) for r in best.collect()} == {(x, "rule_input_starvation_high") for x in ("rec_input_num_workers", "rec_input_prefetch_factor", "rec_input_move_transforms")}
    scored = {r.rec: r for r in R.score_recommendations(R.catalog_join(best)).collect()}
    # high impact: 0.70; 0.30 * 0.70 + 0.20 * 0.45 + 0.20 * (0.6 * 0.70 + 0.4 * 0.35) + 0.15 * 0.90 + 0.15 * 0.55 + 0.20
    assert scored["rec_input_num_workers"].rec_score == pytest.approx(0.8295) and scored["rec_input_num_workers"].tier == "try_now"


def test_rules_and_catalog_are_whole(spark):
    rules, catalog = R.rules(spark).collect(), {r.rec for r in R.catalog(spark).collect()}
    assert (len(rules), len(catalog)) == (41, 44) and all(set(r.recs) <= catalog for r in rules)


PTX = """
.version 8.0
.target sm_80
.visible .entry first(.param .u64 p)
{
  .reg .pred %p<3>;
  .reg .b32 %r<40>;
  .reg .b64 %rd<20>;
  .local .align 4 .b8 stack[32];
  ld.global.v4.f32 {%f1, %f2, %f3, %f4}, [%rd1];
$L0:
  ld.local.f32 %f5, [%rd2];
  @%p1 bra $L0;
  bra $L9;
$L9:
  ret;
}
.visible .entry empty() { }
.visible .entry open() {
"""


def test_compiled_text(spark):
    texts = spark.createDataFrame([(1, "a.ptx", PTX), (2, "b.ptx", None)], "run_id long, path string, text string")
    rows = {r.kernel_name: r for r in X.ptx_findings(X.ptx_instruction_mix(X.scan_ptx_kernels(texts))).collect()}
    assert set(rows) == {"first", "empty"}
    r = rows["first"]
    assert (r.registers, r.local_bytes, r.instructions, r.branches, r.conditional_branches, r.loops) == (80, 32, 5, 2, 1, 1)
    assert r.mix == {"global_loads": 4, "local_loads": 1, "control_flow": 3}
    assert r.findings == ["register_spills_detected", "high_register_count", "high_global_memory_ratio", "high_branch_count"]
    assert rows["empty"].instructions == 0 and rows["empty"].findings == []


CUDA = """/* __global__ void old() {} */
__global__ void sum(const float* x, float* y, int stride) {
  __shared__ float t[32][33];
  int i = threadIdx.x * stride;
  if (threadIdx.x < 16) { t[0][i] = x[i]; __syncthreads(); }
  for (int k = 0; k < 4; ++k) { for (;;) { __syncthreads(); } }
  y[i] = 1.0f;
}
void go() { sum<<<dim3(4, 2), dim3(8, 3)>>>(a, b, 2); sum<<<1, n>>>(a, b, 2); }
"""


def test_source_text(spark):
    scanned = C.scan_cuda_kernels(spark.createDataFrame([(1, "a.cu", CUDA)], "run_id long, path string, text string"))
    kernel = C.source_signals(scanned).first()
    assert (kernel.name, kernel.line, kernel.syncs_in_loops, kernel.numbers["sync_count"]) == ("sum", 2, 2, 2.0)
    assert kernel.numbers["max_shared_bytes"] == 32 * 33 * 4 and kernel.signals["strided_or_pitched"] == "true"
    found = {r.rule for r in C.source_rule_match(C.source_signals(scanned)).collect()}
    assert {"conditional_syncthreads", "uncoalesced_access", "dimensions_not_tensor_core_friendly"} <= found and "shared_memory_without_barrier" not in found
    launches = C.source_rule_match(C.launch_signals(scanned.where("kind = 'launch'")), scope="launch").collect()
    assert [r.rule for r in launches] == ["poor_block_size_subwarp"]
    assert C.launch_kernel_join(scanned).first().block_sizes == [24]
    assert [r.estimated_occupancy_pct for r in C.launch_advice(C.source_signals(scanned)).orderBy("block_size").collect()] == [100.0, 100.0, 100.0]


def test_confidence_grows_with_layers(spark):
    layers = spark.createDataFrame(
        [(1, "source", ["strided_or_pitched"]), (1, "ptx", []), (1, "ncu", ["uncoalesced_global_loads"]), (2, "ncu", ["tensor_core_underutilized"]), (3, "ncu", ["occupancy_limited_by_registers", "occupancy_good"])],
        "run_id long, layer string, names array<string>",
    )
    found = E.reconcile_layers(layers)
    assert {(r.run_id, r.label, r.confidence) for r in found.collect()} == {(1, "inefficient_global_memory_access", "medium-high"), (2, "tensor_core_underutilization", "medium")}
    assert E.missing_evidence(found, layers).count() == 0
    labels = spark.createDataFrame([(1, "ncu", "uncoalesced_access"), (1, "ncu", "low_issue_efficiency"), (3, "ncu", "occupancy_limited_by_registers")], "run_id long, layer string, label string")
    assert {(r.run_id, r.label) for r in E.unreconciled_findings(labels, found).collect()} == {(1, "low_issue_efficiency"), (3, "occupancy_limited_by_registers")}


def test_versions_of_a_kernel(spark):
    side = lambda regs, spill, occ: spark.createDataFrame([(1, regs, spill, occ)], "pair_id long, register_count long, has_register_spills boolean, avg_occupancy_pct double")
    diff = D.numeric_bool_diff(side(80, True, 70.0), side(40, False, 45.0))
    assert {r.field: (r.delta, r.better, r.change) for r in diff.collect()} == {"register_count": (-40.0, "b", None), "has_register_spills": (None, None, "resolved"), "avg_occupancy_pct": (-25.0, "a", None)}
    assert [r.label for r in D.tradeoffs(diff).collect()] == ["register_pressure_improved_but_occupancy_regressed"]
    codes = lambda *c: spark.createDataFrame([(1, x) for x in c], "pair_id long, code string")
    change = D.finding_diff(codes("x", "y"), codes("y", "z"))
    case = spark.createDataFrame([(1, ["x"], ["x"], True)], "pair_id long, detected_before array<string>, resolved_after array<string>, no_new_findings boolean")
    row = D.case_validation(case, codes("x", "y"), change).first()
    assert (row.missing_before, row.missing_resolved, row.new_findings, row.passed) == ([], [], ["z"], False)


def test_profiles_take_percentages_only(spark):
    text = "{'metrics': {'Max Bandwidth': {'avg_value': 61.5, 'unit': '%'}, 'L2 Hit Rate': {'avg_value': 9.0, 'unit': 'byte/second'}, 'Block Limit Warps': {'avg_value': 2}, 'Block Limit Registers': {'avg_value': 2}, 'Block Limit SM': {'avg_value': 0}}}"
    rows = V.adapt_eval_profile(spark.createDataFrame([("a", text), ("b", "open('x')"), ("c", None), ("d", "{'metrics': {}}")], "row_key string, profile string")).collect()
    (r,) = rows
    assert (r.row_key, r.dram_throughput_pct, r.l2_cache_hit_rate_pct, r.limiters) == ("a", 61.5, None, ["registers", "threads"])


def test_thresholds_and_bands(spark):
    runs = spark.createDataFrame([(1, "sm_90"), (2, None)], "run_id long, arch string")
    with pytest.raises(ValueError, match="no thresholds"):
        S.threshold_override_join(runs, {"sm_90": {"typo": 1.0}})
    got = {r.run_id: r for r in S.threshold_override_join(runs, {"sm_90": {"input_bound_ratio": 0.3}}).collect()}
    assert got[1].thresholds["input_bound_ratio"] == 0.3 and got[2].threshold_source == "defaults" and got[1].thresholds_hash != got[2].thresholds_hash and len(got[1].thresholds_hash) == 12
    bands = spark.createDataFrame([(1, 70.0, 45.0, 0.51)], "run_id long, avg_dram_throughput_pct double, avg_occupancy_pct double, memory_stall_fraction double")
    assert {r.metric: r.status for r in S.metric_bands(bands).collect()} == {"avg_dram_throughput_pct": "ELEVATED", "avg_occupancy_pct": "LOW", "memory_stall_fraction": "HIGH"}


def test_steps_of_the_event_model(spark):
    rows = [(1, 1, "cpu", "training_step", "s1", 100, {"x": [8, 2]}), (1, 2, "kernel", "k", "s1", 70, None), (1, 3, "data_pipeline", "d", "s2", 25, None), (1, 4, "cpu", "cpu_span", "s2", 100, {"x": [4, 2]}), (1, 5, "distributed", "c", "s2", 15, None)]
    steps = I.ir_step_summary(spark.createDataFrame(rows, "run_id long, seq long, event_family string, event_type string, step_id string, duration_ns long, shapes map<string,array<int>>"))
    metrics = spark.createDataFrame([(1, "memory_used_bytes", 95.0), (1, "memory_total_bytes", 100.0)], "run_id long, metric_name string, value double")
    runs = I.ir_run_summary(steps, metrics)
    assert {(r.target_id, r.label, r.score) for r in I.ir_step_labels(steps, runs).collect()} == {("s1", "compute_bound", 0.7), ("s2", "input_bound", 0.25), ("s2", "communication_bound", 0.15), ("1", "memory_pressure", 0.95), ("1", "shape_instability", 1.0)}
    assert runs.first().throughput_steps_per_sec == pytest.approx(2 / 2e-7) and runs.agg(F.max("compute_time_ns")).first()[0] == 70
