"""Values that the SQL takes over from the operators, written out by hand: cuts, presets, claims, evidence and some rules."""

import pytest
from pyspark.sql import functions as F

from gaugefleet.operators import presets as PS
from gaugefleet.operators import recommend as RE
from gaugefleet.operators import reconcile as RC

BANDS = [
    ("avg_dram_throughput_pct", 50.0, "OK"), ("avg_dram_throughput_pct", 50.01, "ELEVATED"), ("avg_dram_throughput_pct", 70.0, "ELEVATED"), ("avg_dram_throughput_pct", 70.01, "SATURATED"),
    ("avg_tensor_core_utilization_pct", 50.0, "OK"), ("avg_tensor_core_utilization_pct", 49.99, "LOW"), ("avg_tensor_core_utilization_pct", 20.0, "LOW"), ("avg_tensor_core_utilization_pct", 19.99, "POOR"),
    ("avg_l1_cache_hit_rate_pct", 70.0, "OK"), ("avg_l1_cache_hit_rate_pct", 69.99, "LOW"), ("avg_l1_cache_hit_rate_pct", 40.0, "LOW"), ("avg_l1_cache_hit_rate_pct", 39.99, "POOR"),
    ("avg_l2_cache_hit_rate_pct", 70.0, "OK"), ("avg_l2_cache_hit_rate_pct", 50.0, "LOW"), ("avg_l2_cache_hit_rate_pct", 49.99, "POOR"),
    ("avg_global_load_sectors_per_request", 2.0, "OK"), ("avg_global_load_sectors_per_request", 4.0, "ELEVATED"), ("avg_global_load_sectors_per_request", 4.01, "POOR"),
    ("avg_issue_slot_utilization_pct", 60.0, "OK"), ("avg_issue_slot_utilization_pct", 40.0, "LOW"), ("avg_issue_slot_utilization_pct", 39.99, "POOR"),
    ("avg_occupancy_pct", 50.0, "OK"), ("avg_occupancy_pct", 30.0, "LOW"), ("avg_occupancy_pct", 29.99, "POOR"),
    ("memory_stall_fraction", 0.2, "OK"), ("memory_stall_fraction", 0.5, "ELEVATED"), ("memory_stall_fraction", 0.51, "HIGH"), ("anything_else", 1.0, ""),
]


def test_bands(spark):
    df = spark.createDataFrame(BANDS, "metric string, value double, want string").withColumn("got", PS.metric_status(F.col("metric"), F.col("value")))
    assert df.where("got <> want").collect() == []


def test_presets(spark):
    present = spark.createDataFrame([(1, "dram_throughput_pct"), (1, "l1_cache_hit_rate_pct"), (1, "l2_cache_hit_rate_pct"), (1, "warp_stall_memory_throttle"), (1, "achieved_occupancy_pct")], "run_id long, metric string")
    missing = {r.preset: r.missing for r in PS.metric_validation(present).collect()}
    assert missing["memory"] == ["warp_stall_long_scoreboard"] and missing["tensor"] == ["tensor_core_utilization_pct", "issue_slot_utilization_pct"] and missing["occupancy"] == ["threads_per_block", "registers_per_thread"]


def test_thresholds(spark):
    runs = spark.createDataFrame([(1, "sm_90"), (2, "other")], "run_id long, arch string")
    rows = {r.run_id: r for r in PS.threshold_override_join(runs, {"sm_90": {"copy_bound_ratio": 0.4}}).collect()}
    want = {
        "ncu_dram_throughput_high_pct": 70.0, "ncu_memory_stall_fraction_min": 0.5, "ncu_dominant_warp_stall_pct": 20.0, "ncu_l1_hit_low_pct": 40.0, "ncu_l2_hit_low_pct": 50.0, "ncu_load_sectors_per_request_high": 4.0,
        "ncu_tc_util_low_pct": 30.0, "ncu_tc_occupancy_ok_pct": 40.0, "ncu_occupancy_low_pct": 40.0, "ncu_eligible_warps_low": 1.0, "ncu_scheduler_active_low_pct": 40.0, "ncu_issue_slot_low_pct": 60.0, "input_bound_ratio": 0.2,
        "copy_bound_ratio": 0.15, "sync_bound_ratio": 0.1, "underutilized_gpu_util_pct": 35.0, "memory_pressure_peak_ratio": 0.9, "shape_volatility_ratio": 0.3, "launch_bound_gpu_util_pct": 50.0, "launch_bound_stall_ratio_max": 0.1,
        "fat_high_threshold": 45.0, "fat_moderate_threshold": 20.0,
    }
    assert rows[2].thresholds == want and rows[1].thresholds == want | {"copy_bound_ratio": 0.4}
    assert (rows[1].threshold_source, rows[2].threshold_source) == ("defaults+arch_overrides", "defaults") and rows[1].thresholds_hash != rows[2].thresholds_hash
    with pytest.raises(ValueError, match="no_such"):
        PS.threshold_override_join(runs, {"sm_90": {"no_such": 1.0}})


def test_layers_claims_and_evidence(spark):
    layers = spark.createDataFrame(
        [
            (1, "source", ["strided_or_pitched"]), (1, "ptx", ["ptx_no_shared_memory"]), (1, "ncu", ["uncoalesced_global_loads"]), (2, "ncu", ["occupancy_limited_by_registers", "occupancy_good"]), (2, "ptx", ["ptx_high_register_count"]),
            (3, "profiler", ["sync_bound"]), (3, "ncu", []), (4, "ncu", ["mfu_very_low", "roofline_memory_bound"]),
        ],
        "run_id long, layer string, names array<string>",
    )
    found = RC.reconcile_layers(layers)
    rows = {(r.run_id, r.label): (r.severity, r.confidence, r.layers_confirming) for r in found.collect()}
    assert rows == {
        (1, "inefficient_global_memory_access"): ("high", "confirmed", ["ncu", "ptx", "source"]), (2, "register_pressure"): ("high", "low-medium", ["ptx"]),
        (3, "excessive_synchronization"): ("medium", "low-medium", ["profiler"]), (4, "roofline_memory_bound"): ("high", "medium", ["ncu"]),
    }
    evidence = {(r.run_id, r.label): r.metrics for r in RC.missing_evidence(found, layers).collect()}
    assert evidence == {(2, "register_pressure"): ["launch__registers_per_thread", "sm__warps_active.avg.pct_of_peak_sustained_active"], (3, "excessive_synchronization"): ["smsp__warp_issue_stalled_barrier_per_warp_active.pct"]}
    labels = [(1, "source", "strided_or_pitched"), (1, "ncu", "uncoalesced_access"), (1, "ncu", "warp_stall_sync"), (2, "ptx", "ptx_register_pressure"), (2, "ncu", "occupancy_limited_by_registers"), (3, "profiler", "sync_bound")]
    left = RC.unreconciled_findings(spark.createDataFrame(labels, "run_id long, layer string, label string"), found)
    assert {tuple(r) for r in left.collect()} == {(1, "ncu", "warp_stall_sync"), (2, "ncu", "occupancy_limited_by_registers")}


def test_rules_of_the_input_pipeline(spark):
    signals = [(1, {"input_pipeline_severe": "true", "input_pipeline_stalled": "true", "low_gpu_activity": "true"}), (2, {"input_pipeline_stalled": "true", "h2d_copy_stalled": "true"}), (3, {"input_pipeline_stalled": "true"}), (4, {})]
    labels = [(1, "input_bound", 0.35), (2, "input_bound", 0.2), (3, "input_bound", 0.19), (4, "input_bound", 0.9)]
    matched = RE.rule_match_join(spark.createDataFrame(labels, "run_id long, label string, score double"), spark.createDataFrame(signals, "run_id long, signals map<string,string>"))
    first = ("rule_input_starvation_high", "rule_input_starvation_moderate", "rule_input_with_h2d_pressure")
    got = {(r.run_id, r.rule): (r.boost, r.recs) for r in matched.collect() if r.rule in first}
    assert got == {
        (1, "rule_input_starvation_high"): (0.25, ["rec_input_num_workers", "rec_input_prefetch_factor", "rec_input_move_transforms"]),
        (2, "rule_input_starvation_moderate"): (0.1, ["rec_input_num_workers", "rec_input_prefetch_factor"]), (2, "rule_input_with_h2d_pressure"): (0.15, ["rec_input_pinned_memory"]),
    }
