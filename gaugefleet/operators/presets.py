"""What a profile should hold: metric bands, presets and what they miss, limits of architectures, thresholds and their overrides."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics with whether more is better, the good cut, the bad cut and the word beyond it.
BANDS = {
    "avg_dram_throughput_pct": (False, 50.0, 70.0, "SATURATED"),
    "avg_tensor_core_utilization_pct": (True, 50.0, 20.0, "POOR"),
    "avg_l1_cache_hit_rate_pct": (True, 70.0, 40.0, "POOR"),
    "avg_l2_cache_hit_rate_pct": (True, 70.0, 50.0, "POOR"),
    "avg_global_load_sectors_per_request": (False, 2.0, 4.0, "POOR"),
    "avg_issue_slot_utilization_pct": (True, 60.0, 40.0, "POOR"),
    "avg_occupancy_pct": (True, 50.0, 30.0, "POOR"),
    "memory_stall_fraction": (False, 0.2, 0.5, "HIGH"),
}
# Metrics that a preset needs; full needs them all.
PRESETS = {
    "memory": ("dram_throughput_pct", "l1_cache_hit_rate_pct", "l2_cache_hit_rate_pct", "warp_stall_memory_throttle", "warp_stall_long_scoreboard"),
    "tensor": ("tensor_core_utilization_pct", "achieved_occupancy_pct", "issue_slot_utilization_pct"),
    "occupancy": ("achieved_occupancy_pct", "threads_per_block", "registers_per_thread"),
    "stalls": ("warp_stall_memory_throttle", "warp_stall_long_scoreboard", "warp_stall_barrier", "warp_stall_wait", "eligible_warps_per_scheduler", "scheduler_active_pct", "issue_slot_utilization_pct"),
}
PRESETS["full"] = tuple(dict.fromkeys(m for p in PRESETS.values() for m in p))
# Counters that architectures from 100 on no longer have.
SAMPLED, LAST_SAMPLED = "smsp__pcsamplingdata_", 100
# Thresholds of the classifiers.
THRESHOLDS = {
    "ncu_dram_throughput_high_pct": 70.0, "ncu_memory_stall_fraction_min": 0.50, "ncu_dominant_warp_stall_pct": 20.0, "ncu_l1_hit_low_pct": 40.0, "ncu_l2_hit_low_pct": 50.0, "ncu_load_sectors_per_request_high": 4.0,
    "ncu_tc_util_low_pct": 30.0, "ncu_tc_occupancy_ok_pct": 40.0, "ncu_occupancy_low_pct": 40.0, "ncu_eligible_warps_low": 1.0, "ncu_scheduler_active_low_pct": 40.0, "ncu_issue_slot_low_pct": 60.0,
    "input_bound_ratio": 0.2, "copy_bound_ratio": 0.15, "sync_bound_ratio": 0.1, "underutilized_gpu_util_pct": 35.0, "memory_pressure_peak_ratio": 0.9, "shape_volatility_ratio": 0.3,
    "launch_bound_gpu_util_pct": 50.0, "launch_bound_stall_ratio_max": 0.1, "fat_high_threshold": 45.0, "fat_moderate_threshold": 20.0,
}


def metric_status(name: Column, value: Column) -> Column:
    """The band of a value: OK, LOW, POOR, ELEVATED, SATURATED or HIGH; empty for a metric without bands."""
    out = F.lit("")
    for metric, (up, good, bad, word) in BANDS.items():
        band = F.when(value >= good, "OK").when(value >= bad, "LOW").otherwise(word) if up else F.when(value <= good, "OK").when(value <= bad, "ELEVATED").otherwise(word)
        out = F.when(name == metric, band).otherwise(out)
    return out


def metric_bands(summaries: DataFrame) -> DataFrame:
    """(run_id, metric, value, status) of the metrics with bands that a run summary has."""
    have = [m for m in BANDS if m in summaries.columns]
    tall = summaries.select("run_id", *[F.col(m).cast("double").alias(m) for m in have]).unpivot("run_id", have, "metric", "value").where("value is not null")
    return tall.withColumn("status", metric_status(F.col("metric"), F.col("value")))


def metric_validation(present: DataFrame) -> DataFrame:
    """(run_id, preset, missing, complete) of every run and preset; ``present`` has run_id and metric (canonical names)."""
    held = present.groupBy("run_id").agg(F.collect_set("metric").alias("held"))  # as many as there are metric names
    names = lambda p: F.array(*map(F.lit, p))
    rows = F.array(*[F.struct(F.lit(k).alias("preset"), F.array_except(names(v), F.col("held")).alias("missing")) for k, v in PRESETS.items()])
    return held.select("run_id", F.explode(rows).alias("x")).select("run_id", "x.*").withColumn("complete", F.size("missing") == 0)


def filter_metrics_for_arch(metrics: DataFrame, name: str = "metric_name", arch: str = "arch") -> DataFrame:
    """Rows whose metric the architecture still has; an unknown architecture has them all."""
    sm = F.regexp_replace(F.col(arch), "[^0-9]", "").try_cast("int")
    return metrics.where(~F.coalesce(F.col(name).startswith(SAMPLED) & (sm >= LAST_SAMPLED), F.lit(False)))


def thresholds_hash(values: dict[str, float]) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:12]


def threshold_override_join(runs: DataFrame, overrides: dict[str, dict[str, float]], key: str = "arch") -> DataFrame:
    """Adds thresholds (a map), threshold_source and thresholds_hash to runs, by the overrides of their ``key``.

    Raises ValueError for an override of a threshold that there is not.
    """
    unknown = sorted({t for o in overrides.values() for t in o} - THRESHOLDS.keys())
    if unknown:
        raise ValueError(f"no thresholds: {unknown}")
    rows = [(k, THRESHOLDS | o, "defaults+arch_overrides", thresholds_hash(THRESHOLDS | o)) for k, o in overrides.items() if o]
    table = runs.sparkSession.createDataFrame(rows, f"{key} string, o map<string,double>, s string, h string")
    usual = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    both = runs.join(F.broadcast(table), key, "left")
    return both.withColumns({"thresholds": F.coalesce("o", usual), "threshold_source": F.coalesce("s", F.lit("defaults")), "thresholds_hash": F.coalesce("h", F.lit(thresholds_hash(THRESHOLDS)))}).drop("o", "s", "h")
