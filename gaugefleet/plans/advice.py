"""Queries over recommendations and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugefleet.operators import kernels as K
from gaugefleet.operators import recommend as R
from gaugefleet.plans import profiling as P
from gaugefleet.plans import telemetry as T
from gaugefleet.plans.shared import BOTH, KERNEL_RUNS, Shared
from gaugefleet.plans.telemetry import _r, _rounded

def q_rule_match_join(spark, d):
    return Shared(spark, d).matched(*BOTH).select("run_id", "label", "rule", "boost")


def q_best_rule_per_rec(spark, d):
    return _rounded(R.best_rule_per_rec(Shared(spark, d).matched(*BOTH)))


def q_catalog_join(spark, d):
    return R.catalog_join(R.best_rule_per_rec(Shared(spark, d).matched(*BOTH))).select("run_id", "rec", "title", "category", "impact", "effort", "safety")


def q_score_recommendations(spark, d):
    return Shared(spark, d).scored(*BOTH).select("run_id", "rec", "rec_score", "priority", "tier")


def q_dedupe_and_order_recs(spark, d):
    return R.dedupe_and_order_recs(Shared(spark, d).scored(*BOTH)).select("run_id", "rec", "rec_score", F.col("place").cast("long").alias("place"))


def q_recommendation_bundles(spark, d):
    return R.recommendation_bundles(Shared(spark, d).recommendations(*BOTH)).withColumn("recs", F.array_join("recs", ","))


def q_withheld_recs(spark, d):
    shared = Shared(spark, d)
    return R.withheld_recs(*shared.inputs(*BOTH), shared.recommendations(*BOTH))


def q_extract_kernel_signals(spark, d):
    df = K.extract_kernel_signals(P.profiled_runs(spark, d))
    true = F.transform(F.map_entries("signals"), lambda e: F.when(e["value"] == "true", e["key"]).when(~e["value"].isin("true", "false"), F.concat(e["key"], F.lit("="), e["value"])))
    names = F.array_join(F.array_sort(F.array_compact(true)), ",")
    return _rounded(df.select("run_id", names.alias("signals"), *[F.col("numbers")[k].alias(k) for k in _NUMBERS]))


def q_validation_steps_join(spark, d):
    shared = Shared(spark, d)
    steps = R.validation_steps_join(shared.recommendations(*BOTH), shared.inputs(*BOTH)[1])
    return _rounded(steps.select("run_id", "rec", F.col("step").cast("long").alias("step"), "metric", "direction", "threshold_good", "current_value"))


def q_top_recommendation(spark, d):
    return R.top_recommendation(Shared(spark, d).recommendations(*BOTH))


_NUMBERS = ("dram_throughput_pct", "l1_cache_hit_rate_pct", "issue_slot_utilization_pct", "avg_barrier_stall_pct", "avg_math_throttle_stall_pct", "avg_registers_per_thread", "mfu_pct", "arithmetic_intensity")
QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_text = lambda x: "'" + str(x).replace("'", "''") + "'"
_pairs = lambda conditions: "[" + ", ".join(_text(f"{k}={v}") for k, v in conditions.items()) + "]::VARCHAR[]"
_book = R.book()
_rules = ", ".join(
    f"({i}, {_text(r['id'])}, {_text(r['bottleneck'])}, {r['min_score']}::DOUBLE, {_pairs(r['signals'])}, {_pairs(r['suppressed_if'])}, {r['priority_boost']}::DOUBLE, [{', '.join(map(_text, r['recommendations']))}])" for i, r in enumerate(_book["rules"])
)
_null = lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"
_catalog = ", ".join(f"({', '.join(_text(c[k]) for k in ('id', 'title', 'category', 'impact', 'effort', 'safety'))}, {_null(c['speedup_pct_min'])}, {_null(c['speedup_pct_max'])})" for c in _book["catalog"])
_steps = ", ".join(f"({_text(c['id'])}, {i}::BIGINT, {_text(v['metric'])}, {_text(v['direction'])}, {_null(v['threshold_good'])})" for c in _book["catalog"] for i, v in enumerate(c["validation"]))
_equal = lambda pairs: ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}=true' ELSE '{n}=false' END" for n, c in pairs)
_ENV = [("framework_pytorch", "false"), ("mixed_precision_enabled", "false"), ("is_distributed", "false")]
_OCC, _ISSUE, _CAUSE = "coalesce(avg_occupancy_pct, 0.0)", "coalesce(avg_issue_slot_utilization_pct, 0.0)", "string_split(limit_causes, ',')"
_KERNEL_SIGNALS = [
    ("memory_bandwidth_saturated", "avg_dram_throughput_pct > 70"), ("memory_bandwidth_high", "avg_dram_throughput_pct > 50"), ("tensor_core_underutilized", "avg_tensor_core_utilization_pct < 30"), ("tensor_core_inactive", "avg_tensor_core_utilization_pct < 10"),
    ("l1_cache_miss_heavy", "avg_l1_cache_hit_rate_pct < 40"), ("l2_cache_miss_heavy", "avg_l2_cache_hit_rate_pct < 50"), ("uncoalesced_global_loads", "avg_global_load_sectors_per_request > 4"), ("issue_efficiency_low", f"{_ISSUE} < 60"),
    ("issue_efficiency_very_low", f"{_ISSUE} < 40"), ("eligible_warps_low", "avg_eligible_warps_per_scheduler < 1"), ("scheduler_active_low", "avg_scheduler_active_pct < 40"), ("occupancy_good", f"{_OCC} > 60"), ("occupancy_low", f"{_OCC} < 30"),
    ("occupancy_limited_by_registers", f"list_contains({_CAUSE}, 'registers')"), ("occupancy_limited_by_shared_memory", f"list_contains({_CAUSE}, 'shared_memory')"),
    ("occupancy_limited_by_block_size", f"list_has_any({_CAUSE}, ['threads', 'blocks', 'unknown_threads_per_block'])"), ("warp_stall_is_memory", "dominant_warp_stall = 'long_scoreboard'"), ("warp_stall_is_sync", "dominant_warp_stall = 'barrier'"),
    ("warp_stall_is_compute", "dominant_warp_stall = 'short_scoreboard'"), ("mfu_low", "mfu_pct < 40"), ("roofline_estimated", "false"),
]
# The steps of profiled runs first: their tables come with the names of profiling.py.
_KERNEL = f"""{P._CLASSES.replace(", lab AS", ", klab AS")}, {P._ARCH},
    kr0 AS (SELECT rs.*, ar.*, coalesce(avg_dram_throughput_pct, 0.0) AS d, coalesce(avg_tensor_core_utilization_pct, 0.0) AS t, coalesce(avg_issue_slot_utilization_pct,
      0.0) AS i FROM rs JOIN dv ON n = run_id % 5 JOIN ar ON ar.arch = coalesce(dv.arch, 'sm_80')),
    kr1 AS (SELECT *, d <> 0 OR t <> 0 OR i <> 0 AS known, CASE WHEN t > 5 THEN fp16 ELSE fp32 END AS peak, CASE WHEN t > 5 THEN t * fp16 ELSE i * fp32 END / 100.0 AS tf, d / 100.0 * bw AS abw FROM kr0),
    kr2 AS (SELECT *, CASE WHEN known AND abw > 0 THEN {_r("tf / abw * 1000.0")} END AS arithmetic_intensity, CASE WHEN known THEN {_r("tf / fp32 * 100.0", 2)} END AS mfu_pct FROM kr1),
    kr3 AS (SELECT *, CASE WHEN known THEN CASE WHEN arithmetic_intensity < peak / bw * 1000.0 THEN 'memory_bound' ELSE 'compute_bound' END END AS roofline_region FROM kr2),
    kr AS (SELECT kr3.*, coalesce(bs.mean, 0.0) AS barrier_mean FROM kr3 LEFT JOIN sm bs ON bs.rid = run_id AND bs.stall = 'barrier'),
    ksg AS (SELECT run_id + {KERNEL_RUNS} AS rid, list_filter([{_equal(_KERNEL_SIGNALS + _ENV)}, 'dominant_warp_stall=' || dominant_warp_stall, 'roofline_region=' || roofline_region], lambda x: x IS NOT NULL) AS sig, kr.* FROM kr)"""
_SQL = f"""{_KERNEL}, {T._STEPS.removeprefix("WITH ")}, so AS (SELECT *, {T._over["i"]} AS i, {T._over["c"]} AS c, {T._over["s"]} AS s FROM runs WHERE scope = 'run'),
    sg AS (SELECT run_id AS rid, [{_equal(T._SIGNALS + _ENV)}] AS sig, {_r("i")} AS input_frac, {_r("c")} AS h2d_frac FROM so UNION ALL SELECT rid, sig, NULL, NULL FROM ksg),
    labels AS (SELECT run_id, label, score FROM lab WHERE scope = 'run' UNION ALL SELECT run_id + {KERNEL_RUNS}, label, score FROM klab),
    ru(o, rule, rlabel, least_score, needs, stops, boost, recs) AS (VALUES {_rules}),
    ma AS (SELECT run_id, label, score, ru.*, sig FROM labels JOIN ru ON rlabel = label AND score >= least_score JOIN sg ON rid = run_id WHERE list_has_all(sig, needs) AND NOT list_has_any(sig, stops)),
    be AS (SELECT run_id, rule, boost, score, rec FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rec ORDER BY boost DESC, o) AS n FROM (SELECT run_id, rule, o, boost, score, unnest(recs) AS rec FROM ma)) WHERE n = 1),
    ct(crec, title, category, impact, effort, safety, smin, smax) AS (VALUES {_catalog}), ca AS (SELECT * FROM be JOIN ct ON crec = rec),
    mid AS (SELECT *, coalesce((smin + smax) / 2, CASE impact WHEN 'high' THEN 17.5 WHEN 'low' THEN 3.0 ELSE 8.5 END) AS pct FROM ca),
    s0 AS (SELECT *, CASE WHEN pct < 2 THEN 0.1 WHEN pct < 5 THEN 0.25 WHEN pct < 10 THEN 0.45 WHEN pct < 20 THEN 0.7 WHEN pct < 35 THEN 0.9 ELSE 1.0 END::DOUBLE AS sp,
      CASE effort WHEN 'config' THEN 1.0 WHEN 'low' THEN 0.9 WHEN 'high' THEN 0.2 WHEN 'custom_cuda' THEN 0.1 ELSE 0.55 END::DOUBLE AS ea, CASE safety WHEN 'high' THEN 0.9 WHEN 'low' THEN 0.2 ELSE 0.55 END::DOUBLE AS sa FROM mid),
    sc AS (SELECT *, {_r(f"least(1.0, (0.30 * sp + 0.20 * score + 0.20 * {_r('0.6 * sp + 0.14')} + 0.15 * ea + 0.15 * sa + least(boost, 0.2)) * CASE WHEN score < 0.4 THEN 0.75 ELSE 1.0 END * CASE WHEN sa < 0.4 AND sp < 0.7 THEN 0.85 ELSE 1.0 END)")}
      AS rec_score FROM s0),
    pr AS (SELECT *, CASE WHEN rec_score >= 0.75 THEN 'high' WHEN rec_score >= 0.5 THEN 'medium' ELSE 'low' END AS priority FROM sc),
    de AS (SELECT * FROM pr WHERE NOT (rec = 'rec_input_pinned_memory' AND run_id IN (SELECT run_id FROM sc WHERE rec = 'rec_copy_pinned_memory'))),
    af(arec, need) AS (VALUES ('rec_launch_cuda_graphs', 'rec_launch_torch_compile'), ('rec_launch_fuse_ops', 'rec_launch_torch_compile'), ('rec_shape_disable_dynamic', 'rec_shape_bucket_inputs')),
    od AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rec_score DESC, rec) AS place FROM (SELECT a.run_id, a.rec, a.title, a.priority, a.category, CASE
      WHEN a.rec_score >= b.rec_score THEN {_r("greatest(0.0, b.rec_score - 0.0001)")} ELSE a.rec_score END AS rec_score FROM de a LEFT JOIN af ON arec = a.rec LEFT JOIN de b
      ON b.run_id = a.run_id AND b.rec = need))"""
_VALUE = {
    "l1tex__t_sectors_pipe_lsu_mem_global_op_ld.sum_per_request": "avg_global_load_sectors_per_request", "dram__throughput.avg.pct_of_peak_sustained_elapsed": "coalesce(avg_dram_throughput_pct, 0.0)", "sm__pipe_tensor_cycles_active.avg.pct_of_peak_sustained_active": "coalesce(avg_tensor_core_utilization_pct, 0.0)",
    "smsp__warp_issue_stalled_barrier_per_warp_active.pct": "barrier_mean", "sm__issue_active.avg.pct_of_peak_sustained_active": "coalesce(avg_issue_slot_utilization_pct, 0.0)", "sm__warps_active.avg.pct_of_peak_sustained_active": "coalesce(avg_occupancy_pct, 0.0)", "l1tex__t_sector_hit_rate.pct": "avg_l1_cache_hit_rate_pct",
    "lts__t_sector_hit_rate.pct": "avg_l2_cache_hit_rate_pct", "smsp__warp_issue_stalled_math_pipe_throttle_per_warp_active.pct": "CASE WHEN rid IS NOT NULL THEN 0.0 END", "launch__registers_per_thread": _r("avg_registers_per_thread", 1),
}
ORACLES = {
    "rule_match_join": f"{_SQL} SELECT run_id, label, rule, boost FROM ma",
    "best_rule_per_rec": f"{_SQL} SELECT run_id, rule, boost, score, rec FROM be",
    "catalog_join": f"{_SQL} SELECT run_id, rec, title, category, impact, effort, safety FROM ca",
    "score_recommendations": f"{_SQL} SELECT run_id, rec, rec_score, priority, CASE WHEN score < 0.4 THEN 'advanced' WHEN rec_score >= 0.75 AND ea >= 0.75 AND sa >= 0.55 THEN 'try_now' WHEN rec_score >= 0.5 THEN 'next' ELSE 'advanced' END AS tier FROM pr",
    "dedupe_and_order_recs": f"{_SQL} SELECT run_id, rec, rec_score, place FROM od",
    "recommendation_bundles": f"{_SQL} SELECT run_id, category, string_agg(rec, ',' ORDER BY place) AS recs FROM od GROUP BY ALL HAVING count(*) >= 2",
    "withheld_recs": f"{_SQL} SELECT run_id, input_frac, h2d_frac, 'rec_input_pinned_memory' AS rec, 'h2d_copy_low' AS blocked_by FROM labels JOIN sg ON rid = run_id WHERE label = 'input_bound' AND list_has_all(sig, ['input_pipeline_stalled=true', 'h2d_copy_low=true']) AND run_id NOT IN (SELECT run_id FROM od WHERE rec IN ('rec_input_pinned_memory', 'rec_copy_pinned_memory'))",
    "extract_kernel_signals": f"""{_KERNEL} SELECT run_id, list_aggregate(list_sort(list_filter(list_transform(sig, lambda x: CASE WHEN x LIKE '%=true' THEN replace(x,
      '=true', '') WHEN x LIKE '%=false' THEN NULL ELSE x END), lambda x: x IS NOT NULL)), 'string_agg', ',') AS signals, coalesce(avg_dram_throughput_pct, 0.0) AS
      dram_throughput_pct, avg_l1_cache_hit_rate_pct AS l1_cache_hit_rate_pct,
      coalesce(avg_issue_slot_utilization_pct, 0.0) AS issue_slot_utilization_pct, barrier_mean AS avg_barrier_stall_pct, 0.0::DOUBLE AS avg_math_throttle_stall_pct,
      {_r("avg_registers_per_thread", 1)} AS avg_registers_per_thread, mfu_pct, arithmetic_intensity FROM ksg""",
    "validation_steps_join": f"""{_SQL}, vs(vrec, step, metric, direction, threshold_good) AS (VALUES {_steps}) SELECT od.run_id, rec, step, metric, direction,
      threshold_good, CASE metric {" ".join(f"WHEN '{m}' THEN {v}" for m, v in _VALUE.items())} END AS current_value FROM od JOIN vs ON vrec = rec LEFT JOIN ksg ON rid =
      od.run_id""",
    "top_recommendation": f"{_SQL} SELECT rec, title, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, title) AS p FROM (SELECT rec, title, count(DISTINCT run_id) AS n FROM od WHERE priority = 'high' GROUP BY ALL)) WHERE p = 1",
}
