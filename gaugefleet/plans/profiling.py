"""Queries over kernel profiles and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.functions import half_up
from gaugefleet.operators import compare as D
from gaugefleet.operators import kernels as K
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import LINE_ORDER, table

# Raw names of the 21 metric slots, and what they are here.
SLOTS = [
    ("dram__throughput.avg.pct_of_peak_sustained_elapsed", "dram_throughput_pct"), ("sm__pipe_tensor_cycles_active.avg.pct_of_peak_sustained_active", "tensor_core_utilization_pct"), ("L1/TEX Cache Throughput", "l1_cache_hit_rate_pct"),
    ("lts__t_sector_hit_rate.pct", "l2_cache_hit_rate_pct"), ("gld_transactions_per_request", "global_load_sectors_per_request"), ("Issue Slots Busy", "issue_slot_utilization_pct"), ("Achieved Occupancy", "achieved_occupancy_pct"),
    ("smsp__warps_eligible.avg.per_cycle_active", "eligible_warps_per_scheduler"), ("smsp__warps_active.avg.pct_of_peak_sustained_active", "scheduler_active_pct"), ("Theoretical Occupancy", "theoretical_occupancy_pct"), ("Compute (SM) Throughput", "sm_throughput_pct"),
    ("l1tex-throughput", "l1tex_throughput_pct"), ("Mem Busy", "memory_busy_pct"), ("Duration", "kernel_duration_us"), ("launch__registers_per_thread", "registers_per_thread"), ("launch__shared_mem_per_block_static", "shared_memory_per_block_bytes"),
    ("launch__shared_mem_per_block_dynamic", "shared_memory_per_block_bytes"), ("launch__block_size", "threads_per_block"), ("smsp__pcsamplingdata_pct_of_utilization_issue_stalled_long_scoreboard", "warp_stall_long_scoreboard"),
    ("smsp__warp_issue_stalled_barrier_per_warp_active.pct", "warp_stall_barrier"), ("smsp__pcsamplingdata.pct-of utilization_issue_stalled_short_scoreboard", "warp_stall_short_scoreboard"),
]
DEVICES = ["NVIDIA A100-SXM4-80GB", "NVIDIA H100 80GB HBM3", "Tesla T4", "NVIDIA GeForce RTX 4090", "Unknown accelerator"]


def tall(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in SLOTS])
    rows = spark.sql(
        f"""SELECT l_suppkey % 20 AS run_id, concat(p_type, p_brand) AS kernel_name, (l_linenumber * 3 + l_partkey % 3) % 21 AS slot, l_quantity * 2 AS q, l_extendedprice / 100 AS e,
              row_number() OVER (PARTITION BY l_suppkey % 20, p_type, p_brand ORDER BY l_orderkey, {LINE_ORDER}) AS seq FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
        lineitem=table(spark, d, "lineitem"), part=table(spark, d, "part"),
    )
    return rows.select("run_id", "kernel_name", F.get(names, F.col("slot").cast("int")).alias("metric_name"), F.when(F.col("slot") == 13, F.col("e")).otherwise(F.col("q")).alias("value"), "seq")


def _kernels(spark: SparkSession, d: str) -> DataFrame:
    return K.occupancy_gap(K.estimate_occupancy(K.kernel_pivot(tall(spark, d))))


def _devices(df: DataFrame) -> DataFrame:
    return df.withColumn("device", F.get(F.array(*map(F.lit, DEVICES)), (F.col("run_id") % 5).cast("int")))


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    kernels = _devices(_kernels(spark, d))
    models = K.gpu_alias_match(kernels.select("device").distinct())
    return K.arch_profile_join(kernels.join(F.broadcast(models), "device", "left"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return K.kernel_run_summary(_kernels(spark, d))


def profiled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run summaries with the device's profile and the roofline over the run's means."""
    return with_roofline(_summary(spark, d))


def with_roofline(summary: DataFrame) -> DataFrame:
    runs = _devices(summary)
    models = K.gpu_alias_match(runs.select("device").distinct())
    profiled = K.arch_profile_join(runs.join(F.broadcast(models), "device", "left"))
    return K.roofline(profiled, "avg_dram_throughput_pct", "avg_tensor_core_utilization_pct", "avg_issue_slot_utilization_pct")


def _sides(df: DataFrame) -> DataFrame:
    """Runs 2n and 2n + 1 are the two sides of pair n."""
    return df.withColumns({"pair_id": F.floor(F.col("run_id") / 2).cast("long"), "side": F.when(F.col("run_id") % 2 == 0, "before").otherwise("after")})


def q_canonical_metric(spark, d):
    return tall(spark, d).groupBy(K.canonical_metric(F.col("metric_name")).alias("metric")).agg(F.count("*").alias("n"))


def q_kernel_pivot(spark, d):
    df = K.kernel_pivot(tall(spark, d))
    return _rounded(df.withColumns({f"stall_{s}": F.col("stalls")[s] for s in ("long_scoreboard", "barrier", "short_scoreboard")}).drop("stalls"))


def q_wide_launch_average(spark, d):
    return _rounded(K.wide_launch_average(tall(spark, d)), 8)


def q_estimate_occupancy(spark, d):
    return _rounded(K.estimate_occupancy(K.kernel_pivot(tall(spark, d))).select("run_id", "kernel_name", "active_blocks", "estimated_occupancy_pct", F.array_join("limiters", ",").alias("limiters")))


def q_occupancy_gap(spark, d):
    return _rounded(_kernels(spark, d).select("run_id", "kernel_name", "occupancy_gap_pct", "occupancy_efficiency_pct", "primary_limiter"))


def q_kernel_launch_rollup(spark, d):
    return _rounded(K.kernel_launch_rollup(_kernels(spark, d)))


def q_gpu_alias_match(spark, d):
    runs = _devices(table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("run_id")).distinct())
    return runs.join(F.broadcast(K.gpu_alias_match(runs)), "device", "left").select("run_id", "device", "gpu_model", "arch")


def q_arch_profile_join(spark, d):
    overrides = spark.createDataFrame([("sm_75", 9.0, None, None), ("t4", 7.0, 60.0, None), ("h100", None, 900.0, 3000.0), ("", None, None, 1500.0)], "key string, peak_fp32 double, peak_fp16 double, peak_bw double")
    return _rounded(K.arch_profile_join(q_gpu_alias_match(spark, d), overrides).select("run_id", "arch", "peak_fp32", "peak_fp16", "peak_bw", "bf16", "fp8"))


def q_roofline(spark, d):
    return _rounded(K.roofline(_profiled(spark, d)).select("run_id", "kernel_name", "achieved_tflops", "arithmetic_intensity", "roofline_region", "roofline_ceiling_tflops", "mfu_pct"))


def q_tensor_efficiency(spark, d):
    return K.tensor_efficiency(_profiled(spark, d)).select("run_id", "kernel_name", "tc_active", "tc_eligible", "fallback", "mixed_precision_opportunity", "tc_label")


def q_tensor_rollup(spark, d):
    return _rounded(K.tensor_rollup(K.tensor_efficiency(_profiled(spark, d))))


def q_occupancy_rollup(spark, d):
    return _rounded(K.occupancy_rollup(_kernels(spark, d)))


def q_kernel_run_summary(spark, d):
    return _rounded(_summary(spark, d).drop("stall_means").withColumn("limit_causes", F.array_join("limit_causes", ",")))


def q_classify_kernels_run(spark, d):
    return K.classify_kernels_run(_summary(spark, d))


def q_runtime_share(spark, d):
    return _rounded(K.runtime_share(K.kernel_pivot(tall(spark, d))).select("run_id", "kernel_name", "runtime_share_pct"))


def q_kernel_opportunity(spark, d):
    return _rounded(K.kernel_opportunity(K.roofline(K.runtime_share(_profiled(spark, d)))).select("run_id", "kernel_name", "opportunity_score", "opportunity", "place"))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_values = ", ".join(f"({i}, '{m}')" for i, (_, m) in enumerate(SLOTS))
_one = lambda m, v="v": f"max(CASE WHEN metric = '{m}' THEN {v} END) AS {m.removeprefix('warp_')}"
_PIVOT = f"""WITH slot(slot, metric) AS (VALUES {_values}),
    tall AS (SELECT l_suppkey % 20 AS run_id, p_type || p_brand AS kernel_name, metric, CASE WHEN slot = 13 THEN l_extendedprice / 100 ELSE l_quantity * 2 END AS value,
      row_number() OVER (PARTITION BY l_suppkey % 20, p_type, p_brand ORDER BY l_orderkey, {LINE_ORDER}) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN slot ON slot = (l_linenumber * 3 + l_partkey % 3) % 21),
    m AS (SELECT run_id, kernel_name, metric, max_by(value, seq) AS v, CAST(sum(floor(value)) AS BIGINT) AS total, avg(value) AS mean, count(*) AS n FROM tall GROUP BY ALL),
    k0 AS (SELECT run_id, kernel_name, {", ".join(_one(x) for x in (*K.COUNTERS, *K.OTHERS))}, CAST({_one("registers_per_thread").split(" AS ")[0]} AS BIGINT) AS registers_per_thread, {_one("shared_memory_per_block_bytes", "total")},
      CAST({_one("threads_per_block").split(" AS ")[0]} AS BIGINT) AS threads_per_block, {", ".join(_one(f"warp_stall_{s}") for s in ("long_scoreboard", "barrier", "short_scoreboard"))} FROM m GROUP BY ALL),
    k1 AS (SELECT *, greatest(stall_long_scoreboard, stall_barrier, stall_short_scoreboard) AS dominant_warp_stall_pct, num_stalls > 0 AS has FROM (SELECT *,
      (stall_long_scoreboard IS NOT NULL)::INT + (stall_barrier IS NOT NULL)::INT + (stall_short_scoreboard IS NOT NULL)::INT AS num_stalls FROM k0)),
    k2 AS (SELECT *, CASE WHEN stall_barrier = dominant_warp_stall_pct THEN 'barrier' WHEN stall_long_scoreboard = dominant_warp_stall_pct THEN 'long_scoreboard' WHEN
      stall_short_scoreboard = dominant_warp_stall_pct THEN 'short_scoreboard' END AS dominant_warp_stall,
      CASE WHEN threads_per_block > 0 THEN 32 END AS b_blocks, CASE WHEN threads_per_block > 0 AND registers_per_thread > 0 THEN 65536 // (registers_per_thread * threads_per_block) END AS b_registers,
      CASE WHEN threads_per_block > 0 AND shared_memory_per_block_bytes > 0 THEN 102400 // shared_memory_per_block_bytes END AS b_shared, CASE WHEN threads_per_block > 0 THEN 2048 // threads_per_block END AS b_threads FROM k1),
    k3 AS (SELECT *, least(b_blocks, b_registers, b_shared, b_threads) AS active_blocks FROM k2),
    k4 AS (SELECT *, {_r("least(active_blocks * threads_per_block / 2048.0::DOUBLE, 1.0) * 100.0", 2)} AS estimated_occupancy_pct, CASE WHEN threads_per_block > 0 THEN
      concat_ws(',', CASE WHEN b_blocks = active_blocks THEN 'blocks' END, CASE WHEN b_registers = active_blocks THEN 'registers' END, CASE WHEN b_shared = active_blocks
      THEN 'shared_memory' END, CASE WHEN b_threads = active_blocks THEN 'threads' END) ELSE 'unknown_threads_per_block' END AS limiters FROM k3),
    ks AS (SELECT *, {_r("estimated_occupancy_pct - achieved_occupancy_pct", 2)} AS gap, CASE WHEN estimated_occupancy_pct > 0 THEN
      {_r("achieved_occupancy_pct / estimated_occupancy_pct * 100.0", 1)} END AS eff, split_part(limiters, ',', 1) AS first_limiter FROM k4)"""
_means = [c for c in K.COUNTERS if c != "achieved_occupancy_pct"] + list(K.OTHERS[:4]) + list(K.LAUNCH)
_frac = lambda c: f"coalesce({_r(f'sum(CASE WHEN has THEN coalesce({c}, 0) END) / (100.0 * nullif(count(CASE WHEN has THEN 1 END), 0))')}, 0.0)"
_SUMMARY = f"""{_PIVOT},
    base AS (SELECT run_id, count(*) AS kernel_count, count(coalesce({", ".join(K.COUNTERS)}, CASE WHEN has THEN 0 END)) AS kernels_with_data,
      {_r("sum(kernel_duration_us)")} AS total_kernel_duration_us, count(kernel_duration_us) AS kernels_with_duration,
      {", ".join(f"{_r(f'avg({c})', 2)} AS avg_{c}" for c in _means)}, {_r("avg(coalesce(achieved_occupancy_pct, estimated_occupancy_pct))", 2)} AS avg_occupancy_pct, count(CASE WHEN has THEN 1 END) AS kernels_with_stalls,
      {_frac("stall_long_scoreboard")} AS memory_stall_fraction, {_frac("stall_short_scoreboard")} AS compute_stall_fraction, (SELECT string_agg(DISTINCT f, ',' ORDER BY
      f) FROM (SELECT run_id AS r, unnest(string_split(limiters, ',')) AS f FROM ks) WHERE r = ks.run_id) AS limit_causes FROM ks GROUP BY run_id),
    sm AS (SELECT run_id AS rid, s AS stall, {_r("sum(v) / max(ns)", 2)} AS mean FROM (SELECT run_id, count(CASE WHEN has THEN 1 END) OVER (PARTITION BY run_id) AS ns,
      unnest(['long_scoreboard', 'barrier', 'short_scoreboard']) AS s, unnest([stall_long_scoreboard, stall_barrier, stall_short_scoreboard]) AS v FROM ks) WHERE v IS NOT NULL
      GROUP BY run_id, s),
    tops AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY mean DESC, stall) AS n, coalesce(sum(CASE WHEN stall IN ('barrier', 'wait') THEN mean END) OVER (PARTITION BY rid), 0.0) AS sync FROM sm),
    rs AS (SELECT base.*, coalesce(stall, 'unknown') AS dominant_warp_stall, coalesce(mean, 0.0) AS dominant_warp_stall_pct, coalesce(sync, 0.0) AS sync_stall_pct FROM base LEFT JOIN tops ON rid = run_id AND n = 1)"""
_unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
_ev = "avg_eligible_warps_per_scheduler"
_act = "avg_scheduler_active_pct"
_RULES = [
    ("insufficient_ncu_data", "NOT data", "1.0"),
    ("memory_bandwidth_bound", "data AND avg_dram_throughput_pct > 70 AND memory_stall_fraction > 0.5", _unit("avg_dram_throughput_pct / 100.0")),
    ("warp_stall_memory", "data AND dominant_warp_stall = 'long_scoreboard' AND dominant_warp_stall_pct > 20", _unit("dominant_warp_stall_pct / 100.0")),
    ("warp_stall_sync", "data AND dominant_warp_stall = 'barrier' AND dominant_warp_stall_pct > 20", _unit("greatest(sync_stall_pct, dominant_warp_stall_pct) / 100.0")),
    ("l1_cache_thrashing", "avg_l1_cache_hit_rate_pct < 40", _unit("1.0 - avg_l1_cache_hit_rate_pct / 100.0")),
    ("l2_cache_thrashing", "avg_l2_cache_hit_rate_pct < 50", _unit("1.0 - avg_l2_cache_hit_rate_pct / 100.0")),
    ("uncoalesced_access", "avg_global_load_sectors_per_request > 4", _unit("(avg_global_load_sectors_per_request - 1.0) / 10.0")),
    ("tensor_core_underutilized", "avg_tensor_core_utilization_pct < 30 AND coalesce(avg_occupancy_pct > 40, true)", _unit("1.0 - avg_tensor_core_utilization_pct / 100.0")),
    ("occupancy_limited", "data AND avg_occupancy_pct < 40", _unit("1.0 - avg_occupancy_pct / 40.0")),
    ("occupancy_limited_by_registers", "data AND avg_occupancy_pct < 40 AND contains(limit_causes, 'registers')", "greatest(0.0, 0.9 - avg_occupancy_pct / 80.0)"),
    ("occupancy_limited_by_shared_memory", "data AND avg_occupancy_pct < 40 AND contains(limit_causes, 'shared_memory')", "greatest(0.0, 0.9 - avg_occupancy_pct / 80.0)"),
    ("occupancy_limited_by_block_size", "data AND avg_occupancy_pct < 40 AND (contains(limit_causes, 'threads') OR contains(limit_causes, 'blocks'))", "greatest(0.0, 0.9 - avg_occupancy_pct / 80.0)"),
    ("low_warp_scheduler_utilization", f"coalesce({_ev} < 1, false) OR coalesce({_act} < 40, false)", f"greatest(coalesce(CASE WHEN {_ev} = 0 THEN 0.0 ELSE 1.0 - {_ev} END, 0.0), coalesce(CASE WHEN {_act} = 0 THEN 0.0 ELSE 1.0 - {_act} / 40.0 END, 0.0))"),
    ("low_issue_efficiency", "avg_issue_slot_utilization_pct < 60", _unit("1.0 - avg_issue_slot_utilization_pct / 100.0")),
]
_CLASSES = f"""{_SUMMARY}, lab AS ({" UNION ALL ".join(f"SELECT run_id, '{n}' AS label, {_r(s)} AS score, {i}::BIGINT AS rule_no FROM (SELECT *, kernels_with_data > 0 AS data FROM rs) WHERE {c}" for i, (n, c, s) in enumerate(_RULES))})"""
_DIFF = f"""{_CLASSES}, bd AS (SELECT coalesce(a.p, b.p) AS pair_id, coalesce(a.label, b.label) AS label, a.score AS score_before, b.score AS score_after, CASE WHEN
      b.score IS NULL THEN 'resolved' WHEN a.score IS NULL THEN 'new' WHEN a.score - b.score > 0.02 THEN 'improved' ELSE 'persistent' END AS status
    FROM (SELECT *, run_id // 2 AS p FROM lab WHERE run_id % 2 = 0) a FULL JOIN (SELECT *, run_id // 2 AS p FROM lab WHERE run_id % 2 = 1) b ON a.p = b.p AND a.label = b.label)"""
_delta = " UNION ALL ".join(
    f"SELECT a.run_id // 2 AS pair_id, '{m}' AS metric, a.{m} AS before, b.{m} AS after, {_r(f'b.{m} - a.{m}')} AS delta, {'true' if up else 'false'} AS up FROM rs a JOIN rs b ON a.run_id // 2 = b.run_id // 2 WHERE a.run_id % 2 = 0 AND b.run_id % 2 = 1 AND a.{m} IS NOT NULL AND b.{m} IS NOT NULL"
    for m, up in D.DIRECTIONS.items()
)
_ARCH = f"""ar(arch, fp32, fp16, bw, tc, bf16, fp8) AS (VALUES {", ".join(f"('{a[0]}', {a[1]}::DOUBLE, {a[2]}::DOUBLE, {a[3]}::DOUBLE, {str(a[4]).lower()}, {str(a[5]).lower()}, {str(a[6]).lower()})" for a in K.ARCH)}),
    dv(n, device, gpu_model, arch) AS (VALUES (0, '{DEVICES[0]}', 'a100', 'sm_80'), (1, '{DEVICES[1]}', 'h100', 'sm_90'), (2, '{DEVICES[2]}', 't4', 'sm_75'), (3, '{DEVICES[3]}', 'rtx4090', 'sm_89'), (4, '{DEVICES[4]}', NULL, NULL))"""
_ROOF = f"""{_PIVOT}, {_ARCH}, pr AS (SELECT ks.*, ar.* FROM ks JOIN dv ON n = run_id % 5 JOIN ar ON ar.arch = coalesce(dv.arch, 'sm_80')),
    r0 AS (SELECT *, coalesce(dram_throughput_pct, 0.0) AS d, coalesce(tensor_core_utilization_pct, 0.0) AS t, coalesce(issue_slot_utilization_pct, 0.0) AS i FROM pr),
    r1 AS (SELECT *, d <> 0 OR t <> 0 OR i <> 0 AS known, CASE WHEN t > 5 THEN fp16 ELSE fp32 END AS peak, CASE WHEN t > 5 THEN t * fp16 ELSE i * fp32 END / 100.0 AS tf, d / 100.0 * bw AS abw FROM r0),
    r2 AS (SELECT *, CASE WHEN known AND abw > 0 THEN {_r("tf / abw * 1000.0")} END AS ai FROM r1),
    rf AS (SELECT *, CASE WHEN known THEN {_r("tf")} END AS achieved_tflops, ai AS arithmetic_intensity, CASE WHEN known THEN CASE WHEN ai < peak / bw * 1000.0 THEN 'memory_bound' ELSE 'compute_bound' END END AS roofline_region,
      CASE WHEN known THEN CASE WHEN ai IS NULL THEN peak ELSE {_r("least(peak, bw * ai / 1000.0)")} END END AS roofline_ceiling_tflops, CASE WHEN known THEN {_r("tf / fp32 * 100.0", 2)} END AS mfu_pct,
      {_r("kernel_duration_us / sum(kernel_duration_us) OVER (PARTITION BY run_id) * 100.0", 2)} AS rs_pct, count(kernel_duration_us) OVER (PARTITION BY run_id) > 0 AS timed FROM r2),
    tcs AS (SELECT *, coalesce(t > 5, false) AS tc_active, tc AND (i > 20 OR t > 1) AS tc_eligible, tc AND (i > 20 OR t > 1) AND NOT t > 5 AND i > 20 AS fallback, tc AND
      (i > 20 OR t > 1) AND NOT t > 10 AND (bf16 OR fp8) AS mixed_precision_opportunity,
      CASE WHEN tensor_core_utilization_pct IS NULL THEN 'no_data' WHEN t > 50 THEN 'efficient' WHEN t > 5 THEN 'underutilized' WHEN tc AND (i > 20 OR t > 1) THEN 'inactive' ELSE 'no_data' END AS tc_label FROM rf)"""
_stalls = "stall_long_scoreboard, stall_barrier, stall_short_scoreboard"
ORACLES = {
    "canonical_metric": f"{_PIVOT} SELECT metric, count(*) AS n FROM tall GROUP BY metric",
    "kernel_pivot": f"{_PIVOT} SELECT run_id, kernel_name, {', '.join(_r(c) + f' AS {c}' for c in (*K.COUNTERS, *K.OTHERS, *_stalls.split(', '), 'dominant_warp_stall_pct'))}, registers_per_thread, shared_memory_per_block_bytes, threads_per_block, dominant_warp_stall FROM ks",
    "wide_launch_average": f"{_PIVOT} SELECT run_id, kernel_name, metric, {_r('mean', 8)} AS value, n AS launches FROM m",
    "estimate_occupancy": f"{_PIVOT} SELECT run_id, kernel_name, CAST(active_blocks AS BIGINT) AS active_blocks, estimated_occupancy_pct, limiters FROM ks",
    "occupancy_gap": f"{_PIVOT} SELECT run_id, kernel_name, gap AS occupancy_gap_pct, eff AS occupancy_efficiency_pct, first_limiter AS primary_limiter FROM ks",
    "kernel_launch_rollup": f"{_PIVOT} SELECT run_id, count(*) AS kernels, count(threads_per_block) AS kernels_with_launch, {_r('avg(estimated_occupancy_pct)', 2)} AS avg_estimated_occupancy_pct FROM ks GROUP BY run_id",
    "gpu_alias_match": f"WITH {_ARCH} SELECT run_id, device, gpu_model, arch FROM (SELECT DISTINCT l_suppkey % 20 AS run_id FROM lineitem) JOIN dv ON n = run_id % 5",
    "arch_profile_join": f"WITH {_ARCH} SELECT run_id, ar.arch, CASE WHEN ar.arch = 'sm_75' THEN 9.0 ELSE fp32 END AS peak_fp32, CASE gpu_model WHEN 't4' THEN 60.0 WHEN 'h100' THEN 900.0 ELSE fp16 END AS peak_fp16, 1500.0::DOUBLE AS peak_bw, bf16, fp8 FROM (SELECT DISTINCT l_suppkey % 20 AS run_id FROM lineitem) JOIN dv ON n = run_id % 5 JOIN ar ON ar.arch = coalesce(dv.arch, 'sm_80')",
    "roofline": f"{_ROOF} SELECT run_id, kernel_name, achieved_tflops, arithmetic_intensity, roofline_region, roofline_ceiling_tflops, mfu_pct FROM rf",
    "tensor_efficiency": f"{_ROOF} SELECT run_id, kernel_name, tc_active, tc_eligible, fallback, mixed_precision_opportunity, tc_label FROM tcs",
    "tensor_rollup": f"""{_ROOF}, a AS (SELECT run_id, count(tensor_core_utilization_pct) AS kernels_with_tc, count(CASE WHEN tc_active THEN 1 END) AS kernels_tc_active,
      count(CASE WHEN tc_eligible AND NOT tc_active THEN 1 END) AS eligible_inactive, count(CASE WHEN fallback THEN 1 END) AS fallbacks,
      {_r('avg(tensor_core_utilization_pct)', 2)} AS avg_tc_pct, bool_or(mixed_precision_opportunity) AS any_opportunity FROM tcs GROUP BY run_id)
      SELECT *, CASE WHEN kernels_with_tc = 0 THEN 'no_data' WHEN fallbacks > 0 OR eligible_inactive > 0 THEN 'inactive' WHEN avg_tc_pct > 50 THEN 'efficient' WHEN
      kernels_tc_active > 0 THEN 'underutilized' ELSE 'no_data' END AS overall_label FROM a""",
    "occupancy_rollup": f"""{_PIVOT}, lim AS (SELECT run_id, f, count(*) AS n FROM (SELECT run_id, unnest(string_split(limiters, ',')) AS f FROM ks) GROUP BY ALL), one AS
      (SELECT run_id AS rid, f FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, f) AS k FROM lim) WHERE k = 1)
      SELECT run_id, count(achieved_occupancy_pct) AS kernels_with_occupancy, count(CASE WHEN achieved_occupancy_pct < 40 THEN 1 END) AS kernels_low_occupancy,
      {_r('avg(achieved_occupancy_pct)', 2)} AS avg_achieved_occupancy_pct, {_r('avg(gap)', 2)} AS avg_occupancy_gap_pct, {_r('avg(eff)', 2)} AS avg_occupancy_efficiency_pct,
      any_value(f) AS dominant_limiter FROM ks JOIN one ON rid = run_id GROUP BY run_id""",
    "kernel_run_summary": f"{_SUMMARY} SELECT * FROM rs",
    "classify_kernels_run": f"{_CLASSES} SELECT * FROM lab",
    "runtime_share": f"{_PIVOT} SELECT run_id, kernel_name, {_r('kernel_duration_us / sum(kernel_duration_us) OVER (PARTITION BY run_id) * 100.0', 2)} AS runtime_share_pct FROM ks",
    "kernel_opportunity": f"""{_ROOF}, op AS (SELECT *, {_r("coalesce(rs_pct / 100.0, 1.0) * CASE WHEN roofline_region = 'memory_bound' THEN 1.0 WHEN mfu_pct < 20 THEN 0.85 WHEN achieved_occupancy_pct > 0 AND achieved_occupancy_pct < 30 THEN 0.7 WHEN d > 60 THEN 0.65 ELSE 0.4 END * greatest(0.0, coalesce(1.0 - least(mfu_pct, 100.0) / 100.0, 1.0 - greatest(d, i) / 100.0 * 0.7))")}
      AS s FROM rf)
      SELECT run_id, kernel_name, s AS opportunity_score, CASE WHEN s > CASE WHEN timed THEN 0.25 ELSE 0.55 END THEN 'high' WHEN s > CASE WHEN timed THEN 0.08 ELSE 0.25
      END THEN 'medium' ELSE 'low' END AS opportunity, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, kernel_name) AS place FROM op) WHERE place
      <= 5""",
}
