"""Kernel profiler metrics: tall rows to kernels, kernels to runs, occupancy, roofline, opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugefleet.functions import environment, flags, half_up, numbers

# Profiler metric names (normalised) and the names used here.
ALIASES = {
    "launch__registers_per_thread": "registers_per_thread",
    "registers_per_thread": "registers_per_thread",
    "launch__shared_mem_per_block_static": "shared_memory_per_block_bytes",
    "launch__shared_mem_per_block_dynamic": "shared_memory_per_block_bytes",
    "shared_memory_per_block": "shared_memory_per_block_bytes",
    "launch__block_size": "threads_per_block",
    "threads_per_block": "threads_per_block",
    "launch__block_dim_x": "block_x",
    "launch__block_dim_y": "block_y",
    "launch__block_dim_z": "block_z",
    "launch__grid_dim_x": "grid_x",
    "launch__grid_dim_y": "grid_y",
    "launch__grid_dim_z": "grid_z",
    "sm__warps_active_avg_pct_of_peak_sustained_active": "achieved_occupancy_pct",
    "sm__warps_active_avg_pct_of_peak_sustained_elapsed": "achieved_occupancy_pct",
    "achieved_occupancy": "achieved_occupancy_pct",
    "theoretical_occupancy": "theoretical_occupancy_pct",
    "smsp__warps_eligible_avg_per_cycle_active": "eligible_warps_per_scheduler",
    "smsp__warps_active_avg_pct_of_peak_sustained_active": "scheduler_active_pct",
    "smsp__warps_active_avg_pct_of_peak_sustained_elapsed": "scheduler_active_pct",
    "dram__throughput_avg_pct_of_peak_sustained_elapsed": "dram_throughput_pct",
    "memory_throughput": "dram_throughput_pct",
    "compute_(sm)_throughput": "sm_throughput_pct",
    "sm_throughput": "sm_throughput_pct",
    "l1tex_throughput": "l1tex_throughput_pct",
    "l1/tex_throughput": "l1tex_throughput_pct",
    "mem_busy": "memory_busy_pct",
    "sm__pipe_tensor_cycles_active_avg_pct_of_peak_sustained_active": "tensor_core_utilization_pct",
    "sm__pipe_tensor_cycles_active_avg_pct_of_peak_sustained_elapsed": "tensor_core_utilization_pct",
    "tensor_core_utilization": "tensor_core_utilization_pct",
    "l1tex__t_sector_hit_rate_pct": "l1_cache_hit_rate_pct",
    "l1/tex_cache_throughput": "l1_cache_hit_rate_pct",
    "lts__t_sector_hit_rate_pct": "l2_cache_hit_rate_pct",
    "l2_cache_hit_rate": "l2_cache_hit_rate_pct",
    "l1tex__average_t_sectors_per_request_pipe_lsu_mem_global_op_ld": "global_load_sectors_per_request",
    "l1tex__average_t_sectors_per_request_pipe_lsu_mem_global_op_ld_ratio": "global_load_sectors_per_request",
    "gld_transactions_per_request": "global_load_sectors_per_request",
    "sm__issue_active_avg_pct_of_peak_sustained_active": "issue_slot_utilization_pct",
    "sm__issue_active_avg_pct_of_peak_sustained_elapsed": "issue_slot_utilization_pct",
    "smsp__issue_active_avg_pct_of_peak_sustained_active": "issue_slot_utilization_pct",
    "smsp__issue_active_avg_pct_of_peak_sustained_elapsed": "issue_slot_utilization_pct",
    "issue_slots_busy": "issue_slot_utilization_pct",
    "gpu__time_duration_sum": "kernel_duration_us",
    "gpu__time_duration_avg": "kernel_duration_us",
    "duration": "kernel_duration_us",
}
COUNTERS = ("dram_throughput_pct", "tensor_core_utilization_pct", "l1_cache_hit_rate_pct", "l2_cache_hit_rate_pct", "global_load_sectors_per_request", "issue_slot_utilization_pct", "achieved_occupancy_pct", "eligible_warps_per_scheduler", "scheduler_active_pct")
OTHERS = ("theoretical_occupancy_pct", "sm_throughput_pct", "l1tex_throughput_pct", "memory_busy_pct", "kernel_duration_us")
LAUNCH = ("registers_per_thread", "shared_memory_per_block_bytes", "threads_per_block")
MEMORY_STALLS = ("memory_throttle", "long_scoreboard", "mio", "lg", "texture")
COMPUTE_STALLS = ("short_scoreboard", "dispatch", "not_selected")
SYNC_STALLS = ("barrier", "wait")
# Peaks and limits by architecture: name, FP32 and FP16 TFLOP/s, GB/s, tensor cores, BF16, FP8.
ARCH = [
    ("sm_75", 8.1, 65.0, 320.0, True, False, False),
    ("sm_80", 19.5, 312.0, 2000.0, True, True, False),
    ("sm_86", 35.6, 142.6, 936.0, True, True, False),
    ("sm_89", 82.6, 165.2, 1008.0, True, True, True),
    ("sm_90", 67.0, 989.0, 3350.0, True, True, True),
    ("sm_100", 60.0, 1800.0, 8000.0, True, True, True),
    ("sm_120", 104.8, 209.6, 1792.0, True, True, True),
]
DEFAULT_ARCH = "sm_80"
# Product keys and their architecture.
PRODUCTS = {
    "t4": "sm_75", "rtx2080": "sm_75", "rtx2080ti": "sm_75", "rtx2070": "sm_75", "rtx2060": "sm_75", "a100": "sm_80", "a30": "sm_80",
    "a10": "sm_86", "a16": "sm_86", "rtx3090": "sm_86", "rtx3090ti": "sm_86", "rtx3080": "sm_86", "rtx3070": "sm_86", "rtx3060": "sm_86",
    "l4": "sm_89", "l40": "sm_89", "l40s": "sm_89", "rtx4090": "sm_89", "rtx4080": "sm_89", "rtx4070": "sm_89", "rtx4060": "sm_89",
    "h100": "sm_90", "h200": "sm_90", "b100": "sm_100", "b200": "sm_100", "rtx5090": "sm_120", "rtx5080": "sm_120", "rtx5070ti": "sm_120", "rtx5070": "sm_120", "rtx5060ti": "sm_120", "rtx5060": "sm_120",
}
LIMITS = {"max_threads": 2048, "max_blocks": 32, "registers": 65536, "shared": 102400}


def canonical_metric(name: Column) -> Column:
    """The name used here of a raw metric name; stall reasons become ``warp_stall_<reason>``."""
    plain = F.translate(F.lower(F.trim(name)), " -.", "___")
    stall = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in (r"^smsp__pcsamplingdata_pct_of_utilization_issue_stalled_(.+)$", r"^smsp__warp_issue_stalled_(.+)_per_warp_active_pct$")])
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(known[plain], F.concat(F.lit("warp_stall_"), stall), plain)


def kernel_pivot(tall: DataFrame) -> DataFrame:
    """Tall metrics to one row per (run_id, kernel_name): last value by seq; shared memory adds up.

    Rows are summed up by raw name first, so that names are looked up once for each kernel and not for each row.
    """
    raw = tall.groupBy("run_id", "kernel_name", "metric_name").agg(F.max_by("value", "seq").alias("v"), F.max("seq").alias("last"), F.sum(F.floor("value")).alias("total"))
    m = raw.groupBy("run_id", "kernel_name", canonical_metric(F.col("metric_name")).alias("metric")).agg(F.max_by("v", "last").alias("v"), F.sum("total").alias("total"))
    one = lambda c: F.max(F.when(F.col("metric") == c, F.col("v"))).alias(c)
    whole = lambda c, v: F.max(F.when(F.col("metric") == c, F.col(v).cast("long"))).alias(c)
    stall = F.col("metric").startswith("warp_stall_")
    entries = F.collect_list(F.when(stall, F.struct(F.substring("metric", 12, 1000).alias("k"), F.col("v").alias("v"))))
    out = m.groupBy("run_id", "kernel_name").agg(*map(one, (*COUNTERS, *OTHERS)), whole(LAUNCH[0], "v"), whole(LAUNCH[1], "total"), whole(LAUNCH[2], "v"), F.map_from_entries(F.array_sort(entries)).alias("stalls"))
    top = F.array_max(F.transform(F.map_entries("stalls"), lambda e: F.struct(e["value"].alias("v"))))["v"]
    first = F.array_min(F.transform(F.filter(F.map_entries("stalls"), lambda e: e["value"] == top), lambda e: e["key"]))
    return out.withColumns({"dominant_warp_stall": first, "dominant_warp_stall_pct": top})


def wide_launch_average(tall: DataFrame) -> DataFrame:
    """Several launches of a kernel to the mean of each metric."""
    return tall.groupBy("run_id", "kernel_name", canonical_metric(F.col("metric_name")).alias("metric")).agg(F.avg("value").alias("value"), F.count("*").alias("launches"))


def estimate_occupancy(kernels: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Adds estimated_occupancy_pct, active_blocks and limiters (resources tied at the lowest block count, by name)."""
    threads, registers, shared = (F.when(F.col(c) > 0, F.col(c)) for c in (LAUNCH[2], LAUNCH[0], LAUNCH[1]))
    blocks = {
        "blocks": F.when(threads.isNotNull(), F.lit(limits["max_blocks"])),
        "registers": F.floor(limits["registers"] / (registers * threads)),
        "shared_memory": F.when(threads.isNotNull(), F.floor(limits["shared"] / shared)),
        "threads": F.floor(limits["max_threads"] / threads),
    }
    df = kernels.withColumn("active_blocks", F.least(*blocks.values()).cast("long"))
    tied = F.filter(F.array(*[F.when(v == F.col("active_blocks"), F.lit(k)) for k, v in blocks.items()]), lambda x: x.isNotNull())
    pct = half_up(F.least(F.col("active_blocks") * threads / limits["max_threads"], F.lit(1.0)) * 100.0, 2)
    return df.withColumns({"estimated_occupancy_pct": pct, "limiters": F.when(threads.isNull(), F.array(F.lit("unknown_threads_per_block"))).otherwise(tied)})


def occupancy_gap(kernels: DataFrame) -> DataFrame:
    """Adds occupancy_gap_pct, occupancy_efficiency_pct and primary_limiter to estimated kernels."""
    estimated, achieved = F.col("estimated_occupancy_pct"), F.col("achieved_occupancy_pct")
    return kernels.withColumns({
        "occupancy_gap_pct": half_up(estimated - achieved, 2),
        "occupancy_efficiency_pct": F.when(estimated > 0, half_up(achieved / estimated * 100.0, 1)),
        "primary_limiter": F.get("limiters", F.lit(0)),
    })


def gpu_alias_match(devices: DataFrame) -> DataFrame:
    """(device, gpu_model, arch): the longest product key within the normalised device name."""
    spark = devices.sparkSession
    keys = F.broadcast(spark.createDataFrame(list(PRODUCTS.items()), "gpu_model string, arch string"))
    names = devices.select("device").distinct().withColumn("plain", F.regexp_replace(F.lower("device"), "nvidia | |-", ""))
    found = names.join(keys, F.expr("contains(plain, gpu_model)"), "left").groupBy("device").agg(F.max_by(F.struct("gpu_model", "arch"), F.struct(F.length("gpu_model"), "gpu_model")).alias("m"))
    return found.select("device", "m.gpu_model", "m.arch")


def arch_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARCH, "arch string, peak_fp32 double, peak_fp16 double, peak_bw double, tensor_cores boolean, bf16 boolean, fp8 boolean")


PEAKS = ("peak_fp32", "peak_fp16", "peak_bw")


def arch_profile_join(runs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds each run's profile by arch (default where unknown); overrides (key, peak_*) take precedence.

    The key of an override is a product, an architecture, or empty for all runs: what is set for all wins
    over the architecture's, that over the product's, that over the profile.
    """
    profile = arch_profiles(runs.sparkSession)
    df = runs.withColumn("arch", F.coalesce("arch", F.lit(DEFAULT_ARCH))).join(F.broadcast(profile), "arch", "left")
    if overrides is None:
        return df
    model = F.col("gpu_model") if "gpu_model" in df.columns else F.lit(None).cast("string")
    for name, key in (("m", model), ("a", F.col("arch")), ("t", F.lit(""))):
        side = overrides.select(F.col("key").alias(f"__{name}"), *[F.col(c).alias(f"__{name}_{c}") for c in PEAKS])
        df = df.withColumn("__k", key).join(F.broadcast(side), F.col("__k") == F.col(f"__{name}"), "left").drop("__k", f"__{name}")
    levels = [f"__{n}_{c}" for n in ("t", "a", "m") for c in PEAKS]
    return df.withColumns({c: F.coalesce(*[F.col(f"__{n}_{c}") for n in ("t", "a", "m")], F.col(c)) for c in PEAKS}).drop(*levels)


def roofline(df: DataFrame, dram: str = "dram_throughput_pct", tensor: str = "tensor_core_utilization_pct", issue: str = "issue_slot_utilization_pct") -> DataFrame:
    """Adds achieved_tflops, arithmetic_intensity, roofline_region, roofline_ceiling_tflops and mfu_pct."""
    d, t, i = (F.coalesce(F.col(c), F.lit(0.0)) for c in (dram, tensor, issue))
    known = (F.coalesce("peak_fp32", F.lit(0.0)) > 0) & (F.coalesce("peak_bw", F.lit(0.0)) > 0) & ((d != 0) | (t != 0) | (i != 0))
    on_tensor = (t > 5.0) & (F.coalesce("peak_fp16", F.lit(0.0)) > 0)
    df = df.withColumns({"__peak": F.when(known, F.when(on_tensor, F.col("peak_fp16")).otherwise(F.col("peak_fp32"))), "__tf": F.when(known, F.when(on_tensor, t * F.col("peak_fp16")).otherwise(i * F.col("peak_fp32")) / 100.0), "__bw": d / 100.0 * F.col("peak_bw")})
    df = df.withColumn("arithmetic_intensity", F.when(known & (F.col("__bw") > 0), half_up(F.col("__tf") / F.col("__bw") * 1000.0, 4)))
    ai, peak = F.col("arithmetic_intensity"), F.col("__peak")
    return df.withColumns({
        "achieved_tflops": half_up(F.col("__tf"), 4),
        "roofline_region": F.when(known, F.when(ai < peak / F.col("peak_bw") * 1000.0, "memory_bound").otherwise("compute_bound")),
        "roofline_ceiling_tflops": F.when(ai.isNull(), peak).otherwise(half_up(F.least(peak, F.col("peak_bw") * ai / 1000.0), 4)),
        "mfu_pct": half_up(F.col("__tf") / F.col("peak_fp32") * 100.0, 2),
    }).drop("__peak", "__tf", "__bw")


def tensor_efficiency(df: DataFrame, mixed_precision: bool = False) -> DataFrame:
    """Adds tc_active, tc_eligible, fallback, mixed_precision_opportunity and tc_label per kernel."""
    tc, issue = F.col("tensor_core_utilization_pct"), F.coalesce("issue_slot_utilization_pct", F.lit(0.0))
    over = lambda cut: F.coalesce(tc > cut, F.lit(False))
    eligible = F.coalesce("tensor_cores", F.lit(False)) & ((issue > 20.0) | over(1.0))
    active = over(5.0)
    return df.withColumns({
        "tc_active": active, "tc_eligible": eligible, "fallback": eligible & ~active & (issue > 20.0),
        "mixed_precision_opportunity": eligible & ~over(10.0) & F.coalesce(F.col("bf16") | F.col("fp8"), F.lit(False)) & F.lit(not mixed_precision),
        "tc_label": F.when(tc.isNull(), "no_data").when(tc > 50.0, "efficient").when(active, "underutilized").when(eligible, "inactive").otherwise("no_data"),
    })


def kernel_run_summary(kernels: DataFrame) -> DataFrame:
    """One row per run: null-skipping means (two digits), counts, limiter and stall summaries."""
    occupancy = F.coalesce("achieved_occupancy_pct", "estimated_occupancy_pct")
    measured = F.coalesce(*[F.col(c) for c in COUNTERS], F.when(F.size("stalls") > 0, 0.0)).isNotNull()
    has = F.size("stalls") > 0
    within = lambda names: F.aggregate(F.map_values(F.map_filter("stalls", lambda k, v: k.isin(*names))), F.lit(0.0), lambda a, b: a + b)
    means = {f"avg_{c}": c for c in (*[c for c in COUNTERS if c != "achieved_occupancy_pct"], *OTHERS[:4], *LAUNCH)}
    base = kernels.groupBy("run_id").agg(
        F.count("*").alias("kernel_count"), F.count(F.when(measured, 1)).alias("kernels_with_data"), half_up(F.sum("kernel_duration_us"), 4).alias("total_kernel_duration_us"), F.count("kernel_duration_us").alias("kernels_with_duration"),
        *[half_up(F.avg(c), 2).alias(name) for name, c in means.items()], half_up(F.avg(occupancy), 2).alias("avg_occupancy_pct"), F.count(F.when(has, 1)).alias("kernels_with_stalls"),
        F.coalesce(half_up(F.sum(F.when(has, within(MEMORY_STALLS))) / (100.0 * F.nullif(F.count(F.when(has, 1)), F.lit(0))), 4), F.lit(0.0)).alias("memory_stall_fraction"),
        F.coalesce(half_up(F.sum(F.when(has, within(COMPUTE_STALLS))) / (100.0 * F.nullif(F.count(F.when(has, 1)), F.lit(0))), 4), F.lit(0.0)).alias("compute_stall_fraction"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("limiters")))).alias("limit_causes"),
    )
    sums = kernels.select("run_id", F.explode("stalls").alias("stall", "v")).groupBy("run_id", "stall").agg(F.sum("v").alias("s"))
    sums = sums.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stall", "s")))).alias("sums"))  # as many as there are stall reasons
    none = F.create_map().cast("map<string,double>")
    means = F.coalesce(F.transform_values("sums", lambda k, v: half_up(v / F.col("kernels_with_stalls"), 2)), none)
    out = base.join(sums, "run_id", "left").withColumn("stall_means", means).drop("sums")
    ranked = F.array_sort(F.transform(F.map_entries("stall_means"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    sync = F.aggregate(F.map_values(F.map_filter("stall_means", lambda k, v: k.isin(*SYNC_STALLS))), F.lit(0.0), lambda a, b: a + b)
    return out.withColumns({
        "dominant_warp_stall": F.coalesce(F.get(ranked, F.lit(0))["k"], F.lit("unknown")), "dominant_warp_stall_pct": F.coalesce(-F.get(ranked, F.lit(0))["v"], F.lit(0.0)), "sync_stall_pct": sync,
    })


def classify_kernels_run(s: DataFrame) -> DataFrame:
    """(run_id, label, score, rule_no) of kernel-level bottlenecks; labels with a missing metric never fire."""
    c = F.col
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    occ, top, top_pct, data = c("avg_occupancy_pct"), c("dominant_warp_stall"), c("dominant_warp_stall_pct"), c("kernels_with_data") > 0
    by = lambda *causes: (occ < 40.0) & F.arrays_overlap("limit_causes", F.array(*map(F.lit, causes)))
    lack = lambda x, cut: F.coalesce(1.0 - F.when(x == 0, F.lit(cut)).otherwise(x) / cut, F.lit(0.0))
    eligible, active = c("avg_eligible_warps_per_scheduler"), c("avg_scheduler_active_pct")
    rules = [
        ("insufficient_ncu_data", ~data, F.lit(1.0)),
        ("memory_bandwidth_bound", data & (c("avg_dram_throughput_pct") > 70.0) & (c("memory_stall_fraction") > 0.5), unit(c("avg_dram_throughput_pct") / 100.0)),
        ("warp_stall_memory", data & top.isin(*MEMORY_STALLS) & (top_pct > 20.0), unit(top_pct / 100.0)),
        ("warp_stall_sync", data & top.isin(*SYNC_STALLS) & (top_pct > 20.0), unit(F.greatest(c("sync_stall_pct"), top_pct) / 100.0)),
        ("l1_cache_thrashing", c("avg_l1_cache_hit_rate_pct") < 40.0, unit(1.0 - c("avg_l1_cache_hit_rate_pct") / 100.0)),
        ("l2_cache_thrashing", c("avg_l2_cache_hit_rate_pct") < 50.0, unit(1.0 - c("avg_l2_cache_hit_rate_pct") / 100.0)),
        ("uncoalesced_access", c("avg_global_load_sectors_per_request") > 4.0, unit((c("avg_global_load_sectors_per_request") - 1.0) / 10.0)),
        ("tensor_core_underutilized", (c("avg_tensor_core_utilization_pct") < 30.0) & F.coalesce(occ > 40.0, F.lit(True)), unit(1.0 - c("avg_tensor_core_utilization_pct") / 100.0)),
        ("occupancy_limited", data & (occ < 40.0), unit(1.0 - occ / 40.0)),
        ("occupancy_limited_by_registers", data & by("registers"), F.greatest(F.lit(0.0), 0.9 - occ / 80.0)),
        ("occupancy_limited_by_shared_memory", data & by("shared_memory"), F.greatest(F.lit(0.0), 0.9 - occ / 80.0)),
        ("occupancy_limited_by_block_size", data & by("threads", "blocks", "unknown_threads_per_block"), F.greatest(F.lit(0.0), 0.9 - occ / 80.0)),
        ("low_warp_scheduler_utilization", F.coalesce(eligible < 1.0, F.lit(False)) | F.coalesce(active < 40.0, F.lit(False)), F.greatest(lack(eligible, 1.0), lack(active, 40.0))),
        ("low_issue_efficiency", c("avg_issue_slot_utilization_pct") < 60.0, unit(1.0 - c("avg_issue_slot_utilization_pct") / 100.0)),
    ]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(n).alias("label"), half_up(score, 4).alias("score"), F.lit(i).cast("long").alias("rule_no"))) for i, (n, cond, score) in enumerate(rules)]), lambda x: x.isNotNull())
    return s.select("run_id", F.explode(found).alias("x")).select("run_id", "x.*")


def runtime_share(kernels: DataFrame) -> DataFrame:
    """Adds runtime_share_pct: the kernel's part of its run's total duration."""
    total = F.sum("kernel_duration_us").over(Window.partitionBy("run_id"))
    return kernels.withColumn("runtime_share_pct", F.when(total > 0, half_up(F.col("kernel_duration_us") / total * 100.0, 2)))


def kernel_opportunity(kernels: DataFrame, top: int = 5) -> DataFrame:
    """Score = share x severity x gap to peak; the ``top`` kernels of each run, ties by name. Needs roofline and share."""
    mfu, dram, occ = F.col("mfu_pct"), F.coalesce("dram_throughput_pct", F.lit(0.0)), F.coalesce("achieved_occupancy_pct", F.lit(0.0))
    used = F.greatest(dram, F.coalesce("issue_slot_utilization_pct", F.lit(0.0))) / 100.0
    gap = F.greatest(F.lit(0.0), F.coalesce(1.0 - F.least(mfu, F.lit(100.0)) / 100.0, 1.0 - used * 0.7))
    severity = F.when(F.col("roofline_region") == "memory_bound", 1.0).when(mfu < 20.0, 0.85).when((occ > 0) & (occ < 30.0), 0.7).when(dram > 60.0, 0.65).otherwise(0.4)
    timed = F.count("kernel_duration_us").over(Window.partitionBy("run_id")) > 0
    df = kernels.withColumns({"opportunity_score": half_up(F.coalesce(F.col("runtime_share_pct") / 100.0, F.lit(1.0)) * severity * gap, 4), "timed": timed})
    score = F.col("opportunity_score")
    label = F.when(score > F.when(F.col("timed"), 0.25).otherwise(0.55), "high").when(score > F.when(F.col("timed"), 0.08).otherwise(0.25), "medium").otherwise("low")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("opportunity_score"), "kernel_name"))
    return df.withColumns({"opportunity": label, "place": place}).where(F.col("place") <= top)


def occupancy_rollup(kernels: DataFrame) -> DataFrame:
    """Per run: kernels with data, kernels below 40 %, mean achieved, gap and efficiency, and the dominant limiter."""
    base = kernels.groupBy("run_id").agg(F.count("achieved_occupancy_pct").alias("kernels_with_occupancy"), F.count(F.when(F.col("achieved_occupancy_pct") < 40.0, 1)).alias("kernels_low_occupancy"), *[half_up(F.avg(c), 2).alias(f"avg_{c}") for c in ("achieved_occupancy_pct", "occupancy_gap_pct", "occupancy_efficiency_pct")])
    counts = kernels.select("run_id", F.explode("limiters").alias("limiter")).groupBy("run_id", "limiter").agg(F.count("*").alias("n"))
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "limiter"))).where("k = 1").select("run_id", F.col("limiter").alias("dominant_limiter"))
    return base.join(first, "run_id", "left")


def tensor_rollup(kernels: DataFrame) -> DataFrame:
    """Per run: tensor-core counts, mean, any mixed-precision opportunity and the overall label."""
    out = kernels.groupBy("run_id").agg(F.count("tensor_core_utilization_pct").alias("kernels_with_tc"), F.count_if("tc_active").alias("kernels_tc_active"), F.count_if(F.col("tc_eligible") & ~F.col("tc_active")).alias("eligible_inactive"), F.count_if("fallback").alias("fallbacks"), half_up(F.avg("tensor_core_utilization_pct"), 2).alias("avg_tc_pct"), F.bool_or("mixed_precision_opportunity").alias("any_opportunity"))
    label = F.when(F.col("kernels_with_tc") == 0, "no_data").when((F.col("fallbacks") > 0) | (F.col("eligible_inactive") > 0), "inactive").when(F.col("avg_tc_pct") > 50.0, "efficient").when(F.col("kernels_tc_active") > 0, "underutilized").otherwise("no_data")
    return out.withColumn("overall_label", label)


def kernel_launch_rollup(kernels: DataFrame) -> DataFrame:
    """Per run: kernels, kernels with launch data, and mean estimated occupancy."""
    return kernels.groupBy("run_id").agg(F.count("*").alias("kernels"), F.count("threads_per_block").alias("kernels_with_launch"), half_up(F.avg("estimated_occupancy_pct"), 2).alias("avg_estimated_occupancy_pct"))


def extract_kernel_signals(summary: DataFrame) -> DataFrame:
    """``signals`` and ``numbers`` of every profiled run: a run summary with roofline columns over its means."""
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    dram, issue, occ, tensor = zero("avg_dram_throughput_pct"), zero("avg_issue_slot_utilization_pct"), zero("avg_occupancy_pct"), c("avg_tensor_core_utilization_pct")
    by = lambda *causes: F.arrays_overlap("limit_causes", F.array(*map(F.lit, causes)))
    stall = c("dominant_warp_stall")
    signals = flags({
        "memory_bandwidth_saturated": dram > 70.0, "memory_bandwidth_high": dram > 50.0, "tensor_core_underutilized": tensor < 30.0, "tensor_core_inactive": tensor < 10.0,
        "l1_cache_miss_heavy": c("avg_l1_cache_hit_rate_pct") < 40.0, "l2_cache_miss_heavy": c("avg_l2_cache_hit_rate_pct") < 50.0, "uncoalesced_global_loads": c("avg_global_load_sectors_per_request") > 4.0,
        "issue_efficiency_low": issue < 60.0, "issue_efficiency_very_low": issue < 40.0, "eligible_warps_low": c("avg_eligible_warps_per_scheduler") < 1.0, "scheduler_active_low": c("avg_scheduler_active_pct") < 40.0,
        "occupancy_good": occ > 60.0, "occupancy_low": occ < 30.0, "occupancy_limited_by_registers": by("registers"), "occupancy_limited_by_shared_memory": by("shared_memory"),
        "occupancy_limited_by_block_size": by("threads", "blocks", "unknown_threads_per_block"),
        "warp_stall_is_memory": stall.isin(*MEMORY_STALLS), "warp_stall_is_sync": stall.isin(*SYNC_STALLS), "warp_stall_is_compute": stall.isin(*COMPUTE_STALLS[:2]),
        "mfu_low": c("mfu_pct") < 40.0, "roofline_estimated": F.lit(False), **environment(c("environment") if "environment" in summary.columns else None),
    })
    mean = lambda k: F.coalesce(half_up(c("stall_means")[k], 2), F.lit(0.0))
    values = numbers({
        "dram_throughput_pct": dram, "tensor_core_utilization_pct": zero("avg_tensor_core_utilization_pct"), "l1_cache_hit_rate_pct": c("avg_l1_cache_hit_rate_pct"), "l2_cache_hit_rate_pct": c("avg_l2_cache_hit_rate_pct"),
        "avg_global_load_sectors_per_request": c("avg_global_load_sectors_per_request"), "issue_slot_utilization_pct": issue, "avg_eligible_warps_per_scheduler": zero("avg_eligible_warps_per_scheduler"),
        "avg_scheduler_active_pct": zero("avg_scheduler_active_pct"), "avg_occupancy_pct": occ, "memory_stall_fraction": zero("memory_stall_fraction"), "avg_barrier_stall_pct": mean("barrier"),
        "avg_math_throttle_stall_pct": mean("math_pipe_throttle"), "avg_registers_per_thread": half_up(c("avg_registers_per_thread"), 1), "mfu_pct": c("mfu_pct"), "arithmetic_intensity": c("arithmetic_intensity"),
        "achieved_tflops": c("achieved_tflops"), "peak_bw_gbps": c("peak_bw"), "roofline_ceiling_tflops": c("roofline_ceiling_tflops"),
    })
    text = F.map_filter(F.create_map(F.lit("dominant_warp_stall"), stall, F.lit("roofline_region"), c("roofline_region")), lambda k, v: v.isNotNull())
    return summary.select("run_id", F.map_concat(signals, text).alias("signals"), values.alias("numbers"))
