"""Queries over compiled and source texts, and over evidence of several layers, and their SQL.

The texts are put together from columns of ``part`` by repetition, so that SQL knows every count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.operators import classify as C
from gaugefleet.operators import kernels as K
from gaugefleet.operators import ptx as X
from gaugefleet.operators import reconcile as E
from gaugefleet.operators import source as S
from gaugefleet.operators import steps as ST
from gaugefleet.plans import profiling as P
from gaugefleet.plans import telemetry as T
from gaugefleet.plans.shared import Shared
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import gpu_samples, table, telemetry_events

RUNS, FIRST = 20, 10  # runs of texts, and how many of them have telemetry
_PTX = r"""concat('.version 8.0\n.target sm_80\n.visible .entry k', p_partkey, '(\n)\n{\n .reg .pred %p<4>;\n .reg .b32 %r<', p_size * 2, '>;\n .reg .f64 %fd<', p_partkey % 40, '>;\n',
    CASE WHEN p_partkey % 37 = 0 THEN ' .local .align 4 .b8 loc[64];\n ld.local.f32 %f1, [loc];\n' ELSE '' END, repeat(' ld.global.f32 %f1, [%rd1];\n', p_size % 9), repeat(' ld.global.v4.f32 {%f1, %f2, %f3, %f4}, [%rd1];\n', p_partkey % 3),
    repeat(' st.global.f64 [%rd2], %fd1;\n', CASE WHEN p_partkey % 20 < 10 THEN p_partkey % 4 ELSE 0 END), repeat(' add.f32 %f1, %f1, %f2;\n', p_size),
      repeat(' fma.rn.f64 %fd1, %fd1, %fd2, %fd3;\n', CASE WHEN p_partkey % 20 < 5 THEN p_partkey % 2 ELSE 0 END),
    '$L1:\n', repeat(' @%p1 bra $L1;\n', p_partkey % 5), repeat(' ld.shared.f32 %f1, [%rd3];\n', CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END), ' ret;\n}\n')"""
_CUDA = r"""concat('// __global__ void none() { }\n__global__ void k', p_partkey, '(float* a, const float* b, int n) {\n', CASE WHEN p_partkey % 5 <> 4 THEN '  int idx = blockIdx.x * blockDim.x + threadIdx.x;\n' ELSE '  int idx = 0;\n' END,
    CASE p_partkey % 6 WHEN 0 THEN '  __shared__ float tile[32][16];\n' WHEN 2 THEN '  __shared__ float tile[32][26];\n' WHEN 4 THEN '  __shared__ float tile[32][32];\n'
      ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN '  if (idx < n) n = n - 1;\n' ELSE '' END,
    repeat('  a[idx] = b[idx];\n', p_size % 4), repeat('  for (int j = 0; j < n; ++j) {\n    a[j] += b[j];\n    __syncthreads();\n  }\n', p_partkey % 4), CASE WHEN p_partkey % 7 = 0 THEN '  a[idx * stride] = 0;\n' ELSE '' END,
    CASE WHEN p_partkey % 11 = 0 THEN '  if (threadIdx.x % 2 == 0) n = 0;\n' ELSE '' END, '}\nvoid run() { k', p_partkey, '<<<grid, ', CASE p_partkey % 4 WHEN 0 THEN
      '128' WHEN 1 THEN 'dim3(16, 3)' WHEN 2 THEN '20' ELSE 'bs' END, '>>>(a, b, n); }\n')"""


def texts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """run_id, path and text of every part, as compiled (ptx) or source (cu) text."""
    made = _PTX if kind == "ptx" else _CUDA
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a text is a hundred times its part, which may all be in one split
    return parts.selectExpr(f"p_partkey % {RUNS} AS run_id", f"concat('p', p_partkey, '.{kind}') AS path", f"{made} AS text")


def _ptx(spark: SparkSession, d: str) -> DataFrame:
    return X.ptx_findings(X.ptx_instruction_mix(X.scan_ptx_kernels(texts(spark, d, "ptx"))))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_cuda_kernels(texts(spark, d, "cu"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    scanned = _scan(spark, d)
    kernels, launches = S.source_signals(scanned), S.launch_signals(scanned.where("kind = 'launch'"))
    return S.source_rule_match(kernels).unionByName(S.source_rule_match(launches, scope="launch")).unionByName(S.source_rule_match(S.occupancy_signals(kernels), scope="occupancy"))


def q_scan_ptx_kernels(spark, d):
    return X.scan_ptx_kernels(texts(spark, d, "ptx")).select("run_id", "path", F.col("kernel_no").cast("long").alias("kernel_no"), "kernel_name", "version", "target", "registers", "local_bytes")


def q_ptx_instruction_mix(spark, d):
    df = X.ptx_instruction_mix(X.scan_ptx_kernels(texts(spark, d, "ptx")))
    names = ("global_loads", "global_stores", "shared_loads", "local_loads", "control_flow", "fp64_ops", "fp32_ops", "fp64_memory_ops")
    return df.select("path", "instructions", "branches", "conditional_branches", "loops", *[F.coalesce(F.col("mix")[n], F.lit(0)).cast("long").alias(n) for n in names])


def q_ptx_findings(spark, d):
    return _ptx(spark, d).select("path", F.array_join("findings", ",").alias("findings"))


def q_ptx_run_summary(spark, d):
    return _rounded(X.ptx_run_summary(_ptx(spark, d)))


def q_classify_ptx(spark, d):
    return X.classify_ptx(X.ptx_run_summary(_ptx(spark, d)))


def q_extract_ptx_signals(spark, d):
    df = X.extract_ptx_signals(X.ptx_run_summary(_ptx(spark, d)))
    return df.select("run_id", F.array_join(F.array_sort(F.map_keys(F.map_filter("signals", lambda k, v: v == "true"))), ",").alias("signals"), F.col("numbers")["ptx_max_register_count"].alias("registers"))


def q_scan_cuda_kernels(spark, d):
    return _scan(spark, d).select("run_id", "path", "kind", "name", "line", "syncs_in_loops", "block_size")


def q_source_signals(spark, d):
    df = S.patterns(S.source_signals(_scan(spark, d)))
    true = F.array_sort(F.map_keys(F.map_filter("signals", lambda k, v: v == "true")))
    counts = ("sync_count", "sync_in_loop_count", "for_count", "global_access_count", "branch_count", "bounds_check_count", "local_var_count", "max_shared_bytes")
    return df.select("path", F.array_join(true, ",").alias("signals"), *[F.col("numbers")[c].cast("long").alias(c) for c in counts], F.array_join("styles", ",").alias("styles"), F.array_join("indexing", ",").alias("indexing"))


def q_source_rule_match(spark, d):
    return _findings(spark, d).select("run_id", "path", "name", "rule", "severity")


def q_launch_advice(spark, d):
    return _rounded(S.launch_advice(S.source_signals(_scan(spark, d))).withColumn("limiters", F.array_join("limiters", ",")))


def q_launch_kernel_join(spark, d):
    return S.launch_kernel_join(_scan(spark, d)).withColumn("block_sizes", F.array_join(F.col("block_sizes").cast("array<string>"), ","))


def q_source_scan_summary(spark, d):
    return S.source_scan_summary(_scan(spark, d), _findings(spark, d))


# --- layers ---------------------------------------------------------------------------------------


def _evidence(shared: Shared) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules that source texts match, their access styles, and the summary of compiled texts, by run."""
    spark, d = shared.spark, shared.sf_dir
    # What a run's kernels say is a set, and a kernel says it by its body and parameters alone, so equal ones of a run are one.
    kernels = lambda: _scan(spark, d).where("kind = 'kernel'").select("run_id", "kind", "params", "body", "syncs_in_loops").distinct()
    signals = shared.table("source_signals", lambda: S.source_signals(kernels()))
    found = S.source_rule_match(signals, keys=("run_id",)).select("run_id", F.col("rule").alias("label"))
    styles = signals.select("run_id", F.explode("styles").alias("label"))
    return found, styles, shared.table("compiled", lambda: X.ptx_run_summary(_ptx(spark, d)))


def _telemetry(shared: Shared) -> DataFrame:
    """Telemetry stands beside the texts of the first ten runs, so only their steps are put together."""
    spark, d = shared.spark, shared.sf_dir
    steps = shared.table("first_steps", lambda: ST.step_metrics(telemetry_events(spark, d, FIRST)))
    return shared.table("first_runs", lambda: ST.run_summary(steps, gpu_samples(spark, d).where(F.col("run_id") < FIRST)))


def _layers(shared: Shared) -> DataFrame:
    """Signals by layer. Runs have source and compiled layers, profiles where there are some, and telemetry under 10."""

    def build() -> DataFrame:
        found, styles, compiled = _evidence(shared)
        names = lambda df: df.groupBy("run_id").agg(F.collect_set("label").alias("names"))
        layer = lambda runs, held, name: runs.join(held, "run_id", "left").select("run_id", F.lit(name).alias("layer"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
        source = layer(texts(shared.spark, shared.sf_dir, "cu").select("run_id").distinct(), names(found.union(styles.where("label = 'strided_or_pitched'"))), "source")
        ptx = X.extract_ptx_signals(compiled).select("run_id", F.lit("ptx").alias("layer"), F.map_keys(F.map_filter("signals", lambda k, v: v == "true")).alias("names"))
        profiler = layer(_telemetry(shared).select("run_id"), names(C.classify_run(_telemetry(shared))), "profiler")
        return source.unionByName(ptx).unionByName(E.kernel_layer(shared.signals("kernel"))).unionByName(profiler)

    return shared.table("layers", build)


def _labels(shared: Shared) -> DataFrame:
    """Labels by layer."""
    found, _, compiled = _evidence(shared)
    of = lambda df, layer: df.select("run_id", F.lit(layer).alias("layer"), "label")
    return of(found, "source").union(of(X.classify_ptx(compiled), "ptx")).union(of(K.classify_kernels_run(shared.kernel_runs()), "ncu")).union(of(C.classify_run(_telemetry(shared)), "profiler"))


def _reconciled(shared: Shared) -> DataFrame:
    return shared.table("reconciled", lambda: E.reconcile_layers(_layers(shared)))


def q_reconcile_layers(spark, d):
    return _rounded(E.reconcile_layers(_layers(Shared(spark, d))).withColumn("layers_confirming", F.array_join("layers_confirming", ",")))


def q_missing_evidence(spark, d):
    shared = Shared(spark, d)
    return E.missing_evidence(_reconciled(shared), _layers(shared)).withColumn("metrics", F.array_join("metrics", ","))


def q_unreconciled_findings(spark, d):
    shared = Shared(spark, d)
    return E.unreconciled_findings(_labels(shared), _reconciled(shared))


def q_primary_reconciled(spark, d):
    return E.primary_reconciled(_reconciled(Shared(spark, d)))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_P = f"""pt AS (SELECT p_partkey AS pk, p_size AS sz, p_partkey % {RUNS} AS run_id, p_partkey % 20 AS m FROM part),
    px0 AS (SELECT *, sz % 9 + 4 * (pk % 3) AS gl, CASE WHEN m < 10 THEN pk % 4 ELSE 0 END AS gs, CASE WHEN pk % 3 = 0 THEN 2 ELSE 0 END AS sl, CASE WHEN pk % 37 = 0 THEN
      1 ELSE 0 END AS ll, pk % 5 AS cb, CASE WHEN m < 5 THEN pk % 2 ELSE 0 END AS f64,
      sz * 2 + 2 * (pk % 40) AS regs, CASE WHEN pk % 37 = 0 THEN 64 ELSE 0 END AS loc FROM pt),
    px AS (SELECT *, ll + sz % 9 + pk % 3 + gs + sz + f64 + cb + sl + 1 AS ins FROM px0),
    ps AS (SELECT run_id, count(*) AS kernel_count, CAST(sum(ins) AS BIGINT) AS total_instructions, {_r("avg(regs)", 1)} AS avg_register_count, CAST(max(regs) AS BIGINT)
      AS max_register_count, count(CASE WHEN loc > 0 THEN 1 END) AS kernels_with_spills,
      CAST(sum(ll) AS BIGINT) AS total_spill_loads, 0::BIGINT AS total_spill_stores, count(CASE WHEN f64 > 0 THEN 1 END) AS kernels_with_fp64, count(CASE WHEN gs > 0 THEN
      1 END) AS kernels_with_fp64_data_movement, CAST(sum(gs) AS BIGINT) AS total_fp64_data_movement_ops,
      0::BIGINT AS kernels_with_tensor_ops, {_r("max((gl + gs) / ins)")} AS max_global_memory_ratio, {_r("avg((gl + gs) / ins)")} AS avg_global_memory_ratio, count(CASE
      WHEN (gl + gs) / ins > 0.4 THEN 1 END) AS kernels_with_high_global_memory_ratio,
      count(CASE WHEN sl = 0 THEN 1 END) AS kernels_without_shared_memory, {_r("max(cb / ins)")} AS max_branch_density, count(CASE WHEN cb / ins > 0.15 THEN 1 END) AS
      kernels_with_high_branch_density, sum(gl) AS t_global_loads, sum(gs) AS t_global_stores, sum(sz) AS t_fp32_ops, sum(cb + 1) AS t_control_flow FROM px GROUP BY run_id),
    pl AS (SELECT run_id, 'ptx_register_spills' AS label, {_r("least(1.0, 0.95 + least(0.05, 0.01 * kernels_with_spills))")} AS score, 0::BIGINT AS rule_no FROM ps WHERE kernels_with_spills > 0 UNION ALL
      SELECT run_id, 'ptx_register_pressure', CASE WHEN max_register_count > 128 THEN {_r("0.75 + least(0.15, (max_register_count - 128) / 512)")} ELSE
      {_r("0.5 + least(0.2, (max_register_count - 64) / 320)")} END, 1 FROM ps WHERE max_register_count > 64 UNION ALL
      SELECT run_id, 'ptx_global_memory_heavy', {_r("0.45 + least(0.35, max_global_memory_ratio - 0.4)")}, 2 FROM ps WHERE max_global_memory_ratio > 0.4 UNION ALL SELECT
      run_id, 'ptx_fp64_usage', CASE WHEN kernels_with_fp64 > 0 THEN 0.45 ELSE 0.35 END, 3 FROM ps WHERE kernels_with_fp64 + kernels_with_fp64_data_movement > 0 UNION ALL
      SELECT run_id, 'ptx_branch_divergence_risk', {_r("0.4 + least(0.3, max_branch_density - 0.15)")}, 4 FROM ps WHERE max_branch_density > 0.15)"""
_C = f"""cs AS (SELECT p_partkey AS pk, p_partkey % {RUNS} AS run_id, 'p' || p_partkey || '.cu' AS path, 'k' || p_partkey AS name, p_partkey % 4 AS loops, p_size % 4 AS
      loads, p_partkey % 5 <> 4 AS grid, p_partkey % 2 = 0 AS sh, p_partkey % 3 = 0 AS guard, p_partkey % 7 = 0 AS strided, p_partkey % 11 = 0 AS diverge,
      CASE p_partkey % 6 WHEN 0 THEN 16 WHEN 2 THEN 26 WHEN 4 THEN 32 ELSE 0 END AS dim, CASE p_partkey % 4 WHEN 0 THEN 128 WHEN 1 THEN 48 WHEN 2 THEN 20 END AS block, p_size FROM part),
    cn AS (SELECT *, sh::INT + 2 * loads + 2 * loops + strided::INT AS accesses, guard::INT + diverge::INT AS branches, 1 + loops AS locals, 128 * dim AS bytes, grid OR diverge AS threads, loads > 0 OR strided AS indexed FROM cs),
    fi AS ({" UNION ALL ".join(f"SELECT run_id, path, name, '{rule}' AS rule, '{severity}' AS severity FROM cn WHERE {cond}" for rule, severity, cond in (
        ("missing_obvious_bounds_guard", "medium", "threads AND NOT guard AND indexed"), ("no_thread_indexing_detected", "low", "NOT threads"), ("warp_divergence", "medium", "diverge"), ("missing_vectorized_loads", "low", "loads > 0 AND NOT sh AND accesses >= 2"),
        ("no_shared_memory_tiling", "medium", "NOT sh AND loops >= 1 AND accesses >= 3"), ("uncoalesced_access", "medium", "strided"), ("possible_shared_memory_bank_conflict", "medium", "dim = 32"), ("shared_memory_without_barrier", "medium", "sh AND loops = 0"),
        ("sync_inside_tight_loop", "medium", "loops >= 3"), ("unnecessary_syncthreads", "medium", "loops > 0 AND NOT sh"), ("dimensions_not_tensor_core_friendly", "low", "dim = 26"), ("poor_block_size_subwarp", "high", "block < 32"), ("poor_block_size_unaligned", "medium", "block = 48")))})"""
_SIGNAL_SQL = [
    ("strided_or_pitched", "strided"), ("likely_coalesced_1d", "loads > 0"), ("shared_memory_tiling", "sh"), ("has_shared", "sh"), ("has_sync", "loops > 0"), ("has_loop", "loops > 0"), ("has_thread_indexing", "threads"), ("has_bounds_guard", "guard"),
    ("has_indexed_global", "indexed"), ("has_scalar_params", "true"), ("bank_conflict_risk", "dim = 32"), ("tc_unfriendly_dims", "dim = 26"), ("tc_unfriendly_dims_hopper", "sh"), ("warp_divergence_pattern", "diverge"),
]
_names = lambda pairs: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + ")"
_PTX_SIGNALS = [
    ("ptx_branch_divergence_risk", "max_branch_density > 0.15"), ("ptx_global_memory_heavy", "max_global_memory_ratio > 0.4"), ("ptx_has_fp64", "kernels_with_fp64 + kernels_with_fp64_data_movement > 0"), ("ptx_has_fp64_arithmetic", "kernels_with_fp64 > 0"),
    ("ptx_has_fp64_data_movement", "kernels_with_fp64_data_movement > 0"), ("ptx_has_register_spills", "kernels_with_spills > 0"), ("ptx_high_register_count", "max_register_count > 64"), ("ptx_no_shared_memory", "kernels_without_shared_memory = kernel_count"), ("ptx_very_high_register_count", "max_register_count > 128"),
]


def _advice_sql() -> str:
    shared = f"CASE WHEN bytes > 0 THEN {K.LIMITS['shared']} // bytes END"
    return f"""WITH {_C}, b AS (SELECT run_id, path, name, bytes, unnest([128, 256, 512]) AS t FROM cn), o AS (SELECT *, 32 AS bb, {shared} AS bs, 2048 // t AS bt FROM b), a AS (SELECT *, least(bb, bs, bt) AS act FROM o)
      SELECT run_id, path, name, t::BIGINT AS block_size, {_r("least(act * t / 2048.0::DOUBLE, 1.0) * 100.0", 2)} AS estimated_occupancy_pct, concat_ws(',', CASE WHEN bb
      = act THEN 'blocks' END, CASE WHEN bs = act THEN 'shared_memory' END, CASE WHEN bt = act THEN 'threads' END) AS limiters FROM a"""


from gaugefleet.plans.advice import _KERNEL  # noqa: E402

_has = lambda column, name: f"list_contains({column}, '{name}')"
_LAYER = f"""{_KERNEL}, {T._STEPS.removeprefix("WITH ")}, {_P}, {_C},
    l_source AS (SELECT run_id, bool_or(strided) AS strided, bool_or(loops > 0 AND NOT sh) AS syncs FROM cn GROUP BY run_id),
    l_runs AS (SELECT run_id, bool_or(label = 'sync_bound') AS sync FROM (SELECT run_id, NULL AS label FROM runs WHERE scope = 'run' AND run_id < 10 UNION ALL SELECT
      run_id, label FROM lab WHERE scope = 'run' AND run_id < 10) GROUP BY run_id),
    l_ncu AS (SELECT run_id, sig, roofline_region, mfu_pct, coalesce(roofline_region = 'memory_bound', false) AS mem FROM ksg),
    tried AS (
      SELECT run_id, 'inefficient_global_memory_access' AS label, 'source' AS layer, strided AS ok FROM l_source UNION ALL SELECT run_id, 'excessive_synchronization', 'source', syncs FROM l_source UNION ALL
      SELECT run_id, 'inefficient_global_memory_access', 'ptx', max_global_memory_ratio > 0.4 OR kernels_without_shared_memory = kernel_count FROM ps UNION ALL SELECT
      run_id, 'register_pressure', 'ptx', kernels_with_spills > 0 OR max_register_count > 64 FROM ps UNION ALL
      SELECT run_id, 'memory_bandwidth_saturation', 'ptx', max_global_memory_ratio > 0.4 FROM ps UNION ALL SELECT run_id, 'warp_divergence_risk', 'ptx', max_branch_density > 0.15 FROM ps UNION ALL
      SELECT run_id, 'inefficient_global_memory_access', 'ncu', {_has("sig", "uncoalesced_global_loads=true")} FROM l_ncu UNION ALL SELECT run_id,
      'excessive_synchronization', 'ncu', {_has("sig", "warp_stall_is_sync=true")} FROM l_ncu UNION ALL
      SELECT run_id, 'register_pressure', 'ncu', {_has("sig", "occupancy_limited_by_registers=true")} AND {_has("sig", "occupancy_good=false")} FROM l_ncu UNION ALL
      SELECT run_id, 'tensor_core_underutilization', 'ncu', {_has("sig", "tensor_core_underutilized=true")} FROM l_ncu UNION ALL
      SELECT run_id, 'memory_bandwidth_saturation', 'ncu', {_has("sig", "memory_bandwidth_saturated=true")} FROM l_ncu UNION ALL SELECT run_id, 'roofline_memory_bound',
      'ncu', mem FROM l_ncu UNION ALL SELECT run_id, 'roofline_low_mfu', 'ncu', coalesce(mfu_pct < 20, false) AND NOT mem FROM l_ncu UNION ALL
      SELECT run_id, 'excessive_synchronization', 'profiler', coalesce(sync, false) FROM l_runs),
    di0 AS (SELECT run_id, label, count(CASE WHEN ok THEN 1 END) AS n, count(*) AS n_available, string_agg(CASE WHEN ok THEN layer END, ',' ORDER BY layer) AS
      layers_confirming FROM tried GROUP BY ALL HAVING count(CASE WHEN ok THEN 1 END) > 0),
    di AS (SELECT *, CASE WHEN label IN ('excessive_synchronization', 'warp_divergence_risk', 'roofline_low_mfu') THEN 'medium' ELSE 'high' END AS severity, CASE WHEN n
      >= 3 THEN 'confirmed' WHEN n = 2 AND n_available = 2 THEN 'high' WHEN n = 2 THEN 'medium-high' WHEN n_available <= 1 THEN 'medium' ELSE 'low-medium' END AS confidence
      FROM di0),
    nl AS (SELECT run_id AS rid, count(*) AS layers FROM (SELECT run_id FROM l_source UNION ALL SELECT run_id FROM ps UNION ALL SELECT run_id FROM l_ncu UNION ALL SELECT run_id FROM l_runs) GROUP BY run_id),
    ll AS (SELECT DISTINCT run_id, 'source' AS layer, rule AS label FROM fi WHERE rule NOT LIKE 'poor%' UNION ALL SELECT run_id, 'ptx', label FROM pl UNION ALL SELECT
      run_id, 'ncu', label FROM klab UNION ALL SELECT run_id, 'profiler', label FROM lab WHERE scope = 'run' AND run_id < 10)"""
_metrics = {label: ",".join(sorted({m for x, _, m in E.NEEDED if x == label})) for label, *_ in E.DIAGNOSES}
ORACLES = {
    "scan_ptx_kernels": f"WITH {_P} SELECT run_id, 'p' || pk || '.ptx' AS path, 0::BIGINT AS kernel_no, 'k' || pk AS kernel_name, '8.0' AS version, 'sm_80' AS target, regs::BIGINT AS registers, loc::BIGINT AS local_bytes FROM px",
    "ptx_instruction_mix": f"WITH {_P} SELECT 'p' || pk || '.ptx' AS path, ins::BIGINT AS instructions, cb::BIGINT AS branches, cb::BIGINT AS conditional_branches, (cb > 0)::BIGINT AS loops, gl::BIGINT AS global_loads, gs::BIGINT AS global_stores, sl::BIGINT AS shared_loads, ll::BIGINT AS local_loads, (cb + 1)::BIGINT AS control_flow, f64::BIGINT AS fp64_ops, sz::BIGINT AS fp32_ops, gs::BIGINT AS fp64_memory_ops FROM px",
    "ptx_findings": f"WITH {_P} SELECT 'p' || pk || '.ptx' AS path, {_names([('register_spills_detected', 'loc > 0'), ('very_high_register_count', 'regs > 128'), ('high_register_count', 'regs > 64 AND regs <= 128'), ('fp64_detected', 'f64 > 0'), ('fp64_data_movement_detected', 'gs > 0'), ('high_global_memory_ratio', '(gl + gs) / ins > 0.4'), ('high_branch_count', 'cb / ins > 0.15'), ('no_shared_memory_usage', 'sl = 0 AND gl > 20')])} AS findings FROM px",
    "ptx_run_summary": f"WITH {_P} SELECT * EXCLUDE (t_global_loads, t_global_stores, t_fp32_ops, t_control_flow), CASE greatest(t_global_loads, t_global_stores, t_fp32_ops, t_control_flow) WHEN t_control_flow THEN 'control_flow' WHEN t_fp32_ops THEN 'fp32_ops' WHEN t_global_loads THEN 'global_loads' ELSE 'global_stores' END AS dominant_instruction_category FROM ps",
    "classify_ptx": f"WITH {_P} SELECT run_id, label, score::DOUBLE AS score, rule_no FROM pl",
    "extract_ptx_signals": f"WITH {_P} SELECT run_id, {_names(_PTX_SIGNALS)} AS signals, max_register_count::DOUBLE AS registers FROM ps",
    "scan_cuda_kernels": f"WITH {_C} SELECT run_id, path, 'kernel' AS kind, name, 2::BIGINT AS line, loops::BIGINT AS syncs_in_loops, NULL::BIGINT AS block_size FROM cn UNION ALL SELECT run_id, path, 'launch', name, 5 + sh::INT + guard::INT + loads + 4 * loops + strided::INT + diverge::INT, NULL, block FROM cn",
    "source_signals": f"""WITH {_C} SELECT path, {_names(sorted(_SIGNAL_SQL))} AS signals, loops::BIGINT AS sync_count, loops::BIGINT AS sync_in_loop_count, loops::BIGINT
      AS for_count, accesses::BIGINT AS global_access_count, branches::BIGINT AS branch_count, guard::BIGINT AS bounds_check_count, locals::BIGINT AS local_var_count,
      bytes::BIGINT AS max_shared_bytes,
      CASE WHEN loads = 0 AND NOT strided AND NOT sh THEN CASE WHEN accesses > 0 THEN 'indexed_global_or_local_memory' ELSE '' END ELSE
      {_names([("likely_coalesced_1d", "loads > 0"), ("strided_or_pitched", "strided"), ("shared_memory_tiling", "sh")])} END AS styles, CASE WHEN grid THEN
      '1d_grid_stride_index' WHEN diverge THEN 'thread_x_indexing' ELSE '' END AS indexing FROM cn""",
    "source_rule_match": f"WITH {_C} SELECT * FROM fi",
    "launch_advice": _advice_sql(),
    "launch_kernel_join": f"WITH {_C} SELECT run_id, path, name, 2::BIGINT AS line, coalesce(block::VARCHAR, '') AS block_sizes FROM cn",
    "source_scan_summary": f"WITH {_C}, k AS (SELECT run_id, count(*) AS n FROM cn GROUP BY run_id), f AS (SELECT run_id AS r, count(*) AS findings, count(CASE WHEN severity = 'high' THEN 1 END) AS high_findings FROM fi GROUP BY 1) SELECT run_id, n AS kernels, n AS launches, coalesce(findings, 0) AS findings, coalesce(high_findings, 0) AS high_findings FROM k LEFT JOIN f ON r = run_id",
    "reconcile_layers": f"{_LAYER} SELECT run_id, label, severity, confidence, layers_confirming, n_available FROM di",
    "missing_evidence": f"{_LAYER} SELECT run_id, label, CASE label {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _metrics.items())} END AS metrics, CASE WHEN n + 1 >= 3 THEN 'confirmed' WHEN n + 1 = 2 AND greatest(layers, n) = 2 THEN 'high' WHEN n + 1 = 2 THEN 'medium-high' WHEN greatest(layers, n) <= 1 THEN 'medium' ELSE 'low-medium' END AS confidence_if_confirmed FROM di JOIN nl ON rid = run_id WHERE NOT contains(layers_confirming, 'ncu')",
    "unreconciled_findings": f"""{_LAYER}, cl(d, cy, c) AS (VALUES {", ".join(str(x) for x in E.CLAIMS)}) SELECT run_id, layer, label FROM ll WHERE NOT EXISTS (SELECT 1
      FROM di JOIN cl ON d = di.label AND contains(di.layers_confirming, cy) WHERE di.run_id = ll.run_id AND cy = ll.layer AND c = ll.label)""",
    "primary_reconciled": f"""{_LAYER}, o(l, k) AS (VALUES {", ".join(f"('{x[0]}', {i})" for i, x in enumerate(E.DIAGNOSES))}) SELECT run_id, label, confidence, severity
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE confidence WHEN 'confirmed' THEN 0 WHEN 'high' THEN 1 WHEN 'medium-high' THEN 2 WHEN 'medium' THEN 3
      ELSE 4 END, severity = 'medium', k) AS p FROM di JOIN o ON l = label) WHERE p = 1""",
}
