"""Queries over telemetry and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.functions import half_up, true_flags
from gaugefleet.operators import classify as C
from gaugefleet.operators import steps as S
from gaugefleet.plans.views import SQL, gpu_samples, telemetry_events, written


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of all runs, written once: the scans, selections and sums below each read them again."""
    return written(S.step_metrics(telemetry_events(spark, d)))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return S.run_summary(_steps(spark, d), gpu_samples(spark, d))


def _both(spark: SparkSession, d: str) -> DataFrame:
    return S.run_summary(S.with_scopes(_steps(spark, d)), gpu_samples(spark, d))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[half_up(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def q_step_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.step_metrics(telemetry_events(spark, d)))


def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_runs(spark, d))


def q_scoped_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.run_summary(S.steady_state_steps(_steps(spark, d)), gpu_samples(spark, d), "steady"))


def q_dominant_stall(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_id", "dominant_stall_type")


def q_steady_state_steps(spark: SparkSession, d: str) -> DataFrame:
    return S.steady_state_steps(_steps(spark, d), 2, 100).select("run_id", "step_id")


def q_shape_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.shape_changes(_steps(spark, d)).select("run_id", "step_id", "shape_signature", "shape_changed")


def q_worst_steps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.worst_steps(_steps(spark, d)))


def q_measurement_window(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.measurement_window(_steps(spark, d)))


def q_classify_run(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.classify_run(_both(spark, d)))


def q_rank_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.rank_bottlenecks(C.classify_run(_runs(spark, d))).drop("rule_no", "scope"))


def q_diagnose_run(spark: SparkSession, d: str) -> DataFrame:
    runs = _both(spark, d)
    return C.diagnose_run(C.rank_bottlenecks(C.classify_run(runs)), runs)


def q_steady_vs_run(spark: SparkSession, d: str) -> DataFrame:
    return C.steady_vs_run(q_diagnose_run(spark, d))


def q_framework_tax(spark: SparkSession, d: str) -> DataFrame:
    return C.framework_tax(_runs(spark, d)).drop("scope")


def q_extract_signals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.extract_signals(_runs(spark, d)).withColumn("signals", F.array_join(true_flags(F.col("signals")), ",")).drop("scope", "numbers"))


def q_union_sources(spark: SparkSession, d: str) -> DataFrame:
    samples = gpu_samples(spark, d).select("run_id", F.lit("gpu_sample").alias("event_type"), "utilization_gpu_pct")
    both = telemetry_events(spark, d).select("run_id", "event_type").unionByName(samples, allowMissingColumns=True)
    return both.groupBy("run_id", "event_type").agg(F.count("*").alias("n"), F.count("utilization_gpu_pct").alias("n_util"))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}


def _r(expression: str, digits: int = 4) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.500000001) / 1e{digits}"


def _summary(steps: str, scope: str) -> str:
    """SQL of the run summary over a table of steps."""
    done = "status = 'ok' AND wall > 0"
    ratio = lambda c: f"coalesce(avg(CASE WHEN {done} THEN least(1.0, {c} / CAST(wall AS DOUBLE)) END), 0.0)"
    return f"""
    SELECT run_id, '{scope}' AS scope, count(CASE WHEN {done} THEN 1 END) AS completed,
      coalesce(count(CASE WHEN status = 'ok' THEN 1 END) / (nullif(sum(CASE WHEN {done} THEN wall END), 0) / 1e9), 0.0) AS tput,
      coalesce(avg(CASE WHEN {done} THEN wall END), 0.0) AS wall_avg, coalesce(max(CASE WHEN {done} THEN wall END), 0) AS wall_max,
      coalesce(stddev_pop(CASE WHEN {done} THEN wall END) / avg(CASE WHEN {done} THEN wall END), 0.0) AS cv, CAST(sum(win) AS BIGINT) AS win,
      coalesce(avg(CASE WHEN status = 'ok' AND kc > 0 THEN kc END), 0.0) AS kc, coalesce(median(CASE WHEN status = 'ok' AND med > 0 THEN med END), 0.0) AS med,
      coalesce(avg(CASE WHEN status = 'ok' AND sf > 0 THEN sf END), 0.0) AS sf,
      CASE WHEN count(sig) >= 2 THEN count(CASE WHEN changed THEN 1 END) / CAST(count(sig) - 1 AS DOUBLE) ELSE 0.0 END AS vol,
      {ratio('loader')} AS ir, {ratio('h2d')} AS cr, {ratio('sync')} AS sr,
      CASE WHEN greatest(sum(loader), sum(h2d), sum(sync)) <= 0 THEN CASE WHEN sum(fwd + bwd + opt) > 0 THEN 'compute_bound' ELSE 'unknown' END
           WHEN sum(loader) >= sum(h2d) AND sum(loader) >= sum(sync) THEN 'input_bound' WHEN sum(h2d) >= sum(sync) THEN 'copy_bound' ELSE 'sync_bound' END AS stall
    FROM (SELECT *, sig IS NOT NULL AND sig <> prev AS changed FROM (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_id ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {steps})) GROUP BY run_id"""


_STEPS = f"""WITH {SQL["ev"]}, {SQL["gs"]},
    st AS (SELECT o.o_custkey % 50 AS run_id, o.o_orderkey AS step_id, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status, CAST(floor(30000 + o_totalprice * 0.2) AS BIGINT) AS wall, s.*
      FROM orders o LEFT JOIN (SELECT step_id AS sid, sum(loader) AS loader0, sum(h2d) AS h2d0, sum(sync) AS sync0, max(fwd) AS fwd0, max(bwd) AS bwd0, max(opt) AS opt0,
        max_by(batch, CASE WHEN batch IS NOT NULL THEN seq END) AS batch0, count(CASE WHEN win THEN 1 END) AS win0, sum(CASE WHEN win THEN kc END) AS kc0,
        max_by(q, CASE WHEN win AND q > 0 THEN seq END) AS med0, max_by(sf, CASE WHEN win THEN seq END) AS sf0 FROM ev GROUP BY step_id) s ON s.sid = o.o_orderkey),
    steps AS (SELECT run_id, step_id, status, wall, CAST(coalesce(loader0, 0) AS BIGINT) AS loader, CAST(coalesce(h2d0, 0) AS BIGINT) AS h2d, CAST(coalesce(sync0, 0) AS BIGINT) AS sync,
        coalesce(fwd0, 0) AS fwd, coalesce(bwd0, 0) AS bwd, coalesce(opt0, 0) AS opt, CASE WHEN batch0 IS NOT NULL THEN 'x:[' || batch0 || ', 128]' END AS sig, CAST(coalesce(batch0, 0) AS BIGINT) AS batch,
        coalesce(win0, 0) AS win, CAST(coalesce(kc0, 0) AS BIGINT) AS kc, coalesce(med0, 0.0) AS med, least(1.0, greatest(0.0, coalesce(sf0, 0.0))) AS sf FROM st),
    steady AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_id) AS n FROM steps WHERE status = 'ok' AND wall > 0) WHERE n > 2),
    smp AS (SELECT run_id AS rid, avg(util) AS util0, avg(mem) AS mem0, max(used / 100.0) AS peak0, CASE WHEN count(util) >= 2 THEN max(util) - min(util) ELSE 0.0 END AS inst0 FROM gs GROUP BY run_id),
    both0 AS ({_summary("steps", "run")} UNION ALL {_summary("steady", "steady")}),
    runs AS (SELECT b.*, coalesce(util0, 0.0) AS util, coalesce(mem0, 0.0) AS mem, coalesce(peak0, 0.0) AS peak, coalesce(inst0, 0.0) AS inst FROM both0 b LEFT JOIN smp ON rid = run_id),
    lab AS (SELECT run_id, scope, label, {_r("score0")} AS score, rule_no FROM (
      SELECT run_id, scope, 'input_bound' AS label, ir AS score0, 0 AS rule_no FROM runs WHERE completed > 0 AND ir >= 0.2 UNION ALL
      SELECT run_id, scope, 'copy_bound', cr, 1 FROM runs WHERE completed > 0 AND cr >= 0.15 UNION ALL SELECT run_id, scope, 'sync_bound', sr, 2 FROM runs WHERE completed > 0 AND sr >= 0.1 UNION ALL
      SELECT run_id, scope, 'underutilized_gpu', 1.0 - util / 100.0, 3 FROM runs WHERE completed > 0 AND util > 0 AND util < 35 UNION ALL
      SELECT run_id, scope, 'memory_pressure', peak, 4 FROM runs WHERE completed > 0 AND peak >= 0.9 UNION ALL SELECT run_id, scope, 'shape_instability', vol, 5 FROM runs WHERE completed > 0 AND vol >= 0.3 UNION ALL
      SELECT run_id, scope, 'launch_bound', {_r("least(0.5, greatest(0.3, (50.0 - util) / 100.0 + 0.3))")}, 6 FROM runs WHERE completed > 0 AND win > 0 AND util < 50 AND ir < 0.1 AND cr < 0.1 AND sr < 0.1 UNION ALL
      SELECT run_id, scope, 'insufficient_telemetry', 1.0, 7 FROM runs WHERE completed > 0 AND util <= 0 AND stall = 'unknown')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, scope ORDER BY score DESC, rule_no) AS place FROM lab),
    agg AS (SELECT run_id AS rid, scope AS sc, max(CASE WHEN place = 1 THEN label END) AS p, max(CASE WHEN place = 1 THEN score END) AS top, coalesce(max(CASE WHEN place = 2 THEN score END), 0.0) AS second, count(*) AS n,
      concat_ws(',', max(CASE WHEN place = 2 THEN label END), max(CASE WHEN place = 3 THEN label END)) AS sec, bool_or(label = 'input_bound') AS i, bool_or(label =
      'copy_bound') AS c, bool_or(label = 'sync_bound') AS s FROM ranked GROUP BY 1, 2),
    diag AS (SELECT run_id, scope, coalesce(p, CASE WHEN win > 0 THEN 'inconclusive' END) AS primary_bottleneck,
      coalesce(CASE WHEN p IN ('underutilized_gpu', 'launch_bound') THEN CASE WHEN i THEN 'input_bound' WHEN c THEN 'copy_bound' WHEN s THEN 'sync_bound' ELSE p END ELSE
      p END, CASE WHEN win > 0 THEN 'inconclusive' END) AS user_facing_bottleneck,
      coalesce(sec, '') AS secondary_bottlenecks, coalesce({_r("least(1.0, greatest(0.0, top + (CASE WHEN n = 1 THEN 0.15 ELSE 0.0 END + CASE WHEN top - second >= 0.25 THEN 0.15 WHEN top - second >= 0.1 THEN 0.1 WHEN top - second > 0 THEN 0.05 ELSE 0.0 END + CASE WHEN stall = p THEN 0.1 WHEN stall NOT IN ('unknown', 'compute_bound') THEN -0.05 ELSE 0.0 END)))")},
      0.0) AS confidence_score
      FROM runs LEFT JOIN agg ON rid = run_id AND sc = scope)"""

_SUMMARY_COLUMNS = f"""run_id, completed AS completed_steps, {_r("tput")} AS throughput_steps_per_sec, {_r("wall_avg")} AS step_time_avg_ns, wall_max AS step_time_max_ns, {_r("cv")} AS step_time_cv,
    win AS profiler_windows_exported, {_r("kc")} AS kernel_count_per_step, {_r("med")} AS median_cuda_kernel_duration_us, {_r("sf")} AS small_kernel_fraction, {_r("vol")} AS shape_volatility_ratio, stall AS dominant_stall_type,
    {_r("ir")} AS input_bound_ratio, {_r("cr")} AS copy_bound_ratio, {_r("sr")} AS sync_bound_ratio, {_r("util")} AS average_gpu_utilization_pct, {_r("mem")} AS
      average_memory_utilization_pct, {_r("peak")} AS memory_pressure_peak_ratio, {_r("inst")} AS utilization_instability_pct, scope"""

_over = {k: f"CASE WHEN {c} >= {t} THEN {_r(c)} ELSE 0.0 END" for k, c, t in (("i", "ir", 0.2), ("c", "cr", 0.15), ("s", "sr", 0.1))}
_SIGNALS = [
    ("low_gpu_activity", "util < 50"), ("very_low_gpu_activity", "util < 35"), ("unstable_gpu_util", "inst > 20"), ("input_pipeline_stalled", "i >= 0.2"), ("input_pipeline_severe", "i >= 0.4"),
    ("h2d_copy_low", "c < 0.05"), ("h2d_copy_stalled", "c >= 0.15"), ("h2d_copy_severe", "c >= 0.3"), ("sync_heavy", "s >= 0.1"), ("sync_severe", "s >= 0.25"), ("memory_near_capacity", "peak >= 0.9"),
    ("memory_pressure_moderate", "peak >= 0.75 AND peak < 0.9"), ("shapes_unstable", "vol >= 0.3"), ("shapes_highly_unstable", "vol >= 0.6"), ("has_profiler_data", "win > 0"), ("step_time_variable", "cv > 0.15"),
]

ORACLES = {
    "step_metrics": f"""{_STEPS} SELECT run_id, step_id, status, wall AS step_wall_time_ns, loader AS dataloader_wait_time_ns, h2d AS h2d_copy_time_ns, sync AS
      sync_wait_time_ns, fwd AS forward_time_ns, bwd AS backward_time_ns, opt AS optimizer_time_ns,
      sig AS shape_signature, batch AS batch_size, win AS profiler_windows_exported, kc AS kernel_count, {_r("med")} AS median_cuda_kernel_duration_us, {_r("sf")} AS
      small_kernel_fraction, {_r("CASE WHEN wall > 0 THEN least(1.0, (fwd + bwd + opt) / CAST(wall AS DOUBLE)) ELSE 0.0 END")} AS gpu_active_fraction_proxy FROM steps""",
    "run_summary": f"{_STEPS} SELECT {_SUMMARY_COLUMNS} FROM runs WHERE scope = 'run'",
    "scoped_summary": f"{_STEPS} SELECT {_SUMMARY_COLUMNS} FROM runs WHERE scope = 'steady'",
    "dominant_stall": f"{_STEPS} SELECT run_id, stall AS dominant_stall_type FROM runs WHERE scope = 'run'",
    "steady_state_steps": f"{_STEPS} SELECT run_id, step_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_id DESC) AS m FROM steady) WHERE m <= 100",
    "shape_changes": f"""{_STEPS} SELECT run_id, step_id, sig AS shape_signature, coalesce(sig <> prev, false) AS shape_changed FROM (SELECT *, last_value(sig IGNORE
      NULLS) OVER (PARTITION BY run_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM steps)""",
    "worst_steps": f"""{_STEPS}, l AS (SELECT run_id, step_id, 'input_bound' AS label, least(1.0, loader / CAST(wall AS DOUBLE)) AS v FROM steps WHERE status = 'ok' AND
      wall > 0 UNION ALL SELECT run_id, step_id, 'copy_bound', least(1.0, h2d / CAST(wall AS DOUBLE)) FROM steps WHERE status = 'ok' AND wall > 0
      UNION ALL SELECT run_id, step_id, 'sync_bound', least(1.0, sync / CAST(wall AS DOUBLE)) FROM steps WHERE status = 'ok' AND wall > 0) SELECT run_id, step_id, label,
      {_r("v")} AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, label ORDER BY v DESC, step_id) AS place FROM l WHERE v > 0) WHERE place <= 3""",
    "measurement_window": f"""{_STEPS} SELECT run_id, count(*) AS step_count, {_r("avg(wall)")} AS step_time_avg_ns, {_r("count(*) / (sum(wall) / 1e9)")} AS
      throughput_steps_per_sec, {_r("count(CASE WHEN sig <> prev THEN 1 END) / CAST(count(*) AS DOUBLE)")} AS shape_volatility_ratio
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_id) AS n FROM (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY
      step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM steps) WHERE status = 'ok' AND wall > 0) WHERE n BETWEEN 3 AND 12 GROUP BY run_id""",
    "classify_run": f"{_STEPS} SELECT run_id, scope, label, score, CAST(rule_no AS BIGINT) AS rule_no FROM lab",
    "rank_bottlenecks": f"{_STEPS} SELECT run_id, label, score, place FROM ranked WHERE scope = 'run'",
    "diagnose_run": f"{_STEPS} SELECT *, CASE WHEN confidence_score >= 0.75 THEN 'high' WHEN confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level FROM diag",
    "steady_vs_run": f"{_STEPS} SELECT a.run_id, a.primary_bottleneck AS run_primary, b.primary_bottleneck AS steady_primary, a.primary_bottleneck IS DISTINCT FROM b.primary_bottleneck AS diagnosis_changed FROM diag a LEFT JOIN diag b ON a.run_id = b.run_id AND b.scope = 'steady' WHERE a.scope = 'run'",
    "framework_tax": f"""{_STEPS}, t AS (SELECT run_id, greatest(0.0, (1.0 - least(1.0, greatest(0.0, util / 100.0))) - ({_over["i"]} + {_over["c"]} + {_over["s"]})) AS
      i, {_over["i"]} + {_over["c"]} + {_over["s"]} AS pipe, sf AS s, vol AS v, kc AS k, least(1.0, 0.6 * sf + 0.4 * least(1.0, kc / 200.0)) AS p FROM runs WHERE scope = 'run'
      AND win > 0),
      u AS (SELECT *, CAST(floor(least(100.0, 100.0 * i * (0.5 + 0.5 * p)) + 0.5) AS BIGINT) AS score FROM t),
      w AS (SELECT run_id, 0 AS n, floor(100 * p + 0.5) AS o, 'launch_fragmentation' AS name FROM u WHERE score >= 20 AND i >= 0.05 AND p > 0.1 UNION ALL SELECT run_id,
      1, floor(100.0 * (i * (0.5 + 0.5 * p)) + 0.5), 'graph_capture' FROM u WHERE score >= 20 AND i >= 0.05 AND v < 0.3 AND k >= 30
        UNION ALL SELECT run_id, 2, floor(100.0 * (s * 0.5) + 0.5), 'unfused_elementwise' FROM u WHERE score >= 20 AND i >= 0.05 AND s >= 0.4 UNION ALL SELECT run_id, 3,
        floor(100.0 * v + 0.5), 'dynamic_shapes' FROM u WHERE score >= 20 AND i >= 0.05 AND v >= 0.3)
      SELECT u.run_id, {_r("i")} AS overhead_idle_fraction, {_r("pipe")} AS pipeline_idle_fraction, score, CASE WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'moderate' ELSE 'low' END AS severity, coalesce(c, '') AS contributors
      FROM u LEFT JOIN (SELECT run_id, string_agg(name, ',' ORDER BY o DESC, n) AS c FROM w GROUP BY run_id) x ON x.run_id = u.run_id""",
    "extract_signals": f"""{_STEPS}, o AS (SELECT *, {_over["i"]} AS i, {_over["c"]} AS c, {_over["s"]} AS s FROM runs WHERE scope = 'run') SELECT run_id, concat_ws(',',
      {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(_SIGNALS))}) AS signals, {_r("i")} AS input_frac, {_r("c")} AS h2d_frac, {_r("s")} AS sync_frac, {_r("cv")}
      AS step_time_cv FROM o""",
    "union_sources": f"""WITH {SQL["ev"]}, {SQL["gs"]}, t AS (SELECT run_id, CASE WHEN k = 1 THEN 'dataloader_span' WHEN k = 2 THEN 'memcpy_span' WHEN k = 6 THEN
      'sync_wait' WHEN k = 7 THEN CASE WHEN win THEN 'profiler_window' ELSE 'shape_snapshot' END ELSE 'phase_span' END AS event_type, NULL::DOUBLE AS u FROM ev
      UNION ALL SELECT o_custkey % 50, unnest(['step_start', 'step_end']), NULL FROM orders UNION ALL SELECT run_id, 'gpu_sample', util FROM gs) SELECT run_id, event_type, count(*) AS n, count(u) AS n_util FROM t GROUP BY ALL""",
}
