"""Queries over the normalised event model, presets, thresholds and briefs, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.functions import first_dims
from gaugefleet.operators import briefs as B
from gaugefleet.operators import classify as C
from gaugefleet.operators import ir as I
from gaugefleet.operators import kernels as K
from gaugefleet.operators import presets as S
from gaugefleet.operators import reconcile as E
from gaugefleet.operators import traces as X
from gaugefleet.operators import trials as TR
from gaugefleet.plans import advice as A
from gaugefleet.plans import profiling as P
from gaugefleet.plans import telemetry as T
from gaugefleet.plans.shared import KERNEL_RUNS, Shared
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import SQL, gpu_samples, table, telemetry_events, written

_FAMILY = "CASE event_type WHEN 'click' THEN 'kernel' WHEN 'view' THEN 'distributed' WHEN 'purchase' THEN 'data_pipeline' WHEN 'signup' THEN 'cpu' ELSE 'memory' END"
_TYPE = "CASE event_type WHEN 'signup' THEN 'training_step' WHEN 'click' THEN 'cuda_kernel' WHEN 'view' THEN 'collective' ELSE 'other' END"
_STEP = "CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('step_', event_id % 9) END"


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id % 50 AS run_id", *columns)


def _ir(spark: SparkSession, d: str) -> DataFrame:
    return _events(
        spark, d, "event_id AS seq", f"{_FAMILY} AS event_family", f"{_TYPE} AS event_type", f"{_STEP} AS step_id", "bigint(floor(value * CASE WHEN event_type = 'signup' THEN 100000 ELSE 1000 END)) AS duration_ns",
        "CASE WHEN event_type = 'signup' THEN map('x', array(int(event_id % 3), 8)) END AS shapes",
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events of the model, some of them broken."""
    return _events(
        spark, d, "CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('e', event_id) END AS event_id", f"CASE WHEN event_id % 19 = 0 THEN 'odd' ELSE {_FAMILY} END AS event_family", f"{_TYPE} AS event_type", "'test' AS source", "event_id * 10 - CASE WHEN event_id % 23 = 0 THEN event_id * 20 ELSE 0 END AS ts_start_ns",
        "event_id * 10 + 5 AS ts_end_ns", "bigint(CASE WHEN event_id % 23 = 0 THEN event_id * 20 + 5 WHEN event_id % 29 = 0 THEN 4 ELSE 5 END) AS duration_ns", "CASE WHEN event_id % 3 = 0 THEN 'gpu0' END AS device_id", "CASE WHEN event_id % 2 = 0 THEN map('rank', '1') ELSE map('a', 'b') END AS attrs", "user_id % 51 AS parent",
    )


_VERSIONS = "CASE event_id % 7 WHEN 0 THEN '1.0.0' WHEN 1 THEN '2.0.0' WHEN 2 THEN '0.9.0' WHEN 3 THEN '0.8.0' WHEN 4 THEN '1.x.0' WHEN 5 THEN '0.1.0' END"
_MIGRATIONS = [("0.8.0", "0.9.0", {"unit": "'ms'"}), ("0.9.0", "1.0.0", {"unit": "concat(unit, '!')"})]
_NAME = "CASE event_id % 4 WHEN 0 THEN 'GPU Util' WHEN 1 THEN 'Memory used' WHEN 2 THEN 'loss' ELSE 'mm_kernel' END"


def _counters(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, f"{_NAME} AS name", "CASE WHEN event_id % 5 = 0 THEN 'C' ELSE 'X' END AS ph", "double(event_id) AS ts_us", "CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0D END AS dur_us", "CASE WHEN event_id % 3 = 0 THEN map('value', string(event_id), 'unit', CASE WHEN event_id % 6 = 0 THEN 'pct' ELSE '' END) ELSE map('a', 'b') END AS args")


def q_split_profiler_metrics(spark, d):
    events, metrics = I.split_profiler_metrics(_counters(spark, d))
    kept = events.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("event").alias("name"), F.lit("").alias("unit"), "n", F.lit(0.0).alias("total"))
    return kept.union(metrics.groupBy("run_id", "metric_name", "metric_unit").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def q_kernel_launch_attrs(spark, d):
    args = "CASE event_id % 3 WHEN 0 THEN map('Registers Per Thread', string(event_id % 99), 'Block X', '') WHEN 1 THEN map('regs_per_thread', string(event_id % 98), 'blockDim.x', '64') ELSE map('block_size', '256', 'registers_per_thread', '') END AS args"
    df = I.kernel_launch_attrs(_events(spark, d, "event_id", args))
    return df.select("event_id", *[F.col("launch_attrs")[c].alias(c) for c in ("registers_per_thread", "threads_per_block", "block_x")])


_OPS = "CASE event_id % 8 WHEN 0 THEN 'ncclAllReduce' WHEN 1 THEN 'Broadcast' WHEN 2 THEN 'reduce_scatter_x' WHEN 3 THEN 'all_gather' WHEN 4 THEN 'gather' WHEN 5 THEN 'scatter' WHEN 6 THEN 'send' ELSE 'ALL_REDUCE' END"
_STAGE = "CASE event_id % 7 WHEN 0 THEN 'next' WHEN 1 THEN 'Collate' WHEN 2 THEN 'transfer_ready' WHEN 3 THEN 'decode' WHEN 4 THEN 'transform' WHEN 5 THEN 'dataset_read' ELSE 'io' END"


def q_map_collectives(spark, d):
    df = I.map_collectives(_events(spark, d, f"{_OPS} AS collective_type", "event_id % 4 AS rank", "event_id * 10 AS ts_start_ns", "event_id * 10 + event_id % 9 - 4 AS ts_end_ns"))
    return df.select("run_id", "event_id", "collective_op", "event_family", "duration_ns")


def q_map_data_pipeline(spark, d):
    df = I.map_data_pipeline(_events(spark, d, f"{_STAGE} AS stage", "event_id * 10 AS ts_start_ns", "event_id * 10 + event_id % 9 - 4 AS ts_end_ns"))
    return df.select("run_id", "event_id", "event_type", "duration_ns")


def q_map_kernel_csv_to_ir(spark, d):
    return _rounded(I.map_kernel_csv_to_ir(P.tall(spark, d)).groupBy("run_id", "metric_name", "metric_unit").agg(F.count("*").alias("n"), F.max("value").alias("most")))


def q_validate_ir_records(spark, d):
    df = I.validate_ir_records(_records(spark, d), "event", "parent")
    return df.groupBy(F.array_join("failures", ",").alias("failures")).agg(F.count("*").alias("n"))


def q_schema_version_gate(spark, d):
    df = I.schema_version_gate(_events(spark, d, "event_id", f"{_VERSIONS} AS schema_version", "'us' AS unit"), _MIGRATIONS)
    return df.select("event_id", "schema_version", "unit", "route")


def q_ir_step_summary(spark, d):
    return I.ir_step_summary(_ir(spark, d))


def _ir_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    steps = written(I.ir_step_summary(_ir(spark, d)))
    return steps, I.ir_run_summary(steps, X.unpivot_nvml(gpu_samples(spark, d)))


def q_ir_run_summary(spark, d):
    return _rounded(_ir_runs(spark, d)[1])


def q_ir_step_labels(spark, d):
    return I.ir_step_labels(*_ir_runs(spark, d))


def q_trace_kernel_stats(spark, d):
    trace = _events(spark, d, "CASE WHEN event_type IN ('click', 'view') THEN 'Kernel' ELSE 'cpu' END AS cat", "value AS dur_us")
    return I.trace_kernel_stats(trace, trace.groupBy("run_id").agg((F.count("*") % 7).alias("n_steps")))


def q_infer_batch_dims(spark, d):
    batch, length = first_dims(F.col("shapes"))
    return telemetry_events(spark, d).where("shapes is not null").select("step_id", batch.cast("long").alias("batch_size"), length.cast("long").alias("sequence_length")).groupBy("batch_size", "sequence_length").agg(F.count("*").alias("n"))


def q_metric_status(spark, d):
    return _rounded(S.metric_bands(P._summary(spark, d)))


def q_metric_validation(spark, d):
    present = P.tall(spark, d).select("run_id", K.canonical_metric(F.col("metric_name")).alias("metric")).distinct().where("run_id % 3 > 0 or metric not like 'warp%'")
    return S.metric_validation(present).withColumn("missing", F.array_join("missing", ","))


def q_filter_metrics_for_arch(spark, d):
    arch = F.get(F.array(F.lit("sm_90"), F.lit("sm_120"), F.lit(None)), (F.col("run_id") % 3).cast("int"))
    return S.filter_metrics_for_arch(P.tall(spark, d).withColumn("arch", arch)).groupBy("run_id").agg(F.count("*").alias("n"))


_OVERRIDES = {"sm_90": {"input_bound_ratio": 0.3, "ncu_l1_hit_low_pct": 35.0}, "sm_75": {"fat_high_threshold": 60.0}}


def q_threshold_override_join(spark, d):
    df = S.threshold_override_join(P.q_gpu_alias_match(spark, d), _OVERRIDES)
    return df.select("run_id", *[F.col("thresholds")[t].alias(t) for t in ("input_bound_ratio", "ncu_l1_hit_low_pct", "fat_high_threshold")], "threshold_source", "thresholds_hash")


def q_tolerant_number(spark, d):
    from gaugefleet.functions import number

    text = _events(spark, d, "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN string(event_id) WHEN 2 THEN 'n/a' WHEN 3 THEN '1e2' END AS t")
    return text.groupBy(number(F.col("t")).isNull().alias("missing")).agg(F.count("*").alias("n"), F.coalesce(F.sum(number(F.col("t"))), F.lit(0.0)).alias("total"))


def q_shape_signature(spark, d):
    from gaugefleet.functions import shape_signature

    shapes = _events(spark, d, "event_id", "map('b', array(int(event_id % 3), 4), 'a', array(7)) AS shapes")
    return shapes.groupBy(shape_signature(F.col("shapes")).alias("signature")).agg(F.count("*").alias("n"))


def q_quality_aggregate(spark, d):
    repeats = table(spark, d, "orders").selectExpr("o_custkey % 40 AS config_id", "map('nan_count', o_orderkey % 3 * 1.0D, 'max_loss', o_totalprice, 'min_loss', o_totalprice, 'final_loss', o_totalprice / 7) AS quality")
    return _rounded(TR.quality_aggregate(repeats))


def q_run_brief(spark, d):
    shared = Shared(spark, d)
    runs, recommendations = shared.both(), shared.recommendations("telemetry")
    labels = shared.table("labels", lambda: C.classify_run(runs))
    diagnoses = shared.table("diagnoses", lambda: C.diagnose_run(C.rank_bottlenecks(labels), runs))
    brief = B.run_brief(diagnoses, runs, labels, recommendations)
    return _rounded(brief.withColumns({c: F.array_join(c, ",") for c in ("top_recommendations", "missing_data")}))


def q_kernel_brief(spark, d):
    shared = Shared(spark, d)
    runs, signals = shared.kernel_runs(), shared.signals("kernel")
    primary = shared.table("primary", lambda: E.primary_reconciled(E.reconcile_layers(E.kernel_layer(signals))))
    recommendations = shared.recommendations("kernel").withColumn("run_id", F.col("run_id") - KERNEL_RUNS)
    best = shared.table("opportunities", lambda: K.kernel_opportunity(K.roofline(K.runtime_share(shared.kernels()))))
    brief = B.kernel_brief(runs, K.classify_kernels_run(runs), primary, best, recommendations)
    return _rounded(brief.withColumns({c: F.array_join(c, ",") for c in ("top_kernels", "top_recommendations")}))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_IR = f"""ie AS (SELECT user_id % 50 AS run_id, event_id AS seq, {_FAMILY} AS fam, {_TYPE} AS typ, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'step_' || event_id % 9 END AS
      step_id, CAST(floor(value * CASE WHEN event_type = 'signup' THEN 100000 ELSE 1000 END) AS BIGINT) AS dur, CASE WHEN event_type = 'signup' THEN 'x:[' || event_id % 3 ||
      ', 8]' END AS sig FROM events),
    ist AS (SELECT run_id, step_id, coalesce(max(CASE WHEN typ = 'training_step' THEN dur END), 0) AS step_wall_time_ns, CAST(coalesce(sum(CASE WHEN fam = 'kernel' THEN
      dur END), 0) AS BIGINT) AS compute_time_ns, CAST(coalesce(sum(CASE WHEN fam = 'distributed' THEN dur END), 0) AS BIGINT) AS communication_time_ns,
      CAST(coalesce(sum(CASE WHEN fam = 'data_pipeline' THEN dur END), 0) AS BIGINT) AS data_pipeline_time_ns, max_by(sig, CASE WHEN sig IS NOT NULL THEN seq END) AS shape_signature FROM ie WHERE step_id <> '' GROUP BY ALL),
    ich AS (SELECT *, coalesce(shape_signature <> last_value(shape_signature IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING), false) AS changed, CASE WHEN step_wall_time_ns > 0 THEN step_wall_time_ns END AS wall FROM ist),
    ism AS (SELECT run_id AS rid, avg(util) AS u, avg(mem) AS m, max(used) / 100.0 AS p FROM gs GROUP BY run_id),
    irn AS (SELECT run_id, coalesce(count(wall) / (sum(wall) / 1e9), 0.0) AS throughput_steps_per_sec, coalesce(avg(wall), 0.0) AS step_time_avg_ns, coalesce(max(wall),
      0) AS step_time_max_ns, CASE WHEN count(shape_signature) >= 2 THEN count(CASE WHEN changed THEN 1 END) / (count(shape_signature) - 1) ELSE 0.0 END AS
      shape_volatility_ratio,
      CAST(sum(communication_time_ns) AS BIGINT) AS communication_time_ns, CAST(sum(data_pipeline_time_ns) AS BIGINT) AS data_pipeline_time_ns, CAST(sum(compute_time_ns)
      AS BIGINT) AS compute_time_ns, coalesce(any_value(u), 0.0) AS average_gpu_utilization_pct, coalesce(any_value(m), 0.0) AS average_memory_utilization_pct,
      coalesce(any_value(p), 0.0) AS memory_pressure_peak_ratio FROM ich LEFT JOIN ism ON rid = run_id GROUP BY run_id)"""
_ratio = lambda c: f"least(1.0, {c} / step_wall_time_ns)"
_in, _co, _cp = _ratio("data_pipeline_time_ns"), _ratio("communication_time_ns"), _ratio("compute_time_ns")
_SPLIT = f"WITH c AS (SELECT user_id % 50 AS run_id, event_id, {_NAME} AS name, event_id % 5 = 0 OR (event_id % 3 = 0 AND (event_id % 2 = 1 OR value = 0)) AS met FROM events)"
_FAIL = f"""WITH r AS (SELECT *, CASE WHEN event_id % 19 = 0 THEN 'odd' ELSE {_FAMILY} END AS fam FROM events) SELECT concat_ws(',', CASE WHEN event_id % 13 = 0 THEN
      'empty_event_id' END, CASE WHEN event_id % 23 = 0 AND event_id > 0 THEN 'negative_ts_start_ns' END, CASE WHEN fam = 'odd' THEN 'unknown_event_family' END, CASE WHEN
      event_id % 29 = 0 AND event_id % 23 <> 0 THEN 'wrong_duration' END,
    CASE WHEN fam = 'kernel' AND event_id % 3 <> 0 THEN 'kernel_without_device' END, CASE WHEN fam = 'distributed' AND event_id % 2 = 1 THEN 'distributed_without_rank'
      END, CASE WHEN user_id % 50 <> user_id % 51 THEN 'foreign_run' END) AS failures, count(*) AS n FROM r GROUP BY 1"""
_missing = lambda names: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT list_contains(held, '{m}') THEN '{m}' END" for m in names) + ")"
ORACLES = {
    "split_profiler_metrics": f"{_SPLIT} SELECT run_id, 'event' AS name, '' AS unit, count(*) AS n, 0.0::DOUBLE AS total FROM c WHERE NOT met GROUP BY run_id UNION ALL SELECT run_id, CASE WHEN name = 'GPU Util' THEN 'gpu_utilization' WHEN name = 'Memory used' THEN 'memory_value' ELSE name END, CASE WHEN event_id % 6 = 0 THEN 'pct' WHEN name = 'GPU Util' THEN 'percent' ELSE 'unknown' END, count(*), sum(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END)::DOUBLE FROM c WHERE met GROUP BY 1, 2, 3",
    "kernel_launch_attrs": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 99)::VARCHAR WHEN 1 THEN (event_id % 98)::VARCHAR END AS registers_per_thread, CASE WHEN event_id % 3 = 2 THEN '256' END AS threads_per_block, CASE WHEN event_id % 3 = 1 THEN '64' END AS block_x FROM events",
    "map_collectives": f"SELECT user_id % 50 AS run_id, 'dist_' || event_id % 4 || '_' || event_id * 10 || '_' || op AS event_id, op AS collective_op, 'distributed' AS event_family, greatest(event_id % 9 - 4, 0)::BIGINT AS duration_ns FROM (SELECT *, CASE event_id % 8 WHEN 0 THEN 'all_reduce' WHEN 1 THEN 'broadcast' WHEN 2 THEN 'reduce_scatter' WHEN 3 THEN 'all_gather' WHEN 4 THEN 'gather' WHEN 5 THEN 'scatter' WHEN 6 THEN 'unknown' ELSE 'all_reduce' END AS op FROM events)",
    "map_data_pipeline": f"SELECT user_id % 50 AS run_id, 'data_pipeline_' || {_STAGE} || '_' || event_id * 10 AS event_id, CASE event_id % 7 WHEN 0 THEN 'dataloader_wait' WHEN 1 THEN 'collate' WHEN 2 THEN 'batch_ready' WHEN 3 THEN 'decode' WHEN 4 THEN 'transform' WHEN 5 THEN 'dataset_read' ELSE 'data_pipeline_event' END AS event_type, greatest(event_id % 9 - 4, 0)::BIGINT AS duration_ns FROM events",
    "map_kernel_csv_to_ir": f"{P._PIVOT} SELECT run_id, 'kernel.' || metric AS metric_name, CASE WHEN metric LIKE '%\\_pct' ESCAPE '\\' OR metric LIKE 'warp\\_stall\\_%' ESCAPE '\\' THEN 'percent' WHEN metric LIKE '%\\_bytes' ESCAPE '\\' THEN 'bytes' ELSE 'count' END AS metric_unit, count(*) AS n, {_r('max(v)')} AS most FROM m GROUP BY run_id, metric",
    "validate_ir_records": _FAIL,
    "schema_version_gate": "SELECT event_id, CASE event_id % 7 WHEN 1 THEN '2.0.0' WHEN 4 THEN '1.x.0' WHEN 5 THEN '0.1.0' ELSE '1.0.0' END AS schema_version, CASE event_id % 7 WHEN 2 THEN 'us!' WHEN 3 THEN 'ms!' ELSE 'us' END AS unit, CASE event_id % 7 WHEN 1 THEN 'future' WHEN 2 THEN 'migrated' WHEN 3 THEN 'migrated' WHEN 4 THEN 'malformed' WHEN 5 THEN 'no_path' ELSE 'current' END AS route FROM events",
    "ir_step_summary": f"WITH {SQL['gs']}, {_IR} SELECT * FROM ist",
    "ir_run_summary": f"WITH {SQL['gs']}, {_IR} SELECT run_id, step_time_max_ns, communication_time_ns, data_pipeline_time_ns, compute_time_ns, {', '.join(_r(c) + f' AS {c}' for c in ('throughput_steps_per_sec', 'step_time_avg_ns', 'shape_volatility_ratio', 'average_gpu_utilization_pct', 'average_memory_utilization_pct', 'memory_pressure_peak_ratio'))} FROM irn",
    "ir_step_labels": f"""WITH {SQL['gs']}, {_IR}, w AS (SELECT * FROM ist WHERE step_wall_time_ns > 0) SELECT run_id, step_id AS target_id, 'input_bound' AS label,
      {_r(_in)} AS score FROM w WHERE {_in} >= 0.2 UNION ALL SELECT run_id, step_id, 'communication_bound', {_r(_co)} FROM w WHERE {_co} >= 0.15
      UNION ALL SELECT run_id, step_id, 'compute_bound', {_r(_cp)} FROM w WHERE {_cp} >= 0.6 AND {_in} < 0.1 AND {_co} < 0.1 UNION ALL SELECT run_id, run_id::VARCHAR,
      'memory_pressure', {_r('memory_pressure_peak_ratio')} FROM irn WHERE memory_pressure_peak_ratio >= 0.9 UNION ALL SELECT run_id, run_id::VARCHAR, 'shape_instability',
      {_r('shape_volatility_ratio')} FROM irn WHERE shape_volatility_ratio >= 0.3""",
    "trace_kernel_stats": f"""WITH t AS (SELECT user_id % 50 AS run_id, event_type IN ('click', 'view') AND value > 0 AS k, value FROM events), n AS (SELECT run_id AS
      rid, greatest(count(*) % 7, 1) AS steps FROM t GROUP BY 1), l AS (SELECT run_id, list_sort(list(value)) AS v FROM t WHERE k GROUP BY 1)
      SELECT run_id, len(v) AS kernel_count_total, {_r('len(v) / steps', 2)} AS kernel_count, {_r('v[len(v) // 2 + 1]', 3)} AS median_cuda_kernel_duration_us,
      {_r('len(list_filter(v, lambda x: x < 10)) / len(v)')} AS small_kernel_fraction FROM l JOIN n ON rid = run_id""",
    "infer_batch_dims": f"WITH {SQL['ev']} SELECT batch::BIGINT AS batch_size, 128::BIGINT AS sequence_length, count(*) AS n FROM ev WHERE batch IS NOT NULL GROUP BY 1",
    "metric_status": f"{P._SUMMARY}, t AS ("
    + " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {m} AS value, CASE WHEN {m} {'>=' if up else '<='} {good} THEN 'OK' WHEN {m} {'>=' if up else '<='} {bad} THEN '{'LOW' if up else 'ELEVATED'}' ELSE '{word}' END AS status FROM rs WHERE {m} IS NOT NULL" for m, (up, good, bad, word) in S.BANDS.items())
    + f") SELECT run_id, metric, {_r('value')} AS value, status FROM t",
    "metric_validation": f"{P._PIVOT}, h AS (SELECT run_id, list(DISTINCT metric) AS held FROM tall WHERE run_id % 3 > 0 OR metric NOT LIKE 'warp%' GROUP BY run_id), x AS ("
    + " UNION ALL ".join(f"SELECT run_id, '{k}' AS preset, {_missing(v)} AS missing FROM h" for k, v in S.PRESETS.items())
    + ") SELECT *, missing = '' AS complete FROM x",
    "filter_metrics_for_arch": f"{P._PIVOT}, s AS (SELECT run_id, metric FROM tall) SELECT run_id, count(*) AS n FROM s WHERE NOT (run_id % 3 = 1 AND metric = 'warp_stall_long_scoreboard') GROUP BY run_id",
    "threshold_override_join": f"WITH {P._ARCH} SELECT run_id, CASE WHEN arch = 'sm_90' THEN 0.3 ELSE 0.2 END::DOUBLE AS input_bound_ratio, CASE WHEN arch = 'sm_90' THEN 35.0 ELSE 40.0 END::DOUBLE AS ncu_l1_hit_low_pct, CASE WHEN arch = 'sm_75' THEN 60.0 ELSE 45.0 END::DOUBLE AS fat_high_threshold, CASE WHEN arch IN ('sm_90', 'sm_75') THEN 'defaults+arch_overrides' ELSE 'defaults' END AS threshold_source, "
    + "left(sha256(CASE arch " + " ".join(f"""WHEN '{k}' THEN '{json.dumps(S.THRESHOLDS | o, sort_keys=True)}'""" for k, o in _OVERRIDES.items()) + f""" ELSE
      '{json.dumps(S.THRESHOLDS, sort_keys=True)}' END), 12) AS thresholds_hash FROM (SELECT DISTINCT l_suppkey % 20 AS run_id FROM lineitem) JOIN dv ON n = run_id % 5""",
    "tolerant_number": "SELECT event_id % 5 NOT IN (1, 3) AS missing, count(*) AS n, coalesce(sum(CASE event_id % 5 WHEN 1 THEN event_id WHEN 3 THEN 100 END), 0)::DOUBLE AS total FROM events GROUP BY 1",
    "shape_signature": "SELECT 'a:[7]|b:[' || event_id % 3 || ', 4]' AS signature, count(*) AS n FROM events GROUP BY 1",
    "quality_aggregate": f"WITH q AS (SELECT o_custkey % 40 AS config_id, o_orderkey % 3 AS nan, o_totalprice AS p FROM orders) SELECT config_id, 'nan_count' AS metric, sum(nan)::DOUBLE AS value FROM q GROUP BY 1 UNION ALL SELECT config_id, 'max_loss', {_r('max(p)')} FROM q GROUP BY 1 UNION ALL SELECT config_id, 'min_loss', {_r('min(p)')} FROM q GROUP BY 1 UNION ALL SELECT config_id, 'final_loss', {_r('median(p / 7)')} FROM q GROUP BY 1",
    "run_brief": f"""{A._SQL}, ch AS (SELECT r.* FROM runs r LEFT JOIN (SELECT run_id AS rid FROM runs WHERE scope = 'steady' AND completed > 0) s ON rid = r.run_id WHERE r.scope = CASE WHEN rid IS NOT NULL THEN 'steady' ELSE 'run' END),
      fr AS (SELECT run_id AS frid, scope AS fsc, max(CASE WHEN label = 'input_bound' THEN score END) AS i, max(CASE WHEN label = 'copy_bound' THEN score END) AS c,
      max(CASE WHEN label = 'sync_bound' THEN score END) AS s FROM lab GROUP BY ALL), tr AS (SELECT run_id AS trid, string_agg(rec, ',' ORDER BY place) AS recs FROM od WHERE
      place <= 3 GROUP BY 1)
      SELECT ch.run_id, ch.scope, completed AS steps, user_facing_bottleneck, secondary_bottlenecks, confidence_score, CASE WHEN confidence_score >= 0.75 THEN 'high' WHEN
      confidence_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level, i AS input_bound_fraction, c AS copy_bound_fraction, s AS sync_bound_fraction, {_r("util")} AS
      average_gpu_utilization_pct, {_r("tput")} AS throughput_steps_per_sec,
        coalesce(recs, '') AS top_recommendations, concat_ws(',', CASE WHEN win = 0 THEN 'profiler' END, CASE WHEN util = 0 THEN 'gpu_samples' END) AS missing_data FROM
        ch JOIN diag ON diag.run_id = ch.run_id AND diag.scope = ch.scope LEFT JOIN fr ON frid = ch.run_id AND fsc = ch.scope LEFT JOIN tr ON trid = ch.run_id""",
    "kernel_brief": f"""{A._SQL}, op0 AS (SELECT ks.*, ar.*, coalesce(dram_throughput_pct, 0.0) AS d, coalesce(tensor_core_utilization_pct, 0.0) AS t,
      coalesce(issue_slot_utilization_pct, 0.0) AS i FROM ks JOIN dv ON n = run_id % 5 JOIN ar ON ar.arch = coalesce(dv.arch, 'sm_80')),
      op1 AS (SELECT *, d <> 0 OR t <> 0 OR i <> 0 AS known, CASE WHEN t > 5 THEN fp16 ELSE fp32 END AS peak, CASE WHEN t > 5 THEN t * fp16 ELSE i * fp32 END / 100.0 AS tf, d / 100.0 * bw AS abw FROM op0),
      op2 AS (SELECT *, CASE WHEN known AND CASE WHEN abw > 0 THEN {_r("tf / abw * 1000.0")} END < peak / bw * 1000.0 THEN 'memory_bound' END AS region, CASE WHEN known
      THEN {_r("tf / fp32 * 100.0", 2)} END AS kmfu, {_r("kernel_duration_us / sum(kernel_duration_us) OVER (PARTITION BY run_id) * 100.0", 2)} AS rs_pct FROM op1),
      op3 AS (SELECT run_id, kernel_name, {_r("coalesce(rs_pct / 100.0, 1.0) * CASE WHEN region = 'memory_bound' THEN 1.0 WHEN kmfu < 20 THEN 0.85 WHEN achieved_occupancy_pct > 0 AND achieved_occupancy_pct < 30 THEN 0.7 WHEN d > 60 THEN 0.65 ELSE 0.4 END * greatest(0.0, coalesce(1.0 - least(kmfu, 100.0) / 100.0, 1.0 - greatest(d, i) / 100.0 * 0.7))")}
      AS s FROM op2),
      tk AS (SELECT run_id AS tkid, string_agg(kernel_name, ',' ORDER BY place) AS names FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC,
      kernel_name) AS place FROM op3) WHERE place <= 5 GROUP BY 1), tr AS (SELECT run_id - {A.KERNEL_RUNS} AS trid, string_agg(rec, ',' ORDER BY place) AS recs FROM od WHERE
      place <= 3 AND run_id >= {A.KERNEL_RUNS} GROUP BY 1),
      pd AS (SELECT run_id AS pid, CASE WHEN list_contains(sig, 'uncoalesced_global_loads=true') THEN 'inefficient_global_memory_access' WHEN list_contains(sig,
      'occupancy_limited_by_registers=true') AND list_contains(sig, 'occupancy_good=false') THEN 'register_pressure' WHEN list_contains(sig, 'tensor_core_underutilized=true')
      THEN 'tensor_core_underutilization'
        WHEN list_contains(sig, 'memory_bandwidth_saturated=true') THEN 'memory_bandwidth_saturation' WHEN roofline_region = 'memory_bound' THEN 'roofline_memory_bound'
        WHEN list_contains(sig, 'warp_stall_is_sync=true') THEN 'excessive_synchronization' WHEN mfu_pct < 20 THEN 'roofline_low_mfu' END AS p FROM ksg),
      tl AS (SELECT run_id AS lid, label FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, rule_no) AS k FROM klab) WHERE k = 1)
      SELECT kr.run_id, coalesce(p, tl.label) AS primary_diagnosis, {", ".join(f"{_r(m)} AS {m}" for m in S.BANDS)}, CASE WHEN dominant_warp_stall <> 'unknown' THEN
      dominant_warp_stall END AS dominant_warp_stall, coalesce(names, '') AS top_kernels, coalesce(recs, '') AS top_recommendations FROM kr LEFT JOIN pd ON pid = kr.run_id
      LEFT JOIN tl ON lid = kr.run_id LEFT JOIN tk ON tkid = kr.run_id LEFT JOIN tr ON trid = kr.run_id""",
}
