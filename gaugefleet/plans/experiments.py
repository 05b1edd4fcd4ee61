"""Queries over trials, variants, traces, samples and evaluation rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.operators import traces as X
from gaugefleet.operators import trials as T
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import SQL, gpu_samples, table

BUCKET_US = 6 * 3600 * 1e6
_TRIALS = """SELECT concat(o_orderpriority, '-', o_orderkey % 40) AS job, o_custkey % 8 AS config, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 40, o_custkey % 8 ORDER BY o_orderkey) AS repeat,
    o_totalprice / 1000 AS throughput, o_custkey % 100 * 1.0D AS gpu_util, (o_orderkey % 93) / 100.0D AS memory_ratio, CASE WHEN o_totalprice > 0 THEN 1e6D / o_totalprice ELSE 0.0D END AS step_ms,
    CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS exit_code, 3 + o_orderkey % 50 AS step_count, o_orderkey % 89 <> 0 AS passed_guards,
    CASE o_orderstatus WHEN 'F' THEN 'input_bound' WHEN 'O' THEN 'copy_bound' ELSE 'sync_bound' END AS dominant_stall FROM {orders}"""


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_TRIALS, orders=table(spark, d, "orders"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return T.noise_band(T.guard_checks(T.with_baseline(T.repeat_aggregate(_trials(spark, d)))))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return T.repeat_aggregate(_trials(spark, d)).select("job", F.concat(F.lit("v"), F.col("config")).alias("variant"), "throughput")


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        """SELECT user_id AS run_id, double(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)) AS ts_us, CASE event_type WHEN 'signup' THEN 21600e6D ELSE value END AS dur_us,
             CASE event_type WHEN 'signup' THEN concat('ProfilerStep#', event_id) WHEN 'purchase' THEN 'forward' WHEN 'error' THEN 'DataLoader.__next__' WHEN 'click' THEN 'gemm_kernel' ELSE 'reduce_kernel' END AS name,
             CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'user_annotation' ELSE 'kernel' END AS cat FROM {events}""",
        events=table(spark, d, "events"),
    )


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return gpu_samples(spark, d).withColumn("temperature_c", F.col("utilization_mem_pct"))


def _eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT doc_id AS row_key, doc_id % 3 + 1 AS level, quality = 1 AS correct, n_chars / 5000 AS speedup FROM {labels} JOIN {documents} USING (doc_id)", labels=table(spark, d, "labels"), documents=table(spark, d, "documents"))


def q_repeat_aggregate(spark, d):
    return _rounded(T.repeat_aggregate(_trials(spark, d)), 6)


def q_guard_checks(spark, d):
    return _pairs(spark, d).select("job", "config", F.array_join("guard_failures", ",").alias("guard_failures"))


def q_noise_band(spark, d):
    return _rounded(_pairs(spark, d).select("job", "config", "throughput_delta", "noise_band", "confidence_label", "within_noise"), 6)


def q_race_screening(spark, d):
    return T.race_screening(_pairs(spark, d)).select("job", "config", F.col("place").cast("long").alias("place"), "decision")


def q_select_winner(spark, d):
    return T.select_winner(_pairs(spark, d))


def q_variant_ranking(spark, d):
    return _rounded(T.variant_ranking(_variants(spark, d)).drop("throughput"))


def q_variant_transitions(spark, d):
    return _rounded(T.variant_transitions(_variants(spark, d)))


def q_detect_steps(spark, d):
    return X.detect_steps(_trace(spark, d))


def q_trace_steps_range_join(spark, d):
    trace = _trace(spark, d)
    return _rounded(X.trace_steps_range_join(X.detect_steps(trace).where("end_us > start_us"), trace, BUCKET_US).drop("start_us", "end_us"))


def q_map_profiler_to_ir(spark, d):
    return X.map_profiler_to_ir(_trace(spark, d)).groupBy("run_id", "event_family", "event_type", "kernel_class").agg(F.count("*").alias("n"), F.max("ts_end_ns").alias("last_ns"))


def q_unpivot_nvml(spark, d):
    return _rounded(X.unpivot_nvml(_samples(spark, d)).groupBy("run_id", "metric_name", "metric_unit").agg(F.count("*").alias("n"), F.max("value").alias("most")))


def q_nvml_health_annotations(spark, d):
    return X.nvml_health_annotations(_samples(spark, d)).groupBy("run_id", "label").agg(F.count("*").alias("n"), F.max("score").alias("score"))


def q_stratified_quota(spark, d):
    return T.stratified_quota(_eval_rows(spark, d), 20, 7).select("row_key", "level", "correct")


def q_sample_deterministic(spark, d):
    return T.sample_deterministic(_eval_rows(spark, d), 50, 42).select("row_key", "level", "correct")


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_t = _TRIALS.replace("{orders}", "orders").replace("1.0D", "1.0::DOUBLE").replace("100.0D", "100.0::DOUBLE").replace("1e6D", "1e6").replace("0.0D", "0.0")
_REP = f"""WITH tr AS ({_t}), st AS (SELECT job, config, dominant_stall, count(*) AS n FROM tr GROUP BY ALL),
    sd AS (SELECT job AS j, config AS c, dominant_stall FROM (SELECT *, row_number() OVER (PARTITION BY job, config ORDER BY n DESC, dominant_stall) AS k FROM st) WHERE k = 1),
    rp AS (SELECT job, config, count(*) AS repeat_count, CAST(coalesce(min_by(exit_code, CASE WHEN exit_code <> 0 THEN repeat END), 0) AS BIGINT) AS exit_code,
      coalesce(median(CASE WHEN throughput > 0 THEN throughput END), 0.0) AS throughput,
      coalesce(median(CASE WHEN gpu_util > 0 THEN gpu_util END), 0.0) AS gpu_util, coalesce(median(CASE WHEN step_ms > 0 THEN step_ms END), 0.0) AS step_ms,
      max(memory_ratio) AS memory_ratio, min(step_count) AS step_count, bool_and(passed_guards) AS passed_guards,
      coalesce(stddev_samp(CASE WHEN throughput > 0 THEN throughput END), 0.0) AS throughput_stddev FROM tr GROUP BY job, config),
    re AS (SELECT rp.*, dominant_stall FROM rp JOIN sd ON j = job AND c = config)"""
_PAIRS = f"""{_REP}, pa AS (SELECT a.*, b.throughput AS bt, b.step_ms AS bs, b.repeat_count AS br, b.throughput_stddev AS bd FROM re a JOIN re b ON a.job = b.job AND b.config = 0 WHERE a.config <> 0),
    pb AS (SELECT *, concat_ws(',', CASE WHEN exit_code <> 0 THEN 'exit_code' END, CASE WHEN step_count < 3 THEN 'too_few_steps' END, CASE WHEN throughput <= 0 THEN
      'zero_throughput' END, CASE WHEN memory_ratio > 0.9 THEN 'memory' END, CASE WHEN bs > 0 AND step_ms > 0 AND (step_ms - bs) / bs > 0.1 THEN 'step_time_regression' END) AS
      guard_failures,
      CASE WHEN bt > 0 AND throughput > 0 THEN (throughput - bt) / bt ELSE 0.0 END AS delta, greatest(CASE WHEN repeat_count > 1 AND throughput > 0 THEN throughput_stddev
      / throughput ELSE 0.0 END, CASE WHEN br > 1 AND bt > 0 THEN bd / bt ELSE 0.0 END) AS band, least(repeat_count, br) AS n FROM pa),
    pc AS (SELECT *, CASE WHEN n < 2 THEN 'low' WHEN delta <= greatest(band, 0.08) THEN 'inconclusive' WHEN n >= 3 AND delta - band >= 0.08 THEN 'high' WHEN delta - band
      >= 0.04 THEN 'medium' ELSE 'low' END AS confidence_label, n > 1 AND delta > 0 AND delta <= band AS within_noise, guard_failures = '' AND passed_guards AS held, exit_code
      = 0 AND guard_failures = '' AND passed_guards AS fine FROM pb)"""
_VAR = f"{_REP}, va AS (SELECT job, 'v' || config AS variant, throughput FROM re)"
_TRACE = """WITH tc AS (SELECT user_id AS run_id, CAST(epoch_us(ts) AS DOUBLE) AS ts_us, CASE event_type WHEN 'signup' THEN 21600e6 ELSE value END AS dur_us, event_type, event_id FROM events),
    num AS (SELECT run_id, event_id AS step, ts_us AS start_us, ts_us + dur_us AS end_us FROM tc WHERE event_type = 'signup'),
    ua AS (SELECT * FROM tc WHERE event_type IN ('purchase', 'error') AND run_id NOT IN (SELECT run_id FROM num)),
    best AS (SELECT run_id, arg_max(event_type, (m, nm)) AS event_type FROM (SELECT run_id, event_type, CASE event_type WHEN 'purchase' THEN 'forward' ELSE
      'DataLoader.__next__' END AS nm, avg(dur_us) AS m FROM ua GROUP BY ALL) GROUP BY run_id),
    steps AS (SELECT * FROM num UNION ALL SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, dur_us), ts_us, ts_us + dur_us FROM ua JOIN best USING (run_id, event_type))"""
ORACLES = {
    "repeat_aggregate": f"{_REP} SELECT job, config, repeat_count, exit_code, {', '.join(_r(c, 6) + f' AS {c}' for c in ('throughput', 'gpu_util', 'step_ms', 'memory_ratio', 'throughput_stddev'))}, step_count, passed_guards, dominant_stall FROM re",
    "guard_checks": f"{_PAIRS} SELECT job, config, guard_failures FROM pc",
    "noise_band": f"{_PAIRS} SELECT job, config, {_r('delta', 6)} AS throughput_delta, {_r('band', 6)} AS noise_band, confidence_label, within_noise FROM pc",
    "race_screening": f"""{_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY (exit_code = 0)::INT DESC, held::INT DESC, delta DESC, throughput DESC,
      config) AS place, row_number() OVER (PARTITION BY job ORDER BY (fine AND throughput > 0)::INT DESC, (exit_code = 0)::INT DESC, held::INT DESC, delta DESC, throughput
      DESC, config) AS g FROM pc)
      SELECT job, config, place, CASE WHEN fine AND throughput > 0 AND g <= 2 THEN 'promoted' WHEN fine THEN 'slower' ELSE 'guard_failure' END AS decision FROM o""",
    "select_winner": f"{_PAIRS}, o AS (SELECT *, fine AND throughput > 0 AND delta >= 0.08 AND NOT within_noise AS v FROM pc) SELECT job, max_by(config, CASE WHEN v THEN throughput END) AS winner, count(CASE WHEN v THEN 1 END) AS promoted FROM o GROUP BY job",
    "variant_ranking": f"{_VAR} SELECT job, variant, row_number() OVER (PARTITION BY job ORDER BY throughput DESC, variant) AS place, {_r('throughput / nullif(min(throughput) OVER (PARTITION BY job), 0)', 2)} AS factor FROM va",
    "variant_transitions": f"{_VAR} SELECT job, fv AS from_variant, variant AS to_variant, {_r('throughput / nullif(ft, 0)', 2)} AS factor FROM (SELECT *, lag(variant) OVER w AS fv, lag(throughput) OVER w AS ft FROM va WINDOW w AS (PARTITION BY job ORDER BY throughput, variant)) WHERE fv IS NOT NULL",
    "detect_steps": f"{_TRACE} SELECT * FROM steps",
    "trace_steps_range_join": f"""{_TRACE}, s AS (SELECT * FROM steps WHERE end_us > start_us), j AS (SELECT s.run_id, s.step, e.event_type, e.dur_us, CAST(floor(e.dur_us
      * 1000) AS BIGINT) AS ns FROM s JOIN tc e ON e.run_id = s.run_id AND e.ts_us >= s.start_us AND e.ts_us + e.dur_us <= s.end_us + 1),
      g AS (SELECT run_id AS r, step AS p, max(CASE WHEN event_type = 'error' THEN ns END) AS dl, max(CASE WHEN event_type = 'purchase' THEN ns END) AS fw, count(CASE
      WHEN event_type IN ('click', 'view') THEN 1 END) AS kc, count(CASE WHEN event_type IN ('click', 'view') AND dur_us < 10 THEN 1 END) AS sk, median(CASE WHEN event_type IN
      ('click', 'view') THEN dur_us END) AS md FROM j GROUP BY ALL)
      SELECT run_id, step, coalesce(dl, 0) AS dataloader_ns, 0::BIGINT AS h2d_ns, coalesce(fw, 0) AS forward_ns, 0::BIGINT AS backward_ns, 0::BIGINT AS optimizer_ns,
      coalesce(kc, 0) AS kernel_count, coalesce(sk, 0) AS small_kernels, {_r('md')} AS median_kernel_us, CAST(floor((end_us - start_us) * 1000) AS BIGINT) AS wall_ns, CASE
      WHEN kc > 0 THEN {_r('sk / kc')} END AS small_kernel_fraction FROM s LEFT JOIN g ON r = run_id AND p = step""",
    "map_profiler_to_ir": """SELECT user_id AS run_id, CASE WHEN event_type IN ('click', 'view') THEN 'kernel' WHEN event_type = 'error' THEN 'data_pipeline' ELSE 'cpu'
      END AS event_family, CASE WHEN event_type IN ('click', 'view') THEN 'cuda_kernel' WHEN event_type = 'error' THEN 'dataloader_event' ELSE 'cpu_span' END AS event_type,
      CASE event_type WHEN 'click' THEN 'gemm' WHEN 'view' THEN 'reduction' END AS kernel_class, count(*) AS n, max(epoch_us(ts) * 1000 + CAST(trunc(CASE event_type WHEN
      'signup' THEN 21600e6 ELSE greatest(value, 0) END * 1000) AS BIGINT)) AS last_ns FROM events GROUP BY ALL""",
    "unpivot_nvml": f"""WITH {SQL["gs"]}, u AS (SELECT run_id, unnest(['gpu_utilization', 'memory_utilization', 'memory_used_bytes', 'memory_total_bytes',
      'temperature_c']) AS metric_name, unnest(['percent', 'percent', 'bytes', 'bytes', 'celsius']) AS metric_unit, unnest([util, mem, used, 100.0, mem]) AS value FROM gs)
      SELECT run_id, metric_name, metric_unit, count(*) AS n, {_r('max(value)')} AS most FROM u WHERE value IS NOT NULL GROUP BY ALL""",
    "nvml_health_annotations": f"""WITH {SQL["gs"]}, a AS (SELECT run_id, 'memory_pressure' AS label, {_r('used / 100.0')} AS score FROM gs WHERE used / 100.0 >= 0.9
      UNION ALL SELECT run_id, 'thermal_pressure', {_r('least(mem / 100.0, 1.0)')} FROM gs WHERE mem >= 85) SELECT run_id, label, count(*) AS n, max(score) AS score FROM a
      GROUP BY ALL""",
    "stratified_quota": "SELECT row_key, level, correct FROM (SELECT *, row_number() OVER (PARTITION BY level, correct ORDER BY row_key) AS n FROM (SELECT doc_id AS row_key, doc_id % 3 + 1 AS level, quality = 1 AS correct FROM labels JOIN documents USING (doc_id))) WHERE n <= CASE WHEN correct THEN 20 ELSE 7 END",
    "sample_deterministic": "SELECT doc_id AS row_key, doc_id % 3 + 1 AS level, quality = 1 AS correct FROM labels JOIN documents USING (doc_id) ORDER BY md5(doc_id || '|42'), doc_id LIMIT 50",
}
