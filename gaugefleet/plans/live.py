"""Streaming queries over the events table, run over all that is there, and the batch SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet import streaming as SM
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import SQL, table
from gaugefleet.plans.views import folder as _folder


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, be it one file or a folder of parts (a pattern names either)."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Device samples: three devices in each run."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    run = F.col("user_id") % 50
    return _stream(spark, d).select(
        run.alias("run_id"), (F.col("event_id") % 3).cast("int").alias("gpu_id"), "ts", (k * (1 + run % 4) / 4).alias("utilization_gpu_pct"), (k * 0.7 + (run % 5) * 6).alias("memory_used_bytes"),
        F.lit(100.0).alias("memory_total_bytes"), k.alias("temperature_c"),
    )


#: Ten events in a row are a step, of which the last is its end; fifty steps in a row belong to one run.
_RUN, _K = "event_id DIV 500 % 50", "get_json_object(props, '$.k')"
_TYPE = "CASE WHEN event_id % 10 = 9 THEN 'step_end' ELSE CASE event_type WHEN 'click' THEN 'dataloader_span' WHEN 'view' THEN 'memcpy_span' WHEN 'purchase' THEN 'sync_wait' WHEN 'signup' THEN 'phase_span' ELSE 'gpu_sample' END END"
_DURATION = "CASE WHEN event_id % 10 = 9 THEN 20000 + bigint(value * 10000) ELSE bigint(value * 1000) END"
_PAYLOAD = f"""CASE WHEN event_id % 10 = 9 THEN map('status', CASE WHEN event_id % 70 = 69 THEN 'error' ELSE 'ok' END) ELSE CASE event_type
  WHEN 'click' THEN map('stage', 'next') WHEN 'view' THEN map('copy_kind', CASE WHEN event_id % 3 = 0 THEN 'd2h' ELSE 'h2d' END) WHEN 'signup' THEN map('phase_name', 'forward')
  WHEN 'error' THEN map('utilization_gpu_pct', {_K}, 'memory_used_bytes', {_K}, 'memory_total_bytes', '100') END END"""


def _events(df: DataFrame) -> DataFrame:
    return df.selectExpr(f"{_RUN} AS run_id", "event_id AS seq", "string(event_id) AS event_id", "ts", f"{_TYPE} AS event_type", "event_id DIV 10 AS step_id", f"{_DURATION} AS duration_ns", f"{_PAYLOAD} AS payload")


def _markers(spark: SparkSession, d: str) -> DataFrame:
    """Two events in a row are the markers of a span; every seventh span is never ended, some markers come twice."""
    twice = _stream(spark, d).where("event_id % 14 <> 13").withColumn("__n", F.explode(F.when(F.col("event_id") % 22 < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.selectExpr(f"{_RUN} AS run_id", "string(event_id DIV 2) AS span_id", "ts", "CASE WHEN event_id % 2 = 1 THEN 1 + bigint(value * 1000) ELSE 0 END AS duration_ns")


def _time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def q_stream_ingest(spark, d):
    """The events as lines of two sets of files, of which the second is added after a first call; every third event stands there twice, and some lines are broken."""
    path, source = _folder(spark), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    half = source.agg(F.expr("max(event_id) DIV 2 AS half"))
    lines = _events(source.crossJoin(F.broadcast(half)).where("event_id <= half")), _events(source.crossJoin(F.broadcast(half)).where("event_id > half"))
    for n, events in enumerate(lines):
        times = F.when(F.col("seq") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        text = events.withColumns({"timestamp_ns": F.unix_micros("ts") * 1000, "__n": F.explode(times)}).select("seq", F.to_json(F.struct("run_id", "event_id", "event_type", "step_id", "duration_ns", "payload", "timestamp_ns")).alias("value"))
        broken = F.when(F.col("seq") % 50 == 7, F.lit('{"event_id": ')).when(F.col("seq") % 50 == 8, F.lit('{"event_id": "x", "run_id": "1"}')).otherwise(F.col("value"))
        text.select(broken.alias("value")).write.text(f"{path}/in/day={n}")
        events, aside = SM.ingest_traces(spark, f"{path}/in/*", f"{path}/taken", "60 days")
    counts = events.groupBy("event_type", F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    return counts.union(aside.groupBy(F.lit("aside"), F.lit(-1).cast("long")).agg(F.count("*"), F.lit(0).cast("long")))


def q_stream_step_metrics(spark, d):
    path = _folder(spark)
    SM.collect_partials(_events(_stream(spark, d)), path)
    return _rounded(SM.step_metrics_so_far(spark, path).drop("shape_signature", "batch_size", "kernel_count", "profiler_windows_exported", "median_cuda_kernel_duration_us", "small_kernel_fraction"))


def q_stream_run_sessions(spark, d):
    path = _folder(spark)
    SM.collect_partials(_events(_stream(spark, d)), path, "15 minutes")
    sessions = _time(SM.open_and_closed_sessions(spark, path, "1 day"), "start", "end")
    return _rounded(sessions.drop("profiler_windows_exported", "kernel_count_per_step", "median_cuda_kernel_duration_us", "small_kernel_fraction", "shape_volatility_ratio"))


def _windows(spark: SparkSession, d: str, *spans: str) -> DataFrame:
    return _rounded(_time(SM.run_to_table(SM.stream_gpu_windows(_samples(spark, d), *spans, delay="1 day"), _folder(spark)), "start"))


def q_stream_gpu_windows(spark, d):
    return _windows(spark, d, "6 hours")


def q_stream_gpu_sliding(spark, d):
    """Windows of six hours that begin every two hours."""
    return _windows(spark, d, "6 hours", "2 hours")


def q_stream_span_pairing(spark, d):
    return _time(SM.run_to_table(SM.stream_span_pairing(_markers(spark, d), "5 minutes", "1 day"), _folder(spark)), "start", "end")


def q_stream_health_alerts(spark, d):
    alerts = SM.run_to_table(SM.stream_health_alerts(_samples(spark, d)), _folder(spark))
    return alerts.groupBy("run_id", "label").agg(F.count("*").alias("n"))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}
_MARK = "(SELECT max(ts) FROM events) - INTERVAL 1 DAY"  # what the watermark has not passed is held back
_EV = """WITH e AS (SELECT event_id, event_id // 500 % 50 AS run_id, event_id // 10 AS step_id, ts, value, event_id % 10 = 9 AS fin, event_type AS t, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN event_id % 10 = 9 THEN 20000 + CAST(trunc(value * 10000) AS BIGINT) ELSE CAST(trunc(value * 1000) AS BIGINT) END AS d FROM events)"""


def _step_sql(source: str, *by: str) -> str:
    """Steps of the events of a table; the only span of a phase that counts is before the step's end, as the end is its last event."""
    keys = ", ".join(("run_id", "step_id", *by))
    return f"""SELECT {keys}, coalesce(max(CASE WHEN fin THEN CASE WHEN event_id % 70 = 69 THEN 'error' ELSE 'ok' END END), 'unknown') AS status, CAST(coalesce(max(CASE WHEN fin THEN d END), 0) AS BIGINT) AS wall,
      CAST(coalesce(sum(CASE WHEN NOT fin AND t = 'click' THEN d END), 0) AS BIGINT) AS loader, CAST(coalesce(sum(CASE WHEN NOT fin AND t = 'view' AND event_id % 3 > 0 THEN d END), 0) AS BIGINT) AS h2d,
      CAST(coalesce(sum(CASE WHEN NOT fin AND t = 'purchase' THEN d END), 0) AS BIGINT) AS sync, CAST(coalesce(max(CASE WHEN NOT fin AND t = 'signup' THEN d END), 0) AS BIGINT) AS fwd, bool_or(fin) AS ended
      FROM {source} GROUP BY {keys}"""


_SESSIONS = f"""{_EV}, f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 15 MINUTES THEN 0 ELSE 1 END AS fresh FROM e), g AS
      (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f),
    b AS (SELECT run_id, s, min(ts) AS lo, max(ts) + INTERVAL 15 MINUTES AS hi, count(*) AS events FROM g GROUP BY run_id, s), st AS ({_step_sql("g", "s")}),
    r AS (SELECT run_id, s, count(CASE WHEN ok THEN 1 END) AS completed, coalesce(count(CASE WHEN status = 'ok' THEN 1 END) / (nullif(sum(CASE WHEN ok THEN wall END), 0)
      / 1e9), 0.0) AS tput, coalesce(avg(CASE WHEN ok THEN wall END), 0.0) AS mean,
        coalesce(max(CASE WHEN ok THEN wall END), 0) AS longest, coalesce(stddev_pop(CASE WHEN ok THEN wall END) / avg(CASE WHEN ok THEN wall END), 0.0) AS cv,
        coalesce(avg(CASE WHEN ok THEN least(1.0, loader / wall::DOUBLE) END), 0.0) AS ir, coalesce(avg(CASE WHEN ok THEN least(1.0, h2d / wall::DOUBLE) END), 0.0) AS cr,
        coalesce(avg(CASE WHEN ok THEN least(1.0, sync / wall::DOUBLE) END), 0.0) AS sr,
        CASE WHEN greatest(sum(loader), sum(h2d), sum(sync)) <= 0 THEN CASE WHEN sum(fwd) > 0 THEN 'compute_bound' ELSE 'unknown' END
          WHEN sum(loader) >= sum(h2d) AND sum(loader) >= sum(sync) THEN 'input_bound' WHEN sum(h2d) >= sum(sync) THEN 'copy_bound' ELSE 'sync_bound' END AS stall
      FROM (SELECT *, status = 'ok' AND wall > 0 AS ok FROM st) GROUP BY run_id, s),
    p AS (SELECT run_id, s, avg(k) AS util, max(k) / 100.0 AS peak, CASE WHEN count(k) >= 2 THEN max(k) - min(k) ELSE 0.0 END AS spread FROM g WHERE NOT fin AND t = 'error' GROUP BY run_id, s)"""
_text = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _window_sql(starts: str) -> str:
    return f"""WITH s AS (SELECT user_id % 50 AS run_id, CAST(event_id % 3 AS BIGINT) AS gpu_id, ts, k * (1 + user_id % 50 % 4) / 4 AS util, (k * 0.7 + (user_id % 50 % 5)
      * 6) / 100.0 AS m FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
      w AS (SELECT *, {starts} AS b FROM s)
      SELECT run_id, gpu_id, {_text("b")} AS start, count(*) AS n, {_r("avg(util)")} AS avg_util, {_r("max(util) - min(util)")} AS spread, {_r("max(m)")} AS memory_ratio
      FROM w WHERE b + INTERVAL 6 HOURS <= {_MARK} GROUP BY run_id, gpu_id, b"""


ORACLES = {
    "stream_ingest": """WITH e AS (SELECT *, CASE WHEN event_id % 10 = 9 THEN 'step_end' ELSE CASE event_type WHEN 'click' THEN 'dataloader_span' WHEN 'view' THEN
      'memcpy_span' WHEN 'purchase' THEN 'sync_wait' WHEN 'signup' THEN 'phase_span' ELSE 'gpu_sample' END END AS typ FROM events)
      SELECT typ AS event_type, event_id // 500 % 50 AS run_id, count(*) AS n, count(*) AS ids FROM e WHERE event_id % 50 NOT IN (7, 8) GROUP BY 1, 2
      UNION ALL SELECT 'aside', -1, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT), 0 FROM e WHERE event_id % 50 IN (7, 8) HAVING count(*) > 0""",
    "stream_step_metrics": f"""{_EV} SELECT run_id, step_id, status, wall AS step_wall_time_ns, loader AS dataloader_wait_time_ns, h2d AS h2d_copy_time_ns, sync AS
      sync_wait_time_ns, fwd AS forward_time_ns, 0 AS backward_time_ns, 0 AS optimizer_time_ns,
      {_r("CASE WHEN wall > 0 THEN least(1.0, fwd / wall::DOUBLE) ELSE 0.0 END")} AS gpu_active_fraction_proxy FROM ({_step_sql("e")})""",
    "stream_run_sessions": f"""{_SESSIONS} SELECT b.run_id, {_text("lo")} AS start, {_text("hi")} AS "end", events, hi <= {_MARK} AS closed, completed AS completed_steps,
      {_r("tput")} AS throughput_steps_per_sec, {_r("mean")} AS step_time_avg_ns, longest AS step_time_max_ns, {_r("cv")} AS step_time_cv,
      stall AS dominant_stall_type, {_r("ir")} AS input_bound_ratio, {_r("cr")} AS copy_bound_ratio, {_r("sr")} AS sync_bound_ratio, {_r("coalesce(util, 0.0)")} AS
      average_gpu_utilization_pct, 0.0::DOUBLE AS average_memory_utilization_pct, {_r("coalesce(peak, 0.0)")} AS memory_pressure_peak_ratio,
      {_r("coalesce(spread, 0.0)")} AS utilization_instability_pct FROM b LEFT JOIN r ON r.run_id = b.run_id AND r.s = b.s LEFT JOIN p ON p.run_id = b.run_id AND p.s = b.s""",
    "stream_span_pairing": f"""WITH m AS (SELECT event_id // 500 % 50 AS run_id, event_id // 2 AS span, event_id % 2 = 1 AS fin, epoch_us(ts) AS us, ts, 1 + CAST(trunc(value * 1000) AS BIGINT) AS d FROM events WHERE event_id % 14 <> 13),
      x AS (SELECT coalesce(b.run_id, f.run_id) AS run_id, coalesce(b.span, f.span) AS span, b.ts AS s, f.ts AS f, b.us AS bu, f.us AS fu, f.d AS d, (SELECT max(us) //
      1000 FROM m) - 86400000 AS mark FROM (SELECT * FROM m WHERE NOT fin) b FULL JOIN (SELECT * FROM m WHERE fin) f ON b.run_id = f.run_id AND b.span = f.span)
      SELECT run_id, span::VARCHAR AS span_id, {_text("s")} AS start, {_text("f")} AS "end", d AS duration_ns, true AS closed FROM x WHERE fu - bu <= 300000000
      UNION ALL SELECT run_id, span::VARCHAR, {_text("s")}, NULL, NULL, false FROM x WHERE fu - bu > 300000000 OR (fu IS NULL AND (bu + 300000000) // 1000 < mark)
      UNION ALL SELECT run_id, span::VARCHAR, NULL, {_text("f")}, d, true FROM x WHERE (bu IS NULL OR fu - bu > 300000000) AND (fu + 300000000) // 1000 < mark""",
    "stream_gpu_windows": _window_sql("time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')"),
    "stream_gpu_sliding": _window_sql("unnest([time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOURS * i FOR i IN [0, 1, 2]])"),
    "stream_health_alerts": f"""WITH {SQL["gs"]} SELECT run_id, label, count(*) AS n FROM (SELECT run_id, 'memory_pressure' AS label FROM gs WHERE used / 100.0 >= 0.9
      UNION ALL SELECT run_id, 'thermal_pressure' FROM gs WHERE mem >= 85) GROUP BY ALL""",
}
