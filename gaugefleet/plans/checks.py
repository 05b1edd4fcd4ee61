"""Queries over loss quality, timing runs and bundles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.operators import quality as Q
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import table

_LOSS = "SELECT o_custkey % 50 AS run_id, o_orderkey AS step_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 223 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice / 100000 END AS loss FROM "
_BENCH = "SELECT o_custkey % 30 AS binary, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS iteration, o_totalprice / 1000 AS wall_ms, CASE WHEN o_custkey % 30 % 3 > 0 THEN o_totalprice / 7 END AS event_us FROM "
_ARTIFACT = "CASE event_type WHEN 'click' THEN 'metadata' WHEN 'view' THEN 'run_config' WHEN 'purchase' THEN 'gpu_metrics' WHEN 'signup' THEN 'logs' ELSE 'raw_trace' END"
_SOURCE = "CASE event_type WHEN 'click' THEN 'profiler_trace' WHEN 'purchase' THEN 'raw_trace' WHEN 'error' THEN 'derived_summary' ELSE 'other' END"


def _sql(spark: SparkSession, d: str, query: str, name: str) -> DataFrame:
    return spark.sql(query + "{t}", t=table(spark, d, name))


def _events(spark: SparkSession, d: str, column: str, name: str) -> DataFrame:
    return _sql(spark, d, f"SELECT user_id * 100 + event_id % 100 AS run_id, {column} AS {name} FROM ", "events")


def _gate(spark: SparkSession, d: str) -> DataFrame:
    runs = Q.loss_quality(_sql(spark, d, _LOSS, "orders")).withColumn("pair_id", F.floor(F.col("run_id") / 2).cast("long"))
    base = runs.where("run_id % 2 = 0").select("pair_id", F.col("final_loss").alias("b_final_loss"))
    return Q.quality_gate(runs.where("run_id % 2 = 1").join(base, "pair_id"))


def _timing(spark: SparkSession, d: str) -> DataFrame:
    return Q.bench_timing_stats(_sql(spark, d, _BENCH, "orders"))


def q_loss_quality(spark, d):
    return _rounded(Q.loss_quality(_sql(spark, d, _LOSS, "orders")), 6)


def q_quality_gate(spark, d):
    return _gate(spark, d).select("pair_id", F.array_join("quality_failures", ",").alias("quality_failures"))


def q_bench_timing_stats(spark, d):
    return _timing(spark, d)


def q_speedup_basis(spark, d):
    t = _timing(spark, d).withColumn("pair_id", F.floor(F.col("binary") / 2).cast("long"))
    return Q.speedup_basis(t.where("binary % 2 = 0"), t.where("binary % 2 = 1"))


def q_bundle_completeness(spark, d):
    return Q.bundle_completeness(_events(spark, d, _ARTIFACT, "artifact")).withColumns({c: F.array_join(c, ",") for c in ("missing_required", "missing_recommended")})


def q_source_precedence(spark, d):
    return Q.source_precedence(_events(spark, d, _SOURCE, "source"))


def q_orphan_step_refs(spark, d):
    metrics = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("run_id"), F.col("l_orderkey").alias("step_id"), "l_linenumber")
    events = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("step_id"))
    return Q.orphan_step_refs(metrics, events).groupBy("run_id").agg(F.count("*").alias("n"))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}
_LQ = f"""WITH l AS ({_LOSS} orders), g AS (SELECT *, CASE WHEN NOT isnan(loss) AND NOT isinf(loss) THEN loss END AS good FROM l),
    lq AS (SELECT run_id, count(good) AS loss_count, count(CASE WHEN isnan(loss) THEN 1 END) AS nan_count, count(CASE WHEN isinf(loss) THEN 1 END) AS inf_count,
      arg_min(good, step_id) FILTER (good IS NOT NULL) AS initial_loss, arg_max(good, step_id) FILTER (good IS NOT NULL) AS final_loss, min(good) AS min_loss, max(good) AS
      max_loss FROM g GROUP BY run_id)"""
_BT = f"""WITH b AS ({_BENCH} orders), bt AS (SELECT "binary", {_r('median(wall_ms)', 3)} AS median_ms, {_r('min(wall_ms)', 3)} AS min_ms, {_r('max(wall_ms)', 3)} AS
      max_ms, {_r('coalesce(stddev_samp(wall_ms), 0.0)', 3)} AS stdev_ms, {_r('median(event_us)')} AS kernel_event_us, count(*) AS runs FROM b WHERE iteration >= 2 GROUP BY
      "binary")"""
_EV = "SELECT user_id * 100 + event_id % 100 AS run_id, {c} AS a FROM events"
_lack = lambda names: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT list_contains(h, '{n}') THEN '{n}' END" for n in names) + ")"
ORACLES = {
    "loss_quality": f"{_LQ} SELECT run_id, loss_count, nan_count, inf_count, {', '.join(_r(c, 6) + f' AS {c}' for c in ('initial_loss', 'final_loss', 'min_loss', 'max_loss'))}, {_r('final_loss - initial_loss', 6)} AS loss_slope FROM lq",
    "quality_gate": f"{_LQ} SELECT a.run_id // 2 AS pair_id, concat_ws(',', CASE WHEN a.nan_count > 0 THEN 'nan_loss' END, CASE WHEN a.inf_count > 0 THEN 'inf_loss' END, CASE WHEN b.final_loss > 0 AND a.final_loss > b.final_loss * 1.05 THEN 'final_loss' END, CASE WHEN a.initial_loss > 0 AND a.final_loss > a.initial_loss * 1.5 THEN 'divergence' END) AS quality_failures FROM lq a JOIN lq b ON a.run_id // 2 = b.run_id // 2 AND b.run_id % 2 = 0 WHERE a.run_id % 2 = 1",
    "bench_timing_stats": f"{_BT} SELECT * FROM bt",
    "speedup_basis": f"""{_BT} SELECT a."binary" // 2 AS pair_id, coalesce(CASE WHEN a.kernel_event_us > 0 THEN {_r('b.kernel_event_us / a.kernel_event_us')} END, CASE
      WHEN a.median_ms > 0 THEN {_r('b.median_ms / a.median_ms')} END) AS speedup_x, CASE WHEN a.kernel_event_us > 0 AND b.kernel_event_us IS NOT NULL THEN 'cuda_event' ELSE
      'wall_clock' END AS basis FROM bt a JOIN bt b ON a."binary" // 2 = b."binary" // 2 AND b."binary" % 2 = 0 WHERE a."binary" % 2 = 1""",
    "bundle_completeness": f"WITH e AS ({_EV.format(c=_ARTIFACT)}), h AS (SELECT run_id, list(DISTINCT a) AS h FROM e GROUP BY run_id) SELECT run_id, {_lack(Q.REQUIRED)} AS missing_required, {_lack(Q.RECOMMENDED)} AS missing_recommended, list_contains(h, 'raw_trace') AS diagnostic_ready, {_lack(Q.REQUIRED)} <> '' OR NOT list_contains(h, 'raw_trace') AS limited FROM h",
    "source_precedence": f"WITH e AS ({_EV.format(c=_SOURCE)}), r AS (SELECT run_id, min(CASE a WHEN 'derived_summary' THEN 0 WHEN 'raw_trace' THEN 1 WHEN 'profiler_trace' THEN 2 END) AS k FROM e GROUP BY run_id) SELECT run_id, CASE k WHEN 0 THEN 'derived_summary' WHEN 1 THEN 'raw_trace' ELSE 'profiler_trace' END AS source FROM r WHERE k IS NOT NULL",
    "orphan_step_refs": "SELECT l_suppkey % 50 AS run_id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 50 = l_suppkey % 50 AND o_orderkey = l_orderkey) GROUP BY 1",
}
