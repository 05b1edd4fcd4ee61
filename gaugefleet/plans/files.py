"""Queries that write files from the driver tables into the shared folder and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet import sources as SO
from gaugefleet.operators import classify as C
from gaugefleet.operators import kernels as K
from gaugefleet.operators import steps as S
from gaugefleet.plans import experiments as X
from gaugefleet.plans import profiling as P
from gaugefleet.plans import telemetry as T
from gaugefleet.plans import texts as TX
from gaugefleet.plans.views import folder as _folder
from gaugefleet.plans.telemetry import _rounded
from gaugefleet.plans.views import SQL, gpu_samples, table, telemetry_events


def q_read_trace_jsonl(spark, d):
    """Step metrics of the events, written as JSON lines with broken lines between."""
    path = _folder(spark)
    events = telemetry_events(spark, d).withColumns({"event_id": F.format_string("%010d-%07d", "step_id", "seq"), "timestamp_ns": F.col("step_id").cast("long"), "run_id": F.col("run_id").cast("string")})
    lines = events.select(F.to_json(F.struct("event_id", "timestamp_ns", "run_id", "event_type", "step_id", "duration_ns", "payload")).alias("value"))
    lines.union(events.where("seq = 1").select(F.lit("{broken").alias("value"))).write.text(path)
    read = SO.read_trace_jsonl(spark, path).withColumns({"shapes": F.lit(None).cast("map<string,array<int>>"), "run_id": F.col("run_id").cast("long")})
    steps = S.step_metrics(read)
    return steps.groupBy("run_id").agg(F.count("*").alias("steps"), *[F.sum(c).alias(c) for c in ("step_wall_time_ns", "dataloader_wait_time_ns", "h2d_copy_time_ns", "kernel_count")])


def q_read_gpu_csv(spark, d):
    path = _folder(spark)
    samples = gpu_samples(spark, d).select("run_id", F.col("utilization_gpu_pct").alias("gpu_util"), F.concat(F.col("memory_used_bytes"), F.lit(" MiB")).alias("memory_used"))
    blank = F.col("gpu_util") < 20.0
    samples.withColumns({c: F.when(~blank, F.col(c)) for c in ("gpu_util", "memory_used")}).write.option("header", True).partitionBy("run_id").csv(path)
    got = SO.read_gpu_csv(spark, f"{path}/*")
    return _rounded(got.groupBy(F.replace("run_id", F.lit("run_id="), F.lit("")).alias("run")).agg(F.count("*").alias("n"), F.avg("utilization_gpu_pct").alias("util"), (F.max("memory_used_bytes") / SO.MIB).alias("memory")))


def q_read_kernel_csv(spark, d):
    """Quoted tables with a header in each file, of which the rows of a kernel stand together in their order."""
    path = _folder(spark)
    rows = P.tall(spark, d).repartition("run_id", "kernel_name").sortWithinPartitions("run_id", "kernel_name", "seq")
    rows = rows.select(F.concat_ws("|", "run_id", "kernel_name").alias("Kernel Name"), F.col("metric_name").alias("Metric Name"), F.col("value").cast("string").alias("Metric Value"))
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    got = SO.read_kernel_csv(spark, path).withColumn("run_id", F.lit(0))
    return _rounded(K.kernel_pivot(got).select("kernel_name", "dram_throughput_pct", "kernel_duration_us", "registers_per_thread", "shared_memory_per_block_bytes", "dominant_warp_stall"))


def q_read_chrome_trace(spark, d):
    """A trace for each run, several after each other in a file, as a file for each would be a file to list, open and commit for each run."""
    path = _folder(spark)
    event = F.struct("name", "cat", F.lit("X").alias("ph"), F.col("ts_us").alias("ts"), F.col("dur_us").alias("dur"), F.create_map(F.lit("run"), F.col("run_id").cast("string")).alias("args"))
    traces = X._trace(spark, d).groupBy("run_id").agg(F.collect_list(event).alias("traceEvents"))
    traces.select(F.to_json(F.struct("traceEvents")).alias("value")).write.text(path)
    got = SO.read_chrome_trace(spark, path)
    return _rounded(got.groupBy(F.col("args")["run"].alias("run"), "cat").agg(F.count("*").alias("n"), F.max("dur_us").alias("dur_us")))


def q_read_variants_manifest(spark, d):
    path = _folder(spark)
    rows = table(spark, d, "part").selectExpr("concat('v', p_partkey) AS variant", "CASE WHEN p_partkey % 7 > 0 THEN concat(p_partkey, '.csv') END AS ncu_csv", "CASE WHEN p_partkey % 11 = 0 THEN 'fast' ELSE string(p_size * 2.5D) END AS throughput_gflops")
    rows.write.option("header", True).csv(path)
    good, bad = SO.read_variants_manifest(spark, path)
    both = good.select("throughput", F.lit(0).alias("aside")).union(bad.select(F.lit(0.0).alias("throughput"), F.lit(1).alias("aside")))
    return _rounded(both.agg(F.count_if(F.col("aside") == 0).alias("variants"), F.sum("throughput").alias("total"), F.sum("aside").alias("set_aside")))


def q_read_eval_rows(spark, d):
    path = _folder(spark)
    table(spark, d, "labels").selectExpr("doc_id AS Kernel_Name", "doc_id % 3 + 1 AS Level_ID", "quality = 1 AS Correct").write.json(path)
    return SO.read_eval_rows(spark, path, "Kernel_Name long, Level_ID int, Correct boolean", 2).groupBy("Correct").agg(F.count("*").alias("n"))


def q_route_artifacts(spark, d):
    texts = TX.texts(spark, d, "ptx").union(TX.texts(spark, d, "cu")).select("path", "text")
    renamed = texts.select(F.regexp_replace("path", r"^(p\d*[02468])\.\w+$", "$1.txt").alias("path"), "text")
    more = table(spark, d, "part").selectExpr("concat('m', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.csv' ELSE '.log' END) AS path", "CASE WHEN p_partkey % 3 = 0 THEN 'Metric Name, metric value' ELSE 'plain' END AS text")
    return SO.route_artifacts(renamed.union(more)).groupBy("kind").agg(F.count("*").alias("n"))


def q_write_run_summary(spark, d):
    path = _folder(spark)
    runs = T._both(spark, d)
    SO.write_run_summary(SO.nested_summaries(runs, C.diagnose_run(C.rank_bottlenecks(C.classify_run(runs)), runs)), path)
    back = spark.read.parquet(path)
    field = lambda scope, c: F.get_json_object("summary", f"$.{scope}.{c}")
    return back.select("run_id", field("run", "primary_bottleneck").alias("run_primary"), field("steady", "primary_bottleneck").alias("steady_primary"), field("run", "completed_steps").cast("long").alias("completed_steps"))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}
_r = T._r
ORACLES = {
    "read_trace_jsonl": f"{T._STEPS} SELECT run_id, count(*) AS steps, CAST(sum(wall) AS BIGINT) AS step_wall_time_ns, CAST(sum(loader) AS BIGINT) AS dataloader_wait_time_ns, CAST(sum(h2d) AS BIGINT) AS h2d_copy_time_ns, CAST(sum(kc) AS BIGINT) AS kernel_count FROM steps GROUP BY run_id",
    "read_gpu_csv": f"WITH {SQL['gs']} SELECT run_id::VARCHAR AS run, count(*) AS n, {_r('avg(util)')} AS util, {_r('max(used)')} AS memory FROM gs WHERE util >= 20 GROUP BY 1",
    "read_kernel_csv": f"{P._PIVOT} SELECT run_id || '|' || kernel_name AS kernel_name, {', '.join(f'{_r(c)} AS {c}' for c in ('dram_throughput_pct', 'kernel_duration_us'))}, registers_per_thread, shared_memory_per_block_bytes, dominant_warp_stall FROM ks",
    "read_chrome_trace": "SELECT user_id::VARCHAR AS run, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'user_annotation' ELSE 'kernel' END AS cat, count(*) AS n, " + _r("max(CASE event_type WHEN 'signup' THEN 21600e6 ELSE value END)") + " AS dur_us FROM events GROUP BY 1, 2",
    "read_variants_manifest": f"SELECT count(*) AS variants, {_r('sum(p_size * 2.5::DOUBLE)')} AS total, (SELECT count(*) FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0) AS set_aside FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0",
    "read_eval_rows": """SELECT quality = 1 AS "Correct", count(*) AS n FROM labels WHERE doc_id % 3 = 1 GROUP BY 1""",
    "route_artifacts": "SELECT kind, count(*) AS n FROM (SELECT 'ptx' AS kind FROM part UNION ALL SELECT 'cuda_source' FROM part UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'ncu' ELSE 'unknown' END FROM part) GROUP BY 1",
    "write_run_summary": f"{T._STEPS} SELECT a.run_id, a.primary_bottleneck AS run_primary, b.primary_bottleneck AS steady_primary, r.completed AS completed_steps FROM diag a LEFT JOIN diag b ON b.run_id = a.run_id AND b.scope = 'steady' JOIN runs r ON r.run_id = a.run_id AND r.scope = 'run' WHERE a.scope = 'run'",
}
