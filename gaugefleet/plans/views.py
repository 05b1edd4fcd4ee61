"""Telemetry-shaped views over the driver tables, so that every query has data at any scale."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder; on one machine without one a temporary folder, removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gaugefleet-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/gaugefleet-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A frame written to the shared folder and read back, where more than one part of a plan builds on it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def telemetry_events(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """Event stream: run_id, step_id, seq, event_type, duration_ns, payload, shapes; of the runs with ids ``below``, if given.

    A step is of one run, so other runs go before the lines of a step are numbered, past which no filter on the run is pushed.
    """
    orders = table(spark, sf_dir, "orders")
    if below is not None:
        orders = orders.where(F.col("o_custkey") % 50 < below)
    lines = spark.sql(
        f"""
        SELECT o_custkey % 50 AS run_id, l_orderkey AS step_id, l_linenumber AS k, l_quantity AS q, l_returnflag, l_linestatus, l_partkey, l_discount,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS seq
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        """,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=orders,
    )
    span = F.expr(
        """CASE k WHEN 1 THEN bigint(q * 500 * (run_id % 5)) WHEN 2 THEN bigint(q * 400 * (run_id % 4)) WHEN 6 THEN bigint(q * 200 * (run_id % 3))
                  WHEN 7 THEN 0 ELSE bigint(q * 1000) END"""
    )
    kind = F.expr(
        """CASE k WHEN 1 THEN 'dataloader_span' WHEN 2 THEN 'memcpy_span' WHEN 6 THEN 'sync_wait' WHEN 7 THEN
           CASE WHEN l_linestatus = 'O' THEN 'shape_snapshot' ELSE 'profiler_window' END ELSE 'phase_span' END"""
    )
    payload = F.expr(
        """CASE k WHEN 1 THEN map('stage', 'next')
                  WHEN 2 THEN map('copy_kind', CASE WHEN l_returnflag = 'R' THEN 'd2h' ELSE 'h2d' END)
                  WHEN 3 THEN map('phase_name', 'forward') WHEN 4 THEN map('phase_name', 'backward') WHEN 5 THEN map('phase_name', 'optimizer')
                  WHEN 6 THEN map('wait_kind', 'stream')
                  ELSE CASE WHEN l_linestatus = 'O' THEN map('batch_size', string(8 * (1 + l_partkey % 4)))
                       ELSE map('window_state', 'exported', 'kernel_count', string(l_partkey % 300), 'median_cuda_kernel_duration_us', string(q), 'small_kernel_fraction', string(l_discount * 10)) END END"""
    )
    shapes = F.expr("CASE WHEN k = 7 AND l_linestatus = 'O' THEN map('x', array(int(8 * (1 + l_partkey % 4)), 128)) END")
    spans = lines.select("run_id", "step_id", "seq", kind.alias("event_type"), span.alias("duration_ns"), payload.alias("payload"), shapes.alias("shapes"))
    ends = orders.select(
        (F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("step_id"), F.explode(F.array(F.lit(0), F.lit(1_000_000))).alias("seq"), "o_totalprice", "o_orderstatus"
    )
    ended = F.col("seq") > 0
    ends = ends.select(
        "run_id", "step_id", "seq",
        F.when(ended, "step_end").otherwise("step_start").alias("event_type"),
        F.when(ended, F.floor(30000 + F.col("o_totalprice") * 0.2)).otherwise(0).alias("duration_ns"),
        F.when(ended, F.create_map(F.lit("step_kind"), F.lit("train"), F.lit("status"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok"))).otherwise(F.create_map(F.lit("step_kind"), F.lit("train"))).alias("payload"),
        F.lit(None).cast("map<string,array<int>>").alias("shapes"),
    )
    return spans.unionByName(ends)


def gpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ts, utilization_gpu_pct, utilization_mem_pct, memory_used_bytes, memory_total_bytes."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double")).withColumn("run_id", F.col("user_id") % 50)
    used = F.col("k") * 0.7 + (F.col("run_id") % 5) * 6
    return events.select(
        "run_id", "ts", (F.col("k") * (1 + F.col("run_id") % 4) / 4).alias("utilization_gpu_pct"), F.col("k").alias("utilization_mem_pct"), used.alias("memory_used_bytes"), F.lit(100.0).alias("memory_total_bytes")
    )


#: The same views in SQL, with typed columns in place of the payload map.
SQL = {
    "ev": f"""
    li AS (SELECT o_custkey % 50 AS run_id, l_orderkey AS step_id, l_linenumber AS k, l_quantity AS q, l_returnflag, l_linestatus, l_partkey, l_discount,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS seq
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ev AS (SELECT run_id, step_id, seq, k, q,
        CASE WHEN k = 1 THEN CAST(q * 500 * (run_id % 5) AS BIGINT) ELSE 0 END AS loader,
        CASE WHEN k = 2 AND l_returnflag <> 'R' THEN CAST(q * 400 * (run_id % 4) AS BIGINT) ELSE 0 END AS h2d,
        CASE WHEN k = 6 THEN CAST(q * 200 * (run_id % 3) AS BIGINT) ELSE 0 END AS sync,
        CASE WHEN k = 3 THEN CAST(q * 1000 AS BIGINT) ELSE 0 END AS fwd, CASE WHEN k = 4 THEN CAST(q * 1000 AS BIGINT) ELSE 0 END AS bwd,
        CASE WHEN k = 5 THEN CAST(q * 1000 AS BIGINT) ELSE 0 END AS opt,
        CASE WHEN k = 7 AND l_linestatus = 'O' THEN 8 * (1 + l_partkey % 4) END AS batch,
        (k = 7 AND l_linestatus <> 'O') AS win, l_partkey % 300 AS kc, l_discount * 10 AS sf
      FROM li)""",
    "gs": """
    gs AS (SELECT run_id, k * (1 + run_id % 4) / 4 AS util, k AS mem, k * 0.7 + (run_id % 5) * 6 AS used
      FROM (SELECT user_id % 50 AS run_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))""",
}
