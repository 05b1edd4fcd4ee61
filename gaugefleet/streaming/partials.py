"""Steps and run sessions of a stream, as partial rows per micro-batch that are merged when read.

A partial row of a step holds sums, maxima and last writes of some of its events, so any number of them
merge to the step's metrics, in whatever batches its events came and however late. A partial row of a run
covers events of which none is farther than the gap from the next, so it lies within one session; sessions
are the unions of overlapping covers, and an event that comes late between two sessions joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.functions import number
from gaugefleet.operators import steps as S
from gaugefleet.streaming.run import run_batches, written_batches

_SAMPLE = ("utilization_gpu_pct", "utilization_mem_pct", "memory_used_bytes", "memory_total_bytes")


def _parts(events: DataFrame, gap: str) -> dict[str, DataFrame]:
    """Partial rows of the steps (with the session of the step's own events in them), of the runs, and of the runs' device samples."""
    if "shapes" not in events.columns:
        events = events.withColumn("shapes", F.lit(None).cast("map<string,array<int>>"))
    cover = F.session_window("ts", gap)
    steps = S.partial_steps(events.where("ts is not null"), cover.alias("cover"))
    runs = events.groupBy("run_id", cover.alias("cover")).agg(F.count("*").alias("events"), F.max("ts").alias("latest"))
    samples = events.where("event_type = 'gpu_sample'").select("run_id", "ts", *[number(F.col("payload")[c]).alias(c) for c in _SAMPLE])
    return {"steps": steps, "runs": runs, "samples": S.partial_samples(samples, cover.alias("cover"))}


def collect_partials(events: DataFrame, path: str, gap: str = "30 minutes") -> None:
    """Reduce what a stream of events (run_id, ts, seq, event_type, step_id, duration_ns, payload, perhaps shapes) has now to partial rows under ``path``.

    A later call goes on from the checkpoint; a repeated batch is written over itself. The gap of a path never changes.
    """
    run_batches(events, path, lambda batch: _parts(batch, gap))


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").drop("batch")


def step_metrics_so_far(spark: SparkSession, path: str) -> DataFrame:
    """One row per (run_id, step_id) over all batches, equal to ``step_metrics`` of all events so far."""
    return S.merge_steps(_read(spark, path, "steps"))


def run_sessions(covers: DataFrame) -> DataFrame:
    """(run_id, start, end) of the unions of overlapping ``cover`` windows of each run; a session ends a gap after its last event."""
    spans = covers.select("run_id", F.col("cover.start").alias("at"), ((F.unix_micros("cover.end") - F.unix_micros("cover.start")) / 1_000_000).cast("decimal(18,6)").alias("long"))
    joined = spans.groupBy("run_id", F.session_window("at", F.make_interval(secs="long")).alias("s")).agg(F.count("*").alias("n"))
    return joined.select("run_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def open_and_closed_sessions(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """One row per session of a run: start, end, events, closed, and the run summary of the session's events.

    A session is closed when the latest event of all runs, less ``delay``, has reached its end. A session without steps has
    only its events and null metrics.
    """
    runs, steps, samples = (_read(spark, path, name) for name in ("runs", "steps", "samples"))
    sessions = run_sessions(runs)
    inside = lambda df: df.join(sessions.withColumnRenamed("run_id", "__run"), F.expr("run_id = __run AND cover.start >= start AND cover.start < end")).drop("__run", "cover")
    as_run = lambda df: df.withColumn("run_id", F.struct("run_id", "start", "end"))
    summary = S.summarise_runs(as_run(S.merge_steps(inside(steps), "start", "end")), S.merge_samples(as_run(inside(samples))))
    seen = runs.agg(F.max("latest").alias("__seen"))
    counted = inside(runs).groupBy("run_id", "start", "end").agg(F.sum("events").alias("events"))
    closed = F.col("end") <= F.col("__seen") - F.expr(f"INTERVAL {delay}")
    counted = counted.join(F.broadcast(seen)).withColumn("closed", closed).drop("__seen")  # one row
    return as_run(counted).join(summary, "run_id", "left").select("run_id.*", "events", "closed", *[c for c in summary.columns if c not in ("run_id", "scope")])
