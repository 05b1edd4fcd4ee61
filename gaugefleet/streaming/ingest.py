"""Tailed traces: lines to events, broken lines set aside, repeated events dropped, alerts as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.functions import number
from gaugefleet.sources import EVENT_SCHEMA
from gaugefleet.streaming.run import run_batches, written_batches

STREAM_SCHEMA = "run_id string, event_id string, ts timestamp, event_type string, step_id long, span_id string, duration_ns long, payload map<string,string>, timestamp_ns long"


def stream_trace(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The lines of a folder of growing JSON-lines traces as a stream: columns of events, ``line`` (text of a broken one) and ``file``.

    A file that appears between two runs is read by the second. A micro-batch takes at most ``files_per_trigger`` files.
    """
    raw = spark.readStream.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.withColumn("file", F.col("_metadata.file_path")).withColumnRenamed("_corrupt", "line")


def _good() -> Column:
    return F.col("line").isNull() & F.col("event_type").isNotNull() & F.col("event_id").isNotNull() & F.col("timestamp_ns").isNotNull()


def stream_ingest(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Good rows of a stream with event time ``ts``, once per run and event_id within the watermark."""
    return events.where("event_type is not null and event_id is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "event_id"])


def ingest_traces(spark: SparkSession, folder: str, path: str, delay: str = "10 minutes", anchor_ns: Column | None = None, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Take in what a folder of traces has now, and return all events so far and all lines set aside so far.

    The first stream parses each line once: events go to one table, lines that are broken or lack a type, an id or a
    time to another (file, line), each line as often as it stands there. The second stream reads the events and keeps each
    (run_id, event_id) once within ``delay``. Both go on from their checkpoints under ``path``, so a later call takes in
    only files that are new, and a batch repeated after a failure is written over itself. The clock of a trace may begin at
    any time: ``anchor_ns``, a column over the event, is added to ``timestamp_ns`` to give ``ts``.
    """
    lines = stream_trace(spark, folder, files_per_trigger)
    columns = STREAM_SCHEMA.replace(" ts timestamp,", "").split(", ")
    names = [c.split(" ")[0] for c in columns]
    at = F.timestamp_micros(F.expr("timestamp_ns DIV 1000") if anchor_ns is None else F.floor((F.col("timestamp_ns") + anchor_ns) / 1000).cast("long"))

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        bad = batch.where(~_good()).select("file", F.coalesce("line", F.to_json(F.struct(*names))).alias("line"))
        return {"events": batch.where(_good()).select(*names, at.alias("ts")), "aside": bad}

    run_batches(lines, f"{path}/lines", parts)
    schema = f"{', '.join(columns)}, ts timestamp"
    try:
        events = spark.readStream.schema(schema).parquet(f"{path}/lines/events/batch=*")
        run_batches(stream_ingest(events, delay), f"{path}/once", lambda batch: {"events": batch})
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return written_batches(spark, f"{path}/once", "events", schema), written_batches(spark, f"{path}/lines", "aside", "file string, line string")


def stream_health_alerts(samples: DataFrame) -> DataFrame:
    """Memory at 90 % and temperature at 85 degrees, as they arrive."""
    ratio = F.col("memory_used_bytes") / F.nullif(F.col("memory_total_bytes"), F.lit(0))
    alerts = F.array(F.when(ratio >= 0.9, F.lit("memory_pressure")), F.when(F.col("temperature_c") >= 85, F.lit("thermal_pressure")))
    return samples.select("run_id", "ts", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("label"))


def numbers(events: DataFrame, *fields: str) -> DataFrame:
    """Payload fields of sample events as typed columns."""
    keys = [c for c in ("run_id", "gpu_id", "ts") if c in events.columns]
    return events.select(*keys, *[number(F.col("payload")[f]).alias(f) for f in fields])
