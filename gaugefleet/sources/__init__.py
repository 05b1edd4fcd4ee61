"""Readers of traces, samples and profiler files, and writers of run summaries."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.sources.trace import read_chrome_trace as read_chrome_trace

EVENT_SCHEMA = (
    "schema_version string, event_id string, timestamp_ns long, pid long, tid long, job_id string, run_id string, event_type string, event_source string, gpu_id int, "
    "step_id long, span_id string, parent_span_id string, duration_ns long, level string, payload map<string,string>, _corrupt string"
)
MIB = 1024 * 1024
# Suffixes of kernel source.
SOURCE_SUFFIXES = (".cu", ".cuh", ".cuda")


def read_trace_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines traces. Blank and malformed lines are dropped; payload values become text.

    ``seq`` orders the events of a run as they were written: a pair of time and event id.
    """
    raw = spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    events = raw.where("_corrupt is null and event_type is not null").drop("_corrupt")
    return events.withColumn("seq", F.struct("timestamp_ns", "event_id"))


def _first(df: DataFrame, *names: str) -> Column:
    have = {c.strip().lower(): c for c in df.columns}
    found = [F.regexp_replace(F.trim(F.col(f"`{have[n]}`")), r"[^0-9.eE+-]", "").try_cast("double") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def read_gpu_csv(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Device samples of a monitor's CSV files, alternative headers allowed; rows without utilisation and memory are dropped.

    Without ``run_id`` a sample belongs to the run that its file's folder is named after.
    """
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if run_id is None else F.lit(run_id)
    out = df.select(
        run.alias("run_id"),
        _first(df, "index", "gpu").cast("int").alias("gpu_id"),
        _first(df, "utilization.gpu", "utilization.gpu [%]", "gpu_util", "utilization_gpu_pct").alias("utilization_gpu_pct"),
        _first(df, "utilization.memory", "utilization.memory [%]", "memory_util", "utilization_mem_pct").alias("utilization_mem_pct"),
        (_first(df, "memory.used", "memory.used [mib]", "memory_used") * MIB).alias("memory_used_bytes"),
        (_first(df, "memory.total", "memory.total [mib]", "memory_total") * MIB).alias("memory_total_bytes"),
    )
    return out.where("utilization_gpu_pct is not null or memory_used_bytes is not null")


def union_sources(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Events with the device samples folded in as gpu_sample events; missing columns are null."""
    values = [c for c in ("utilization_gpu_pct", "utilization_mem_pct", "memory_used_bytes", "memory_total_bytes") if c in samples.columns]
    payload = F.map_filter(F.create_map(*[x for c in values for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return events.unionByName(samples.select("run_id", F.lit("gpu_sample").alias("event_type"), payload.alias("payload")), allowMissingColumns=True)


def read_eval_rows(spark: SparkSession, path: str, schema: str, level: int | None = None) -> DataFrame:
    """Evaluation rows of JSON lines, of one level if asked."""
    rows = spark.read.schema(schema).json(path)
    return rows if level is None else rows.where(F.col("Level_ID") == level)


def read_variants_manifest(spark: SparkSession, path: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Variants of a results CSV, and the rows set aside because a name, a table or a number is missing.

    Raises ValueError for a missing column, or for fewer than ``least`` variants.
    """
    df = spark.read.option("header", True).csv(path)
    for c in ("variant", "ncu_csv", "throughput_gflops"):
        if c not in df.columns:
            raise ValueError(f"{path} has no column {c}")
    parsed = df.withColumn("throughput", F.trim("throughput_gflops").try_cast("double"))
    held = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    good = held("variant") & held("ncu_csv") & F.col("throughput").isNotNull()
    found = parsed.where(good)
    if found.limit(least).count() < least:
        raise ValueError(f"{path} has fewer than {least} variants")
    return found, parsed.where(~good)


def route_artifacts(files: DataFrame) -> DataFrame:
    """Adds kind to (path, text): ptx, cuda_source, ncu or unknown, by suffix, else by content."""
    path, text = F.lower("path"), F.col("text")
    lowered = F.lower(text)
    source = F.lit(False)
    for suffix in SOURCE_SUFFIXES:
        source = source | path.endswith(suffix)
    kind = (
        F.when(path.endswith(".ptx"), "ptx").when(source, "cuda_source").when(path.endswith(".csv"), "ncu")
        .when(text.contains(".entry") | (text.contains(".version") & text.contains(".target")), "ptx").when(text.contains("__global__") | text.contains("<<<"), "cuda_source")
        .when(lowered.contains("metric name") & lowered.contains("metric value"), "ncu").otherwise("unknown")
    )
    return files.withColumn("kind", kind)


def nested_summaries(runs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(run_id, summary): one JSON text per run, with the summary and diagnosis of each of its scopes."""
    both = runs.join(diagnoses, ["run_id", "scope"], "left")
    names = [c for c in both.columns if c not in ("run_id", "scope")]
    scoped = both.select("run_id", F.struct("scope", *names).alias("s"))
    by_run = scoped.groupBy("run_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # as many as there are scopes
    return by_run.select("run_id", F.to_json(F.map_from_entries(F.transform("s", lambda x: F.struct(x["scope"], F.struct(*[x[c].alias(c) for c in names]))))).alias("summary"))


def write_run_summary(summaries: DataFrame, path: str, by: str | tuple[str, ...] = "run_id") -> None:
    """Summaries as Parquet, one partition for each value of ``by``.

    Partitions that ``summaries`` has rows for are replaced, all others stay: writing a run again replaces that run, and
    writing the same twice changes nothing.
    """
    names = [by] if isinstance(by, str) else list(by)
    summaries.repartition(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


# Header names of kernel tables.
_KERNEL = ("kernel name", "kernel name demangled", "kernel", "name")
_METRIC = ("metric name", "metric")
_VALUE = ("metric value", "value", "avg", "average")
_UNIT = ("metric unit", "unit")


def _cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lines in batches:
        yield pa.array([[c.strip() for c in row] for row in (next(csv.reader([x]), []) for x in lines.to_pylist())], pa.list_(pa.string()))


def read_kernel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tall kernel metrics of profiler tables: file, kernel_name, metric_name, metric_unit, value, seq (rises along the file).

    Comment and status lines go; if any line of a file is quoted, only its quoted ones stay. The first line left is the header.
    In a wide table the row below it holds units if it names no kernel, and several launches of a kernel have the mean of each metric.
    A file is read by as many tasks as it has splits: only its header, its units and whether it is quoted are brought together.
    A line is a row, so a cell holds no line end.
    """
    cells = F.arrow_udf(_cells, "array<string>")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    lines = lines.where(F.trim("value") != "").where(~F.trim("value").rlike("^(#|==)")).withColumn("quoted", F.ltrim("value").startswith('"'))
    first = lambda when: F.min(F.when(when, F.struct("seq", "value")))
    heads = lines.groupBy("file").agg(F.max("quoted").alias("is_quoted"), first(F.col("quoted")).alias("a"), first(F.lit(True)).alias("b"))
    heads = heads.select("file", "is_quoted", F.when(F.col("is_quoted"), F.col("a")).otherwise(F.col("b")).alias("head"))
    kept = lines.join(heads, "file").where(~F.col("is_quoted") | F.col("quoted")).where(F.col("seq") > F.col("head.seq"))
    second = kept.groupBy("file").agg(F.min(F.struct("seq", "value")).alias("second"))
    heads = heads.join(second, "file").select("file", cells("head.value").alias("header"), F.col("second.seq").alias("second"), cells("second.value").alias("units"))
    lowered = F.transform("header", lambda h: F.lower(h))
    at = lambda names: F.coalesce(*[F.nullif(F.array_position(lowered, F.lit(n)), F.lit(0)) for n in names])
    heads = heads.select("file", "header", "second", "units", at(_KERNEL).alias("k"), at(_METRIC).alias("m"), at(_VALUE).alias("v"), at(_UNIT).alias("u")).where("k is not null")
    wide = F.col("m").isNull() & F.col("v").isNull()
    cell = lambda row, i: F.coalesce(F.get(row, (i - 1).cast("int")), F.lit(""))
    heads = heads.withColumns({"wide": wide, "has_units": wide & (cell(F.col("units"), F.col("k")) == "")})
    rows = kept.select("file", "seq", cells("value").alias("row")).join(heads, "file").withColumn("kernel_name", cell(F.col("row"), F.col("k"))).where("kernel_name <> ''")
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")

    tall = rows.where("NOT wide").select("file", "kernel_name", cell(F.col("row"), F.col("m")).alias("metric_name"), F.nullif(cell(F.col("row"), F.col("u")), F.lit("")).alias("metric_unit"), number(cell(F.col("row"), F.col("v"))).alias("value"), "seq")
    tall = tall.where("metric_name <> '' and value is not null")
    unit = F.when(F.col("has_units"), F.nullif(cell(F.col("units"), F.col("i") + 1), F.lit("")))
    values = rows.where("wide").select("file", "seq", "kernel_name", "header", "units", "has_units", "k", F.posexplode("row").alias("i", "x"))
    values = values.where("i <> k - 1 AND i < size(header)").select("file", "kernel_name", F.get("header", F.col("i")).alias("metric_name"), unit.alias("metric_unit"), "i", number(F.col("x")).alias("value"), "seq").where("value is not null")
    means = values.groupBy("file", "kernel_name", "i").agg(F.any_value("metric_name").alias("metric_name"), F.any_value("metric_unit").alias("metric_unit"), F.avg("value").alias("value"), F.min("seq").alias("seq")).drop("i")
    return tall.unionByName(means)
