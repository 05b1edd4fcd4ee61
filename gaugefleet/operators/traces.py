"""Profiler traces and device samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import half_up


def detect_steps(events: DataFrame) -> DataFrame:
    """(run_id, step, start_us, end_us): numbered profiler steps, else the user annotation with the longest mean."""
    e = events.withColumn("dur_us", F.coalesce("dur_us", F.lit(0.0)))
    number = F.regexp_extract("name", r"^ProfilerStep#\s*(\d+)\s*$", 1).try_cast("long")
    numbered = e.withColumn("step", number).where("step is not null and dur_us > 0").select("run_id", "step", "ts_us", "dur_us")
    rest = e.where("cat = 'user_annotation'").join(numbered.select("run_id").distinct(), "run_id", "left_anti")
    name = rest.groupBy("run_id", "name").agg(F.avg("dur_us").alias("mean")).groupBy("run_id").agg(F.max_by("name", F.struct("mean", "name")).alias("name"))
    order = Window.partitionBy("run_id").orderBy("ts_us", "dur_us")
    found = rest.join(name, ["run_id", "name"]).withColumn("step", F.row_number().over(order).cast("long")).select("run_id", "step", "ts_us", "dur_us")
    return numbered.unionByName(found).select("run_id", "step", F.col("ts_us").alias("start_us"), (F.col("ts_us") + F.col("dur_us")).alias("end_us"))


def _has(column: Column, *parts: str) -> Column:
    out = column.contains(parts[0])
    for p in parts[1:]:
        out = out | column.contains(p)
    return out


def trace_steps_range_join(steps: DataFrame, events: DataFrame, bucket_us: float) -> DataFrame:
    """Spans and kernels inside each step window (end + 1 us), summed by phase.

    A range join as an equi join: windows are laid out over time buckets, an event stands in the one
    of its start, and an event may fall in several overlapping steps.
    """
    name, cat, ns = F.lower("name"), F.lower("cat"), F.floor(F.coalesce("dur_us", F.lit(0.0)) * 1000).cast("long")
    bucket = lambda c: F.floor(c / bucket_us).cast("long")
    s = steps.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_us")), bucket(F.col("end_us") + 1))))
    e = events.withColumn("bucket", bucket(F.col("ts_us"))).withColumn("stop_us", F.col("ts_us") + F.coalesce("dur_us", F.lit(0.0)))
    inside = s.join(e, ["run_id", "bucket"]).where("ts_us >= start_us and stop_us <= end_us + 1")
    note = F.col("cat") == "user_annotation"
    kernel = _has(cat, "kernel") | (_has(cat, "cuda") & _has(name, "kernel"))
    loader = (_has(name, "dataloader") & _has(name, "__next__")) | name.isin("get_next_batch", "fetch_next_batch", "load_batch", "data_fetch", "data_loading")
    h2d = ~_has(name, "dtoh", "d2h", "dtod", "d2d") & (_has(name, "htod", "h2d", "host_to_device", "host to dev") | (cat == "gpu_memcpy"))
    forward = _has(name, "forward_backward") | (name == "forward") | (_has(name, "fwd") & ~_has(name, "backward", "dataloader"))
    backward = _has(name, "backward") & ~_has(name, "forward_backward")
    optimizer = _has(name, "optimizer.step") | (_has(name, "step") & _has(name, "adam", "sgd", "rmsprop", "adagrad"))
    most = lambda c: F.max(F.when(note & c, ns))
    total = lambda c: F.sum(F.when(note & c, ns))
    sums = inside.groupBy("run_id", "step").agg(
        most(loader).alias("dataloader_ns"), total(h2d).alias("h2d_ns"), most(forward).alias("forward_ns"), total(backward).alias("backward_ns"), total(optimizer).alias("optimizer_ns"),
        F.count(F.when(kernel, 1)).alias("kernel_count"), F.count(F.when(kernel & (F.coalesce("dur_us", F.lit(0.0)) < 10.0), 1)).alias("small_kernels"), F.percentile(F.when(kernel, F.coalesce("dur_us", F.lit(0.0))), 0.5).alias("median_kernel_us"),
    )
    out = steps.join(sums, ["run_id", "step"], "left").withColumn("wall_ns", F.floor((F.col("end_us") - F.col("start_us")) * 1000).cast("long"))
    filled = out.na.fill(0, ["dataloader_ns", "h2d_ns", "forward_ns", "backward_ns", "optimizer_ns", "kernel_count", "small_kernels"])
    return filled.withColumn("small_kernel_fraction", F.when(F.col("kernel_count") > 0, half_up(F.col("small_kernels") / F.col("kernel_count"), 4)))


def map_profiler_to_ir(events: DataFrame) -> DataFrame:
    """Adds event_family, event_type and kernel_class to trace events, first match first, and nanosecond times."""
    name, cat = F.lower("name"), F.lower("cat")
    family = (
        F.when(_has(cat, "kernel") | (_has(cat, "cuda") & _has(name, "kernel")), "kernel").when(_has(name, "memcpy") | _has(cat, "memory"), "memory")
        .when(_has(name, "dataloader") | _has(cat, "data"), "data_pipeline").when(_has(name, "nccl") | _has(cat, "distributed"), "distributed").otherwise("cpu")
    )
    df = events.where("name <> ''").withColumn("event_family", family)
    f = F.col("event_family")
    kind = (
        F.when(f == "kernel", "cuda_kernel").when(f == "memory", F.when(_has(name, "memcpy"), "memcpy").otherwise("memory_event"))
        .when(f == "data_pipeline", F.when(_has(name, "dataloader"), "dataloader_event").otherwise("data_pipeline_event")).when(f == "distributed", "collective").otherwise("cpu_span")
    )
    klass = F.when(_has(name, "mm"), "gemm").when(_has(name, "attention"), "attention").when(_has(name, "layernorm", "layer_norm"), "layernorm").when(_has(name, "reduce"), "reduction").when(_has(name, "copy"), "memcpy").otherwise("unknown")
    start = F.floor("ts_us").cast("long") * 1000 + F.floor((F.col("ts_us") - F.floor("ts_us")) * 1000).cast("long")  # whole microseconds stay exact
    length = (F.greatest(F.coalesce("dur_us", F.lit(0.0)), F.lit(0.0)) * 1000).cast("long")
    return df.withColumns({"event_type": kind, "kernel_class": F.when(f == "kernel", klass), "ts_start_ns": start, "duration_ns": length, "ts_end_ns": start + length})


# Device sample columns, metric names and units.
NVML = [("utilization_gpu_pct", "gpu_utilization", "percent"), ("utilization_mem_pct", "memory_utilization", "percent"), ("memory_used_bytes", "memory_used_bytes", "bytes"), ("memory_total_bytes", "memory_total_bytes", "bytes"), ("temperature_c", "temperature_c", "celsius"), ("power_w", "power_w", "watts"), ("sm_clock_mhz", "sm_clock_mhz", "mhz"), ("mem_clock_mhz", "mem_clock_mhz", "mhz")]


def unpivot_nvml(samples: DataFrame, keys: tuple[str, ...] = ("run_id", "ts")) -> DataFrame:
    """One row per sample and metric that has a value, with its unit."""
    have = [x for x in NVML if x[0] in samples.columns]
    entries = F.array(*[F.struct(F.lit(name).alias("metric_name"), F.lit(unit).alias("metric_unit"), F.col(c).cast("double").alias("value")) for c, name, unit in have])
    return samples.select(*keys, F.inline(F.filter(entries, lambda x: x["value"].isNotNull())))


def nvml_health_annotations(samples: DataFrame, keys: tuple[str, ...] = ("run_id", "ts")) -> DataFrame:
    """memory_pressure at 90 % of memory, thermal_pressure at 85 degrees, with scores."""
    ratio = F.when(F.col("memory_total_bytes") > 0, F.col("memory_used_bytes") / F.col("memory_total_bytes"))
    heat = F.col("temperature_c")
    found = F.array(
        F.when(ratio >= 0.9, F.struct(F.lit("memory_pressure").alias("label"), half_up(ratio, 4).alias("score"))),
        F.when(heat >= 85.0, F.struct(F.lit("thermal_pressure").alias("label"), half_up(F.least(heat / 100.0, F.lit(1.0)), 4).alias("score"))),
    )
    return samples.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))
