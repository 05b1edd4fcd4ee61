"""The normalised event model: mappers, validation, versions, and step and run summaries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up, shape_signature, share
from gaugefleet.operators.kernels import canonical_metric
from gaugefleet.operators.ranges import medians, with_previous

CURRENT_VERSION = "1.0.0"
# Event families, step types, collective names by the first fragment held, pipeline stages, launch field aliases.
FAMILIES = ("kernel", "memory", "cpu", "data_pipeline", "distributed", "metric", "annotation")
STEP_TYPES = ("training_step", "inference_step", "eval_step", "cpu_span")
COLLECTIVES = [("allreduce", "all_reduce"), ("all_reduce", "all_reduce"), ("broadcast", "broadcast"), ("reduce_scatter", "reduce_scatter"), ("all_gather", "all_gather"), ("gather", "gather"), ("scatter", "scatter")]
STAGES = {"next": "dataloader_wait", "collate": "collate", "transfer_ready": "batch_ready", "decode": "decode", "transform": "transform", "dataset_read": "dataset_read"}
LAUNCH_FIELDS = {
    "registers_per_thread": ("registers_per_thread", "Registers Per Thread", "regs_per_thread"),
    "shared_memory_per_block_bytes": ("shared_memory_per_block_bytes", "Shared Memory Per Block", "shared_mem_per_block"),
    "threads_per_block": ("threads_per_block", "Threads Per Block", "block_size"),
    "block_x": ("block_x", "Block X", "blockDim.x"),
    "block_y": ("block_y", "Block Y", "blockDim.y"),
    "block_z": ("block_z", "Block Z", "blockDim.z"),
    "grid_x": ("grid_x", "Grid X", "gridDim.x"),
    "grid_y": ("grid_y", "Grid Y", "gridDim.y"),
    "grid_z": ("grid_z", "Grid Z", "gridDim.z"),
}


def is_metric() -> Column:
    """Whether a trace event is a counter: phase C, or a value without a duration."""
    return (F.upper("ph") == "C") | (F.col("args")["value"].isNotNull() & (F.coalesce("dur_us", F.lit(0.0)) == 0))


def split_profiler_metrics(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace events that are no counters, and the counters as metrics: metric_name, metric_unit, value and ts_ns beside their columns."""
    name = F.lower("name")
    counters = events.where(is_metric())
    metric = F.when(name.contains("util"), "gpu_utilization").when(name.contains("memory"), "memory_value").otherwise(F.col("name"))
    unit = F.coalesce(F.nullif(F.col("args")["unit"], F.lit("")), F.when(name.contains("util"), "percent").otherwise("unknown"))
    metrics = counters.withColumns({"metric_name": metric, "metric_unit": unit, "value": F.coalesce(F.col("args")["value"].try_cast("double"), F.lit(0.0)), "ts_ns": F.floor(F.col("ts_us") * 1000).cast("long")})
    return events.where(~F.coalesce(is_metric(), F.lit(False))), metrics


def kernel_launch_attrs(events: DataFrame) -> DataFrame:
    """Adds launch_attrs, a map of the launch fields that an event's args have under any of their names; empty text is none."""
    first = lambda names: F.coalesce(*[F.nullif(F.col("args")[n], F.lit("")) for n in names])
    pairs = [x for target, names in LAUNCH_FIELDS.items() for x in (F.lit(target), first(names))]
    return events.withColumn("launch_attrs", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def collective_op(name: Column) -> Column:
    lowered, out = F.lower(name), F.lit("unknown")
    for fragment, op in reversed(COLLECTIVES):
        out = F.when(lowered.contains(fragment), op).otherwise(out)
    return out


def map_collectives(records: DataFrame) -> DataFrame:
    """Collective records (run_id, rank, collective_type, ts_start_ns, ts_end_ns, ...) with their event columns; a duration is never negative."""
    op = collective_op(F.col("collective_type"))
    return records.withColumns({
        "collective_op": op, "event_id": F.concat_ws("_", F.lit("dist"), "rank", "ts_start_ns", op), "event_family": F.lit("distributed"), "event_type": F.lit("collective"),
        "duration_ns": F.greatest(F.col("ts_end_ns") - F.col("ts_start_ns"), F.lit(0)),
    })


def map_data_pipeline(records: DataFrame) -> DataFrame:
    """Pipeline records (run_id, stage, ts_start_ns, ts_end_ns, ...) with their event columns."""
    stages = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return records.withColumns({
        "event_id": F.concat_ws("_", F.lit("data_pipeline"), "stage", "ts_start_ns"), "event_family": F.lit("data_pipeline"), "event_type": F.coalesce(stages[F.lower("stage")], F.lit("data_pipeline_event")),
        "duration_ns": F.greatest(F.col("ts_end_ns") - F.col("ts_start_ns"), F.lit(0)),
    })


def metric_unit(name: Column) -> Column:
    return F.when(name.endswith("_pct") | name.startswith("warp_stall_"), "percent").when(name.endswith("_bytes"), "bytes").otherwise("count")


def map_kernel_csv_to_ir(tall: DataFrame) -> DataFrame:
    """Metric records of tall kernel metrics: run_id, kernel_name, metric_name (kernel.<name>), metric_unit, value; the last value of a name counts."""
    last = tall.groupBy("run_id", "kernel_name", canonical_metric(F.col("metric_name")).alias("m")).agg(F.max_by("value", "seq").alias("value"))
    return last.select("run_id", "kernel_name", F.concat(F.lit("kernel."), "m").alias("metric_name"), metric_unit(F.col("m")).alias("metric_unit"), "value")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _negative(c: str) -> Column:
    return F.coalesce(F.col(c) < 0, F.lit(True))


def validate_ir_records(records: DataFrame, kind: str, run: str | None = None) -> DataFrame:
    """Adds failures, the codes of checks that a row of events, metrics or annotations fails; rows without failures are good.

    ``run`` names a column with the id of the run that a record must belong to.
    """
    # Text that must not be empty and numbers that must not be negative, by kind.
    text = {"event": ("event_id", "run_id", "event_type", "source"), "metric": ("metric_id", "run_id", "metric_name", "metric_unit", "source"), "annotation": ("annotation_id", "run_id", "annotation_type", "target_id", "label", "source")}[kind]
    whole = {"event": ("ts_start_ns", "ts_end_ns", "duration_ns"), "metric": ("ts_ns",), "annotation": ("score",)}[kind]
    checks = [(f"empty_{c}", _blank(c)) for c in text] + [(f"negative_{c}", _negative(c)) for c in whole]
    if kind == "event":
        family = F.col("event_family")
        checks += [
            ("unknown_event_family", ~F.coalesce(family.isin(*FAMILIES), F.lit(False))), ("ends_before_start", F.col("ts_end_ns") < F.col("ts_start_ns")), ("wrong_duration", F.col("duration_ns") != F.col("ts_end_ns") - F.col("ts_start_ns")),
            ("kernel_without_device", (family == "kernel") & _blank("device_id")), ("distributed_without_rank", (family == "distributed") & F.col("attrs")["rank"].isNull()),
        ]
    if run:
        checks.append(("foreign_run", ~F.col("run_id").eqNullSafe(F.col(run))))
    return records.withColumn("failures", codes(*checks))


def _version(column: Column) -> Column:
    """A version as numbers; null unless it is three of them."""
    parts = F.split(column, r"\.")
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when((F.size(parts) == 3) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def schema_version_gate(records: DataFrame, migrations: list[tuple[str, str, dict[str, str]]] | None = None, current: str = CURRENT_VERSION) -> DataFrame:
    """Adds route (current, migrated, future, malformed or no_path) and brings old records forward.

    A record without schema_version is current. ``migrations`` are steps (from, to, SQL of new columns), applied in
    the order of the chain; an old version that no chain brings to ``current`` has no_path.
    """
    now = F.array(*[F.lit(int(x)) for x in current.split(".")])
    df = records.withColumn("schema_version", F.coalesce("schema_version", F.lit(current))).withColumn("__v", _version(F.col("schema_version")))
    state = F.when(F.col("__v").isNull(), "malformed").when(F.col("__v") == now, "current").when(F.col("__v") > now, "future").otherwise("old")
    df = df.withColumn("route", state).drop("__v")
    steps, at = {a: (b, columns) for a, b, columns in migrations or []}, None
    for start in steps:  # follow every chain once, from its first version
        if start not in {b for b, _ in steps.values()}:
            at = start
            while at in steps:
                to, columns = steps[at]
                here = (F.col("route") == "old") & (F.col("schema_version") == at)
                df = df.withColumns({c: F.when(here, F.expr(v)).otherwise(F.col(c)) if c in records.columns else F.when(here, F.expr(v)) for c, v in columns.items()} | {"schema_version": F.when(here, to).otherwise(F.col("schema_version"))})
                at = to
    return df.withColumn("route", F.when((F.col("route") == "old") & (F.col("schema_version") == current), "migrated").when(F.col("route") == "old", "no_path").otherwise(F.col("route")))


def ir_step_summary(events: DataFrame) -> DataFrame:
    """One row per (run_id, step_id), a text: wall, compute, communication and pipeline time, and the last shape signature by seq."""
    family, d = F.col("event_family"), F.col("duration_ns")
    total = lambda f: F.coalesce(F.sum(F.when(family == f, d)), F.lit(0))
    signature = F.when((family == "cpu") & F.col("shapes").isNotNull(), shape_signature(F.col("shapes")))
    return events.where("step_id <> ''").groupBy("run_id", "step_id").agg(
        F.coalesce(F.max(F.when(F.col("event_type").isin(*STEP_TYPES), d)), F.lit(0)).alias("step_wall_time_ns"), total("kernel").alias("compute_time_ns"), total("distributed").alias("communication_time_ns"),
        total("data_pipeline").alias("data_pipeline_time_ns"), F.max_by(signature, F.when(F.coalesce(signature, F.lit("")) != "", F.col("seq"))).alias("shape_signature"),
    )


def ir_shape_changes(steps: DataFrame) -> DataFrame:
    """Adds shape_changed: whether the signature differs from the run's previous one, by step id as text.

    A cell of the order is a step id without its last three characters, of those as long as the run's longest; shorter ids are cells of their own.
    """
    longest = steps.groupBy("run_id").agg(F.max(F.length("step_id")).alias("__longest"))
    found = with_previous(steps.join(longest, "run_id"), ["run_id"], "step_id", F.col("shape_signature"), "__previous", F.expr("left(step_id, greatest(__longest - 3, 0))"))
    return found.withColumn("shape_changed", F.coalesce(F.col("shape_signature") != F.col("__previous"), F.lit(False))).drop("__previous", "__longest")


def ir_run_summary(steps: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per run with steps: means and peaks of its metric rows, step times and sums; the memory peak is the largest use over the largest total."""
    wall = F.when(F.col("step_wall_time_ns") > 0, F.col("step_wall_time_ns"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    signed = F.count("shape_signature")
    by_run = ir_shape_changes(steps).groupBy("run_id").agg(
        zero(F.count(wall) / (F.sum(wall) / 1e9)).alias("throughput_steps_per_sec"), zero(F.avg(wall)).alias("step_time_avg_ns"), F.coalesce(F.max(wall), F.lit(0)).alias("step_time_max_ns"),
        F.when(signed >= 2, F.count_if("shape_changed") / (signed - 1)).otherwise(0.0).alias("shape_volatility_ratio"),
        *[F.sum(f"{c}_time_ns").alias(f"{c}_time_ns") for c in ("communication", "data_pipeline", "compute")],
    )
    of = lambda f, name: f(F.when(F.col("metric_name") == name, F.col("value")))
    peak = of(F.max, "memory_used_bytes") / F.nullif(of(F.max, "memory_total_bytes"), F.lit(0.0))
    sampled = metrics.groupBy("run_id").agg(of(F.avg, "gpu_utilization").alias("average_gpu_utilization_pct"), of(F.avg, "memory_utilization").alias("average_memory_utilization_pct"), peak.alias("memory_pressure_peak_ratio"))
    return by_run.join(sampled, "run_id", "left").na.fill(0.0, ["average_gpu_utilization_pct", "average_memory_utilization_pct", "memory_pressure_peak_ratio"])


def ir_step_labels(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, target_id, label, score): labels of steps by their shares of wall time, and of runs by memory and shapes."""
    part = {c: share(F.col(f"{c}_time_ns"), F.col("step_wall_time_ns")) for c in ("data_pipeline", "communication", "compute")}
    rules = [
        ("input_bound", part["data_pipeline"] >= 0.2, part["data_pipeline"]), ("communication_bound", part["communication"] >= 0.15, part["communication"]),
        ("compute_bound", (part["compute"] >= 0.6) & (part["data_pipeline"] < 0.1) & (part["communication"] < 0.1), part["compute"]),
    ]
    pick = lambda rows: F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("label"), half_up(s, 4).alias("score"))) for n, c, s in rows]), lambda x: x.isNotNull())).alias("x")
    by_step = steps.where("step_wall_time_ns > 0").select("run_id", F.col("step_id").alias("target_id"), pick(rules))
    memory, shape = F.col("memory_pressure_peak_ratio"), F.col("shape_volatility_ratio")
    by_run = runs.select("run_id", F.col("run_id").cast("string").alias("target_id"), pick([("memory_pressure", memory >= 0.9, memory), ("shape_instability", shape >= 0.3, shape)]))
    return by_step.union(by_run).select("run_id", "target_id", "x.*")


def trace_kernel_stats(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Per run: kernels, kernels per step, the upper median duration and the share of kernels below 10 us. ``steps`` has run_id and n_steps."""
    kernels = events.where("lower(cat) = 'kernel' and dur_us > 0")
    by_run = kernels.groupBy("run_id").agg(F.count("*").alias("kernels"), F.count_if(F.col("dur_us") < 10.0).alias("small"))
    by_run = by_run.join(medians(kernels, ["run_id"], "dur_us", "median", upper=True), "run_id")
    both = by_run.join(steps, "run_id", "left")
    n = F.greatest(F.coalesce("n_steps", F.lit(1)), F.lit(1))
    return both.select("run_id", F.col("kernels").alias("kernel_count_total"), half_up(F.col("kernels") / n, 2).alias("kernel_count"), half_up(F.col("median"), 3).alias("median_cuda_kernel_duration_us"), half_up(F.col("small") / F.col("kernels"), 4).alias("small_kernel_fraction"))
