"""Events to steps, steps to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import number, shape_signature, share
from gaugefleet.operators.ranges import medians, nth, with_previous

STALLS = (("input_bound", "dataloader_wait_time_ns"), ("copy_bound", "h2d_copy_time_ns"), ("sync_bound", "sync_wait_time_ns"))
PHASES = ("forward", "backward", "optimizer")


def partial_steps(events: DataFrame, *by: Column) -> DataFrame:
    """Per (run_id, step_id) and ``by``: sums, maxima and last writes of some of a step's events, which ``merge_steps`` puts together.

    A last write is a pair of its ``seq`` and value, so that the larger pair is the later write; of equal ``seq`` the larger value counts.
    """
    kind, payload, d = F.col("event_type"), F.col("payload"), F.coalesce("duration_ns", F.lit(0))
    end, shape = kind == "step_end", kind == "shape_snapshot"

    def summed(when: Column, value: Column = d) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")

    def last(value: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(F.col("seq").alias("seq"), value.alias("value"))))

    window = (kind == "profiler_window") & (payload["window_state"] == "exported")
    median, small = number(payload["median_cuda_kernel_duration_us"]), number(payload["small_kernel_fraction"])
    timed = (kind == "phase_span") & payload["phase_name"].isin(*PHASES)
    return events.where("step_id is not null").groupBy("run_id", "step_id", *by).agg(
        last(F.coalesce(payload["status"], F.lit("unknown")), end).alias("last_status"),
        last(d, end).alias("last_step_wall_time_ns"),
        summed((kind == "dataloader_span") & (payload["stage"] == "next")).alias("dataloader_wait_time_ns"),
        summed((kind == "memcpy_span") & (payload["copy_kind"] == "h2d")).alias("h2d_copy_time_ns"),
        summed(kind == "sync_wait").alias("sync_wait_time_ns"),
        *[F.max(F.when(timed & (payload["phase_name"] == p), d)).alias(f"{p}_time_ns") for p in PHASES],
        F.collect_list(F.when(timed, F.struct(F.col("seq").alias("s"), payload["phase_name"].alias("p"), d.alias("d")))).alias("spans"),
        last(shape_signature(F.col("shapes")), shape).alias("last_shape_signature"),
        last(number(payload["batch_size"]).cast("long"), shape).alias("last_batch_size"),
        summed(window, F.lit(1)).alias("profiler_windows_exported"),
        summed(window, F.coalesce(number(payload["kernel_count"]).cast("long"), F.lit(0))).alias("kernel_count"),
        last(median, window & (median > 0)).alias("last_median_cuda_kernel_duration_us"),
        last(F.least(F.lit(1.0), F.greatest(F.lit(0.0), small)), window & small.isNotNull()).alias("last_small_kernel_fraction"),
    )


_SUMS = ("dataloader_wait_time_ns", "h2d_copy_time_ns", "sync_wait_time_ns", "profiler_windows_exported", "kernel_count")
_LASTS = ("last_status", "last_step_wall_time_ns", "last_shape_signature", "last_batch_size", "last_median_cuda_kernel_duration_us", "last_small_kernel_fraction")


def merge_steps(partials: DataFrame, *by: str) -> DataFrame:
    """Step metrics from any number of partial rows of a step (and ``by``), in any order."""
    largest = (*_LASTS, *(f"{p}_time_ns" for p in PHASES))
    merged = partials.groupBy("run_id", "step_id", *by).agg(*[F.max(c).alias(c) for c in largest], *[F.sum(c).alias(c) for c in _SUMS], F.flatten(F.collect_list("spans")).alias("spans"))
    return _finished(merged, *by)


def _finished(merged: DataFrame, *by: str) -> DataFrame:
    """The columns of step metrics from one merged row per step."""
    value = lambda c, default: F.coalesce(F.col(f"last_{c}")["value"], F.lit(default)).alias(c)
    end = F.col("last_step_wall_time_ns")["seq"]

    def before_end(name: str) -> Column:
        """The longest span of the phase before the step's last end; the few spans of a step are gathered, its events never."""
        spans = F.filter("spans", lambda x: (x["p"] == name) & (x["s"] < end))
        return F.coalesce(F.array_max(F.transform(spans, lambda x: x["d"])), F.lit(0))

    active = sum((before_end(p) for p in PHASES[1:]), before_end(PHASES[0]))
    wall = F.coalesce(F.col("last_step_wall_time_ns")["value"], F.lit(0))
    return merged.select(
        "run_id", "step_id", *by, value("status", "unknown"), value("step_wall_time_ns", 0).cast("long").alias("step_wall_time_ns"), *_SUMS[:3],
        *[F.coalesce(f"{p}_time_ns", F.lit(0)).cast("long").alias(f"{p}_time_ns") for p in PHASES], F.col("last_shape_signature")["value"].alias("shape_signature"), value("batch_size", 0),
        *_SUMS[3:], value("median_cuda_kernel_duration_us", 0.0), value("small_kernel_fraction", 0.0), share(active, wall).alias("gpu_active_fraction_proxy"),
    )


def step_metrics(events: DataFrame) -> DataFrame:
    """One row per (run_id, step_id).

    Spans of the data loader, host-to-device copies and waits add up; begin and end markers of a
    phase share its type, so phases take the maximum; status, wall time and shapes take the last
    write by ``seq``; phases after the last step end do not count as active time.
    """
    return _finished(partial_steps(events))


def _keys(steps: DataFrame) -> list[str]:
    return ["run_id", "scope"] if "scope" in steps.columns else ["run_id"]


def _done() -> Column:
    return (F.col("status") == "ok") & (F.col("step_wall_time_ns") > 0)


def _after_first(steps: DataFrame, n: int) -> DataFrame:
    """Adds __steady: whether a step is completed and not among the first ``n`` completed ones of its run."""
    if n <= 0:
        return steps.withColumn("__steady", F.coalesce(_done(), F.lit(False)))
    first = nth(steps.where(_done()), ["run_id"], "step_id", n, "__nth")
    return steps.join(first, "run_id", "left").withColumn("__steady", F.coalesce(_done() & (F.col("step_id") > F.col("__nth")), F.lit(False))).drop("__nth")


def with_scopes(steps: DataFrame, skip_first_n: int = 2) -> DataFrame:
    """Each step once for the scope run, and once more for the scope steady if it is completed and not among the first ones."""
    scopes = F.when(F.col("__steady"), F.array(F.lit("run"), F.lit("steady"))).otherwise(F.array(F.lit("run")))
    return _after_first(steps, skip_first_n).withColumn("scope", F.explode(scopes)).drop("__steady")


def shape_changes(steps: DataFrame) -> DataFrame:
    """Adds shape_changed: whether the signature differs from the run's (and scope's) previous one that is not null."""
    held = F.when(F.col("shape_signature") != "", F.col("shape_signature"))
    found = with_previous(steps, _keys(steps), "step_id", held, "__previous")
    return found.withColumn("shape_changed", F.coalesce((F.col("shape_signature") != "") & (F.col("shape_signature") != F.col("__previous")), F.lit(False))).drop("__previous")


def steady_state_steps(steps: DataFrame, skip_first_n: int = 2, last_k: int | None = None) -> DataFrame:
    """Completed steps of each run without the first ones, or only the last of those."""
    done = _after_first(steps, skip_first_n).where("__steady").drop("__steady")
    if last_k is not None:
        from_ = nth(done, ["run_id"], "step_id", last_k, "__from", last=True)
        done = done.join(from_, "run_id", "left").where(F.col("__from").isNull() | (F.col("step_id") >= F.col("__from"))).drop("__from")
    return done


def dominant_stall(*totals: Column, compute: Column) -> Column:
    """The largest stall total, ties in rule order; else compute_bound or unknown."""
    top = F.greatest(*totals)
    out = F.when(top <= 0, F.when(compute > 0, "compute_bound").otherwise("unknown"))
    for (label, _), total in zip(STALLS, totals, strict=True):
        out = out.when(total == top, label)
    return out


def partial_samples(samples: DataFrame, *by: Column) -> DataFrame:
    """Per run_id and ``by``: sums, counts and extremes of device samples, which ``merge_samples`` puts together."""
    util, memory = F.col("utilization_gpu_pct"), F.col("utilization_mem_pct")
    return samples.groupBy("run_id", *by).agg(
        F.sum(util).alias("util_sum"), F.count(util).alias("util_n"), F.max(util).alias("util_max"), F.min(util).alias("util_min"), F.sum(memory).alias("memory_sum"), F.count(memory).alias("memory_n"),
        F.max(F.when(F.col("memory_total_bytes") != 0, F.col("memory_used_bytes") / F.col("memory_total_bytes"))).alias("memory_peak"),
    )


def merge_samples(partials: DataFrame, *by: str) -> DataFrame:
    """Means, peak and spread of each run (and ``by``) from any number of partial rows."""
    mean = lambda c: (F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0)))
    return partials.groupBy("run_id", *by).agg(
        mean("util").alias("average_gpu_utilization_pct"), mean("memory").alias("average_memory_utilization_pct"), F.max("memory_peak").alias("memory_pressure_peak_ratio"),
        F.when(F.sum("util_n") >= 2, F.max("util_max") - F.min("util_min")).otherwise(0.0).alias("utilization_instability_pct"),
    )


def summarise_runs(steps: DataFrame, by_sample: DataFrame, scope: str = "run") -> DataFrame:
    """``run_summary`` with the samples of each run already merged."""
    ok = F.col("status") == "ok"
    wall = F.when(ok & (F.col("step_wall_time_ns") > 0), F.col("step_wall_time_ns"))
    positive = lambda c: F.when(ok & (F.col(c) > 0), F.col(c).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    totals = [F.sum(c) for _, c in STALLS]
    compute = F.sum(sum((F.col(f"{p}_time_ns") for p in PHASES[1:]), F.col(f"{PHASES[0]}_time_ns")))
    done = ok & (F.col("step_wall_time_ns") > 0)
    ratios = [zero(F.avg(F.when(done, share(F.col(c), F.col("step_wall_time_ns"))))).alias(f"{label}_ratio") for label, c in STALLS]
    signed = F.count(F.when(F.col("shape_signature") != "", 1))
    by_run = shape_changes(steps).groupBy(*_keys(steps)).agg(
        F.count(F.when(done, 1)).alias("completed_steps"),
        zero(F.count(F.when(ok, 1)) / (F.nullif(F.sum(wall), F.lit(0)) / 1e9)).alias("throughput_steps_per_sec"),
        zero(F.avg(wall)).alias("step_time_avg_ns"),
        F.coalesce(F.max(wall), F.lit(0)).alias("step_time_max_ns"),
        zero(F.stddev_pop(wall) / F.avg(wall)).alias("step_time_cv"),
        F.sum("profiler_windows_exported").alias("profiler_windows_exported"),
        zero(F.avg(positive("kernel_count"))).alias("kernel_count_per_step"),
        zero(F.avg(positive("small_kernel_fraction"))).alias("small_kernel_fraction"),
        F.when(signed >= 2, F.count(F.when(F.col("shape_changed"), 1)) / (signed - 1)).otherwise(0.0).alias("shape_volatility_ratio"),
        dominant_stall(*totals, compute=compute).alias("dominant_stall_type"),
        *ratios,
    )
    middle = medians(steps.where(ok), _keys(steps), "median_cuda_kernel_duration_us", "median_cuda_kernel_duration_us")
    names = [c for c in by_sample.columns if c != "run_id"]
    out = by_run.join(middle, _keys(steps), "left").join(by_sample, "run_id", "left").na.fill(0.0, ["median_cuda_kernel_duration_us", *names])
    return out if "scope" in out.columns else out.withColumn("scope", F.lit(scope))


def run_summary(steps: DataFrame, samples: DataFrame, scope: str = "run") -> DataFrame:
    """One row per run that has steps, and per scope if steps have one; samples count run-wide whatever steps are given."""
    return summarise_runs(steps, merge_samples(partial_samples(samples)), scope)


def worst_steps(steps: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` steps of each run and stall label with the largest positive share; ties by step_id."""
    done = steps.where("status = 'ok' and step_wall_time_ns > 0")
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), share(F.col(c), F.col("step_wall_time_ns")).alias("value")) for label, c in STALLS])
    long = done.select("run_id", "step_id", F.explode(pairs).alias("x")).select("run_id", "step_id", "x.label", "x.value").where("value > 0")
    place = F.row_number().over(Window.partitionBy("run_id", "label").orderBy(F.desc("value"), "step_id"))
    return long.withColumn("place", place).where(F.col("place") <= n)


def measurement_window(steps: DataFrame, warmup: int = 2, measure: int = 10) -> DataFrame:
    """Summary of the completed steps [warmup, warmup + measure) of each run, in step order."""
    order = Window.partitionBy("run_id").orderBy("step_id")
    inside = shape_changes(steps).where("status = 'ok' and step_wall_time_ns > 0").withColumn("n", F.row_number().over(order)).where(F.col("n").between(warmup + 1, warmup + measure))
    return inside.groupBy("run_id").agg(
        F.count("*").alias("step_count"), F.avg("step_wall_time_ns").alias("step_time_avg_ns"), (F.count("*") / (F.sum("step_wall_time_ns") / 1e9)).alias("throughput_steps_per_sec"),
        (F.count(F.when(F.col("shape_changed"), 1)) / F.count("*")).alias("shape_volatility_ratio"),
    )
