"""Loss quality, timing runs and bundle completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up

# Quality limits, and the artifacts of a complete bundle.
MAX_FINAL_REGRESSION, MAX_DIVERGENCE, OUTPUT_TOLERANCE = 0.05, 0.5, 0.005
REQUIRED = ("gpu_metrics", "logs", "metadata", "run_config")
RECOMMENDED = ("derived_summary", "profiler_trace", "raw_trace")


def loss_quality(steps: DataFrame) -> DataFrame:
    """Per run: finite, NaN and infinite losses (each counted once), first, last, least, most and slope by step."""
    loss = F.col("loss").cast("double")
    nan, endless = F.isnan(loss), loss.isin(float("inf"), float("-inf"))
    good = F.when(loss.isNotNull() & ~nan & ~endless, loss)
    order = F.when(good.isNotNull(), F.col("step_id"))
    out = steps.groupBy("run_id").agg(
        F.count(good).alias("loss_count"), F.count_if(F.coalesce(nan, F.lit(False))).alias("nan_count"), F.count_if(F.coalesce(endless, F.lit(False))).alias("inf_count"),
        F.min_by(good, order).alias("initial_loss"), F.max_by(good, order).alias("final_loss"), F.min(good).alias("min_loss"), F.max(good).alias("max_loss"),
    )
    return out.withColumn("loss_slope", F.col("final_loss") - F.col("initial_loss"))


def quality_gate(pairs: DataFrame) -> DataFrame:
    """Adds quality_failures to trial losses beside their baseline's final loss (b_final_loss)."""
    final, first, base = F.col("final_loss"), F.col("initial_loss"), F.col("b_final_loss")
    diff = F.col("max_output_abs_diff") if "max_output_abs_diff" in pairs.columns else F.lit(None).cast("double")
    return pairs.withColumn("quality_failures", codes(
        ("nan_loss", F.col("nan_count") > 0), ("inf_loss", F.col("inf_count") > 0), ("final_loss", (base > 0) & (final > base * (1 + MAX_FINAL_REGRESSION))),
        ("divergence", (first > 0) & (final > first * (1 + MAX_DIVERGENCE))), ("output_drift", diff > OUTPUT_TOLERANCE),
    ))


def bench_timing_stats(runs: DataFrame, warmup: int = 2) -> DataFrame:
    """Timing of each binary without its warm-up runs: median, least, most and deviation, and median event time."""
    kept = runs.where(F.col("iteration") >= warmup)
    return kept.groupBy("binary").agg(
        half_up(F.percentile("wall_ms", 0.5), 3).alias("median_ms"), half_up(F.min("wall_ms"), 3).alias("min_ms"), half_up(F.max("wall_ms"), 3).alias("max_ms"),
        half_up(F.coalesce(F.stddev_samp("wall_ms"), F.lit(0.0)), 3).alias("stdev_ms"), half_up(F.percentile("event_us", 0.5), 4).alias("kernel_event_us"), F.count("*").alias("runs"),
    )


def speedup_basis(before: DataFrame, after: DataFrame) -> DataFrame:
    """Speedup of each pair on the best basis that both sides have: event time, kernel time, wall time."""
    names = ("kernel_event_us", "kernel_us", "median_ms")
    side = lambda df, p: df.select("pair_id", *[(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(f"{p}{c}") for c in names])
    both = side(before, "b_").join(side(after, "a_"), "pair_id")

    def ratio(c: str) -> Column:
        return F.when(F.col(f"a_{c}") > 0, half_up(F.col(f"b_{c}") / F.col(f"a_{c}"), 4))

    basis = F.when(ratio(names[0]).isNotNull(), "cuda_event").when(ratio(names[1]).isNotNull(), "kernel_gpu_time").otherwise("wall_clock")
    return both.select("pair_id", F.coalesce(*map(ratio, names)).alias("speedup_x"), basis.alias("basis"))


def bundle_completeness(artifacts: DataFrame) -> DataFrame:
    """Per run: required and recommended artifacts that are missing, and whether it can be diagnosed or is limited."""
    have = artifacts.groupBy("run_id").agg(F.collect_set("artifact").alias("have"))
    lack = lambda names: F.array_except(F.array(*map(F.lit, names)), F.col("have"))
    ready = F.arrays_overlap("have", F.array(*map(F.lit, RECOMMENDED)))
    return have.select("run_id", lack(REQUIRED).alias("missing_required"), lack(RECOMMENDED).alias("missing_recommended"), ready.alias("diagnostic_ready"), ((F.size(lack(REQUIRED)) > 0) | ~ready).alias("limited"))


def source_precedence(sources: DataFrame) -> DataFrame:
    """The best source present of each run: derived summary, raw trace, then profiler trace."""
    rank = F.when(F.col("source") == "derived_summary", 0).when(F.col("source") == "raw_trace", 1).when(F.col("source") == "profiler_trace", 2)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("__rank", "source"))
    return sources.withColumn("__rank", rank).where("__rank is not null").withColumn("__n", place).where("__n = 1").select("run_id", "source")


def orphan_step_refs(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """Metrics whose step has no event in their run."""
    known = events.select("run_id", "step_id").where("step_id is not null").distinct()
    return metrics.where("step_id is not null").join(known, ["run_id", "step_id"], "left_anti")
