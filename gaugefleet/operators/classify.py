"""Bottleneck labels, ranking, diagnosis and signals over run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import environment, flags, half_up, numbers

# Cuts of the classifier.
CUTS = {"input": 0.2, "copy": 0.15, "sync": 0.1, "util": 35.0, "memory": 0.9, "shape": 0.3, "launch_util": 50.0, "launch_stall": 0.1, "tax_high": 45.0, "tax_moderate": 20.0}
LABELS = ("input_bound", "copy_bound", "sync_bound", "underutilized_gpu", "memory_pressure", "shape_instability", "launch_bound", "insufficient_telemetry")
SYMPTOMS = ("underutilized_gpu", "launch_bound")
ROOT_CAUSES = ("input_bound", "copy_bound", "sync_bound")


def classify_run(runs: DataFrame, cuts: dict[str, float] = CUTS) -> DataFrame:
    """One row per (run_id, scope, label) over its cut, with score and rule_no. Cuts are inclusive."""
    util, c = F.col("average_gpu_utilization_pct"), cuts
    ratio = {s: F.col(f"{s}_bound_ratio") for s in ("input", "copy", "sync")}
    calm = (ratio["input"] < c["launch_stall"]) & (ratio["copy"] < c["launch_stall"]) & (ratio["sync"] < c["launch_stall"])
    launch = half_up(F.least(F.lit(0.5), F.greatest(F.lit(0.3), (50.0 - util) / 100.0 + 0.3)), 4)
    rules: list[tuple[Column, Column]] = [
        (ratio["input"] >= c["input"], ratio["input"]),
        (ratio["copy"] >= c["copy"], ratio["copy"]),
        (ratio["sync"] >= c["sync"], ratio["sync"]),
        ((util > 0) & (util < c["util"]), 1.0 - util / 100.0),
        (F.col("memory_pressure_peak_ratio") >= c["memory"], F.col("memory_pressure_peak_ratio")),
        (F.col("shape_volatility_ratio") >= c["shape"], F.col("shape_volatility_ratio")),
        ((F.col("profiler_windows_exported") > 0) & (util < c["launch_util"]) & calm, launch),
        ((util <= 0) & (F.col("dominant_stall_type") == "unknown"), F.lit(1.0)),
    ]
    found = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(label).alias("label"), half_up(score, 4).alias("score"), F.lit(i).alias("rule_no"))) for i, (label, (cond, score)) in enumerate(zip(LABELS, rules, strict=True))]),
        lambda x: x.isNotNull(),
    )
    return runs.where("completed_steps > 0").select("run_id", "scope", F.explode(found).alias("x")).select("run_id", "scope", "x.*")


def rank_bottlenecks(labels: DataFrame) -> DataFrame:
    """Adds place: by falling score, ties in rule order."""
    return labels.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "scope").orderBy(F.desc("score"), "rule_no")))


def diagnose_run(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """Primary and secondary labels, the label shown to users, and confidence of every run."""
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    by_run = ranked.groupBy("run_id", "scope").agg(
        at(1, "label").alias("primary"), at(1, "score").alias("top"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("second"), F.count("*").alias("n"),
        F.concat_ws(",", at(2, "label"), at(3, "label")).alias("secondary_bottlenecks"), F.collect_set("label").alias("labels"),
    )
    both = runs.select("run_id", "scope", "dominant_stall_type", "profiler_windows_exported").join(by_run, ["run_id", "scope"], "left")
    gap, stall = F.col("top") - F.col("second"), F.col("dominant_stall_type")
    bonus = F.when(F.col("n") == 1, 0.15).otherwise(0.0) + F.when(gap >= 0.25, 0.15).when(gap >= 0.1, 0.1).when(gap > 0, 0.05).otherwise(0.0)
    bonus = bonus + F.when(stall == F.col("primary"), 0.1).when(~stall.isin("unknown", "compute_bound"), -0.05).otherwise(0.0)
    score = F.coalesce(half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top") + bonus)), 4), F.lit(0.0))
    none = F.when(F.col("profiler_windows_exported") > 0, "inconclusive")
    root = F.coalesce(*[F.when(F.array_contains("labels", c), c) for c in ROOT_CAUSES], F.col("primary"))
    return both.select(
        "run_id", "scope", F.coalesce("primary", none).alias("primary_bottleneck"),
        F.coalesce(F.when(F.col("primary").isin(*SYMPTOMS), root).otherwise(F.col("primary")), none).alias("user_facing_bottleneck"),
        F.coalesce("secondary_bottlenecks", F.lit("")).alias("secondary_bottlenecks"), score.alias("confidence_score"),
        F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low").alias("confidence_level"),
    )


def steady_vs_run(diagnoses: DataFrame) -> DataFrame:
    """The primary bottleneck of each run in both scopes, and whether steady state changes it."""
    of = lambda scope: F.max(F.when(F.col("scope") == scope, F.col("primary_bottleneck")))
    both = diagnoses.groupBy("run_id").agg(of("run").alias("run_primary"), of("steady").alias("steady_primary"))
    return both.withColumn("diagnosis_changed", ~F.col("run_primary").eqNullSafe(F.col("steady_primary")))


def framework_tax(runs: DataFrame, cuts: dict[str, float] = CUTS) -> DataFrame:
    """Idle GPU time that the data pipeline does not explain, weighted by launch fragmentation; runs with windows only."""
    one = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    over = lambda s: F.when(F.col(f"{s}_bound_ratio") >= cuts[s], half_up(F.col(f"{s}_bound_ratio"), 4)).otherwise(0.0)
    pipeline = over("input") + over("copy") + over("sync")
    idle = F.greatest(F.lit(0.0), (1.0 - one(F.col("average_gpu_utilization_pct") / 100.0)) - pipeline)
    small, per_step, volatile = one(F.col("small_kernel_fraction")), F.col("kernel_count_per_step"), one(F.col("shape_volatility_ratio"))
    pieces = one(0.6 * small + 0.4 * F.least(F.lit(1.0), per_step / 200.0))
    score = F.floor(F.least(F.lit(100.0), 100.0 * idle * (0.5 + 0.5 * pieces)) + 0.5).cast("long")
    df = runs.where("profiler_windows_exported > 0").select("run_id", "scope", half_up(idle, 4).alias("overhead_idle_fraction"), half_up(pipeline, 4).alias("pipeline_idle_fraction"), score.alias("score"), idle.alias("i"), pieces.alias("p"), small.alias("s"), volatile.alias("v"), per_step.alias("k"))
    points = lambda c: F.floor(100.0 * c + 0.5).cast("long")
    told = (F.col("score") >= cuts["tax_moderate"]) & (F.col("i") >= 0.05)
    parts = F.array(
        F.when(told & (F.col("p") > 0.10), F.struct((-points(F.col("p"))).alias("o"), F.lit(0).alias("n"), F.lit("launch_fragmentation").alias("name"))),
        F.when(told & (F.col("v") < cuts["shape"]) & (F.col("k") >= 30.0), F.struct((-points(F.col("i") * (0.5 + 0.5 * F.col("p")))).alias("o"), F.lit(1).alias("n"), F.lit("graph_capture").alias("name"))),
        F.when(told & (F.col("s") >= 0.40), F.struct((-points(F.col("s") * 0.5)).alias("o"), F.lit(2).alias("n"), F.lit("unfused_elementwise").alias("name"))),
        F.when(told & (F.col("v") >= 0.30), F.struct((-points(F.col("v"))).alias("o"), F.lit(3).alias("n"), F.lit("dynamic_shapes").alias("name"))),
    )
    names = F.transform(F.array_sort(F.filter(parts, lambda x: x.isNotNull())), lambda x: x["name"])
    band = F.when(F.col("score") >= cuts["tax_high"], "high").when(F.col("score") >= cuts["tax_moderate"], "moderate").otherwise("low")
    return df.select("run_id", "scope", "overhead_idle_fraction", "pipeline_idle_fraction", "score", band.alias("severity"), F.array_join(names, ",").alias("contributors"))


def extract_signals(runs: DataFrame, cuts: dict[str, float] = CUTS) -> DataFrame:
    """What rules are written against: ``signals`` (name to value as text) and ``numbers`` (name to double) of every run.

    An ``environment`` column (map of text) is read if it is there.
    """
    over = {s: F.when(F.col(f"{s}_bound_ratio") >= cuts[s], half_up(F.col(f"{s}_bound_ratio"), 4)).otherwise(0.0) for s in ("input", "copy", "sync")}
    util, memory, shape, windows = F.col("average_gpu_utilization_pct"), F.col("memory_pressure_peak_ratio"), F.col("shape_volatility_ratio"), F.col("profiler_windows_exported")
    env = F.col("environment") if "environment" in runs.columns else None
    signals = flags({
        "low_gpu_activity": util < 50.0, "very_low_gpu_activity": util < 35.0, "unstable_gpu_util": F.col("utilization_instability_pct") > 20.0,
        "input_pipeline_stalled": over["input"] >= 0.20, "input_pipeline_severe": over["input"] >= 0.40,
        "h2d_copy_low": over["copy"] < 0.05, "h2d_copy_stalled": over["copy"] >= 0.15, "h2d_copy_severe": over["copy"] >= 0.30,
        "sync_heavy": over["sync"] >= 0.10, "sync_severe": over["sync"] >= 0.25,
        "memory_near_capacity": memory >= 0.90, "memory_pressure_moderate": (memory >= 0.75) & (memory < 0.90),
        "shapes_unstable": shape >= 0.30, "shapes_highly_unstable": shape >= 0.60,
        "has_profiler_data": windows > 0, "step_time_variable": F.col("step_time_cv") > 0.15, **environment(env),
    })
    gpus = F.lit(1) if env is None else F.coalesce(env["num_gpus"].try_cast("int"), F.lit(1))
    kind = F.lit("unknown") if env is None else F.coalesce(env["gpu_type"], env["gpu_model"], F.lit("unknown"))
    values = numbers({
        "gpu_util_pct": util, "input_frac": over["input"], "h2d_frac": over["copy"], "sync_frac": over["sync"], "memory_peak_ratio": memory,
        "shape_volatility": shape, "profiler_windows": windows, "step_time_cv": half_up(F.col("step_time_cv"), 4), "num_gpus": gpus,
    })
    return runs.select("run_id", "scope", F.map_concat(signals, F.create_map(F.lit("gpu_type"), kind)).alias("signals"), values.alias("numbers"), over["input"].alias("input_frac"), over["copy"].alias("h2d_frac"), over["sync"].alias("sync_frac"), "step_time_cv")
