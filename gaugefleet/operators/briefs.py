"""One row per run that says what limits it and what to do first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up
from gaugefleet.operators.presets import BANDS

PHASES = ("input_bound", "copy_bound", "sync_bound")


def _first(rows: DataFrame, place: str, name: str, n: int, out: str) -> DataFrame:
    """The first ``n`` names of each run by place."""
    few = rows.where(F.col(place) <= n).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(place, name))).alias("x"))
    return few.select("run_id", F.transform("x", lambda e: e[name]).alias(out))


def run_brief(diagnoses: DataFrame, runs: DataFrame, labels: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per run: the preferred scope (steady state, else the run), its label, shares of wait phases, three recommendations, missing data.

    ``diagnoses`` and ``runs`` have both scopes, ``labels`` those that fired, ``recommendations`` run_id, rec and place.
    """
    steady = runs.where("scope = 'steady' and completed_steps > 0").select("run_id", F.lit("steady").alias("best"))
    chosen = runs.join(steady, "run_id", "left").where("scope = coalesce(best, 'run')").drop("best")
    both = chosen.join(diagnoses.select("run_id", "scope", "user_facing_bottleneck", "secondary_bottlenecks", "confidence_score", "confidence_level"), ["run_id", "scope"])
    fired = labels.where(F.col("label").isin(*PHASES)).groupBy("run_id", "scope").agg(*[F.max(F.when(F.col("label") == p, F.col("score"))).alias(f"{p}_fraction") for p in PHASES])
    out = both.join(fired, ["run_id", "scope"], "left").join(_first(recommendations, "place", "rec", 3, "top_recommendations"), "run_id", "left")
    missing = codes(("profiler", F.col("profiler_windows_exported") == 0), ("gpu_samples", F.col("average_gpu_utilization_pct") == 0))
    return out.select(
        "run_id", "scope", F.col("completed_steps").alias("steps"), "user_facing_bottleneck", "secondary_bottlenecks", "confidence_score", "confidence_level", *[half_up(F.col(f"{p}_fraction"), 4).alias(f"{p}_fraction") for p in PHASES],
        "average_gpu_utilization_pct", "throughput_steps_per_sec", F.coalesce("top_recommendations", F.array().cast("array<string>")).alias("top_recommendations"), missing.alias("missing_data"),
    )


def kernel_brief(summaries: DataFrame, labels: DataFrame, primary: DataFrame, opportunities: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per profiled run: the primary diagnosis (reconciled, else the classifier's top), banded metrics, five kernels, three recommendations.

    ``labels`` has run_id, label, score and rule_no; ``primary`` run_id and label; ``opportunities`` run_id, kernel_name and place.
    """
    top = labels.groupBy("run_id").agg(F.max_by("label", F.struct("score", -F.col("rule_no"))).alias("top_label"))
    out = summaries.join(primary.select("run_id", F.col("label").alias("reconciled")), "run_id", "left").join(top, "run_id", "left")
    out = out.join(_first(opportunities, "place", "kernel_name", 5, "top_kernels"), "run_id", "left").join(_first(recommendations, "place", "rec", 3, "top_recommendations"), "run_id", "left")
    list_ = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    stall: Column = F.when(F.col("dominant_warp_stall") != "unknown", F.col("dominant_warp_stall"))
    return out.select("run_id", F.coalesce("reconciled", "top_label").alias("primary_diagnosis"), *[m for m in BANDS if m in summaries.columns], stall.alias("dominant_warp_stall"), list_("top_kernels"), list_("top_recommendations"))
