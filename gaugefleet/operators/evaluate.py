"""Evaluation of diagnoses against rows of known outcome: adapted profiles, weak labels, warnings, leaderboards, gold."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up

# Names of the profile's percentages and the columns here; resources by their block limit.
PERCENT = {
    "Achieved Occupancy": "achieved_occupancy_pct", "Theoretical Occupancy": "theoretical_occupancy_pct", "Issue Slots Busy": "issue_slot_utilization_pct", "SM Busy": "sm_throughput_pct", "Mem Busy": "memory_busy_pct",
    "Max Bandwidth": "dram_throughput_pct", "L1/TEX Hit Rate": "l1_cache_hit_rate_pct", "L2 Hit Rate": "l2_cache_hit_rate_pct",
}
LIMITS = {"Block Limit Registers": "registers", "Block Limit Shared Mem": "shared_memory", "Block Limit Warps": "threads", "Block Limit SM": "blocks"}
# Confidence levels in order, source findings that put results at risk, words of diagnoses that agree with a weak label.
CONFIDENCE = ("low-medium", "medium", "medium-high", "high", "confirmed")
RISKS = ("conditional_syncthreads",)
FAMILIES = {
    "memory_bound": ("memory_bandwidth", "roofline_memory", "global_memory"),
    "low_occupancy": ("occupancy", "roofline_low_mfu"),
    "cache_thrashing": ("cache",),
    "low_issue_efficiency": ("issue", "low_mfu"),
}


def _parsed(text: object) -> dict | None:
    """A dictionary from its Python text; none if it is not one."""
    try:
        out = ast.literal_eval(text) if isinstance(text, str) and text.strip() else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _number(x: object) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return None if v != v else v


def adapt_eval_profile(rows: DataFrame, key: str = "row_key", profile: str = "profile") -> DataFrame:
    """One row per row with a usable profile: key, a column for each percentage, and limiters.

    A value counts as a percentage only if its unit is literally %, so byte rates never do. Limiters are
    the resources tied at the lowest positive block limit, by name.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["text"], strict=True):
                metrics = (_parsed(text) or {}).get("metrics")
                if isinstance(metrics, dict) and metrics:
                    held = {n: m for n, m in metrics.items() if isinstance(m, dict)}
                    out.append((k, [(n, _number(m.get("avg_value")), str(m.get("unit", "")).strip()) for n, m in held.items()]))
            yield pd.DataFrame(out, columns=["key", "metrics"])

    given = rows.select(F.col(key).alias("key"), F.col(profile).alias("text"))
    parsed = given.mapInPandas(run, f"key {kind}, metrics array<struct<name:string,value:double,unit:string>>")
    at = lambda cond: F.get(F.filter("metrics", cond), F.lit(0))["value"]
    of = lambda name, unit: lambda m: (m["name"] == name) & (m["unit"] == "%" if unit else F.lit(True))
    df = parsed.select(F.col("key").alias(key), *[half_up(at(of(n, True)), 4).alias(c) for n, c in PERCENT.items()], F.create_map(*[x for n, t in LIMITS.items() for x in (F.lit(t), at(of(n, False)))]).alias("__l"))
    positive = F.map_filter("__l", lambda k, v: v > 0)
    lowest = F.array_min(F.map_values(positive))
    return df.withColumn("limiters", F.array_sort(F.map_keys(F.map_filter(positive, lambda k, v: v == lowest)))).drop("__l")


def weak_label(df: DataFrame) -> DataFrame:
    """Adds weak_label, a coarse reading of a profile alone, by the first rule that holds."""
    c = F.col
    return df.withColumn("weak_label", (
        F.when(c("achieved_occupancy_pct") < 40, "low_occupancy")
        .when((c("dram_throughput_pct") > 60) & (F.coalesce("memory_busy_pct", F.lit(0.0)) >= F.coalesce("sm_throughput_pct", F.lit(0.0))), "memory_bound")
        .when((c("l1_cache_hit_rate_pct") < 40) | (c("l2_cache_hit_rate_pct") < 50), "cache_thrashing")
        .when(c("issue_slot_utilization_pct") < 60, "low_issue_efficiency").otherwise("inconclusive")
    ))


def weak_agreement(primary: Column, weak: Column) -> Column:
    """Whether a diagnosis has a word of the weak label's family."""
    out = F.lit(False)
    for label, tokens in FAMILIES.items():
        held = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.lower(primary).contains(t))
        out = F.when(weak == label, F.coalesce(held, F.lit(False))).otherwise(out)
    return out


def correctness_warning(rows: DataFrame) -> DataFrame:
    """Adds reasons and warning: error text, error-level lint output, or a risky source finding (error, lint and source_codes)."""
    lint = F.coalesce("lint", F.lit(""))
    reasons = codes(
        ("error_text", F.trim(F.coalesce("error", F.lit(""))) != ""), ("lint_error", lint.contains(": error:")),
        *[(f"risk:{r}", F.array_contains(F.coalesce("source_codes", F.array().cast("array<string>")), r)) for r in RISKS],
    )
    return rows.withColumn("reasons", reasons).withColumn("warning", F.size("reasons") > 0)


def confidence_rank(column: Column) -> Column:
    """Place among the confidence levels, from 0; -1 for none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), column) - 1, F.lit(-1))


def eval_leaderboard(records: DataFrame) -> DataFrame:
    """One row of rates over evaluation records, in one aggregate; a rate without cases is null.

    ``records`` has primary_diagnosis, confidence, severity, weak_label, correct, error, warning and speedup.
    """
    c, count = F.col, F.count_if
    concrete = F.coalesce(~c("primary_diagnosis").isin("inconclusive"), F.lit(False))
    failed = F.trim(F.coalesce("error", F.lit(""))) != ""
    judged = ~c("weak_label").isin("no_ncu", "inconclusive")
    fast = F.coalesce("speedup", F.lit(0.0)) >= 1.0
    rank = confidence_rank(c("confidence"))
    over = (c("severity") == "high") & (rank >= CONFIDENCE.index("high"))
    rate = lambda part, whole: half_up(count(part & whole) / F.nullif(count(whole), F.lit(0)), 4)
    every = F.lit(True)
    return records.agg(
        F.count("*").alias("rows_evaluated"), rate(concrete, every).alias("coverage"), rate(weak_agreement(c("primary_diagnosis"), c("weak_label")), judged).alias("weak_agreement"), count(judged).alias("weak_n"),
        rate(c("warning"), ~c("correct") & failed).alias("warned_build_errors"), rate(c("warning"), ~c("correct") & ~failed).alias("warned_silent"), rate(c("warning"), c("correct")).alias("warned_correct"),
        rate(~F.coalesce(over, F.lit(False)), fast).alias("fast_not_overclaimed"), rate(concrete, ~fast).alias("slow_explained"), rate(rank <= CONFIDENCE.index("medium-high"), every).alias("ceiling_respected"),
        F.get(F.array(*map(F.lit, CONFIDENCE)), F.nullif(F.max(rank), F.lit(-1)).cast("int")).alias("max_confidence"),
    )


def diagnosis_distribution(records: DataFrame) -> DataFrame:
    """(label, n, place) of primary diagnoses by falling count, then label; null is none."""
    counts = records.groupBy(F.coalesce("primary_diagnosis", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")))  # as many rows as labels


def gold_join(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Records with a gold entry, and whether each expectation holds (null where none is stated): primary_ok, ceiling_ok, warning_ok."""
    both = records.join(gold.select("row_key", "expected_primary", "confidence_ceiling", "expect_warning"), "row_key")
    got, want = F.col("primary_diagnosis"), F.col("expected_primary")
    primary = F.coalesce(got == want, F.lit(False)) | ((want == "inconclusive") & (got.isNull() | (got == "inconclusive")))
    return both.withColumns({
        "primary_ok": F.when(want.isNotNull(), primary), "ceiling_ok": F.when(F.col("confidence_ceiling").isNotNull(), confidence_rank(F.col("confidence")) <= confidence_rank(F.col("confidence_ceiling"))),
        "warning_ok": F.when(F.col("expect_warning").isNotNull(), F.col("warning") == F.col("expect_warning")),
    })


def gold_score(joined: DataFrame) -> DataFrame:
    """One row: matched rows, accuracy of each kind of expectation, and failures."""
    kinds = ("primary", "ceiling", "warning")
    rate = lambda k: half_up(F.count_if(F.col(f"{k}_ok")) / F.nullif(F.count(f"{k}_ok"), F.lit(0)), 4).alias(f"{k}_accuracy")
    failed = sum((F.count_if(~F.col(f"{k}_ok")) for k in kinds[1:]), F.count_if(~F.col(f"{kinds[0]}_ok")))
    return joined.agg(F.count("*").alias("matched"), *map(rate, kinds), failed.alias("failures"))


def gold_failures(joined: DataFrame) -> DataFrame:
    """(row_key, check, expected, got) of every expectation that doesn't hold; ``joined`` comes from ``gold_join``."""
    as_text = lambda c: F.col(c).cast("string")
    checks = [("primary", "primary_ok", "expected_primary", "primary_diagnosis"), ("confidence_ceiling", "ceiling_ok", "confidence_ceiling", "confidence"), ("correctness_warning", "warning_ok", "expect_warning", "warning")]
    failed = [F.when(~F.col(ok), F.struct(F.lit(name).alias("check"), as_text(want).alias("expected"), as_text(got).alias("got"))) for name, ok, want, got in checks]
    return joined.select("row_key", F.explode(F.array_compact(F.array(*failed))).alias("f")).select("row_key", "f.*")
