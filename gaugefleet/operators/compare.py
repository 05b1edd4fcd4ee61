"""Before and after: label differences, metric deltas and verdicts over pairs of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up

# Compared metrics and whether more is better.
DIRECTIONS = {
    "avg_dram_throughput_pct": False, "avg_tensor_core_utilization_pct": True, "avg_l1_cache_hit_rate_pct": True, "avg_l2_cache_hit_rate_pct": True,
    "avg_global_load_sectors_per_request": False, "avg_issue_slot_utilization_pct": True, "avg_occupancy_pct": True, "memory_stall_fraction": False,
}


def _on(side: str, value: str) -> Column:
    """The value of a group's row on one side, null if there is none."""
    return F.max(F.when(F.col("side") == side, F.col(value)))


def bottleneck_diff(labels: DataFrame) -> DataFrame:
    """(pair_id, label) with both scores and status: resolved, new, improved (drop over 0.02) or persistent.

    ``labels`` has pair_id, side (``before`` or ``after``), label and score.
    """
    both = labels.groupBy("pair_id", "label").agg(_on("before", "score").alias("score_before"), _on("after", "score").alias("score_after"))
    status = F.when(F.col("score_after").isNull(), "resolved").when(F.col("score_before").isNull(), "new").when(F.col("score_before") - F.col("score_after") > 0.02, "improved").otherwise("persistent")
    return both.withColumn("status", status)


def metric_deltas(sides: DataFrame) -> DataFrame:
    """(pair_id, metric, before, after, delta, direction) for metrics that both sides of a pair have; ``sides`` has pair_id and side."""
    names = list(DIRECTIONS)
    values = F.struct(*[F.struct(_on("before", c).cast("double").alias("before"), _on("after", c).cast("double").alias("after")).alias(c) for c in names])
    pairs = sides.groupBy("pair_id").agg(values.alias("v"))
    tall = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col("v")[c].alias("x")) for c in names])).alias("m"))
    both = tall.select("pair_id", "m.metric", "m.x.before", "m.x.after").where("before is not null and after is not null").withColumn("delta", half_up(F.col("after") - F.col("before"), 4))
    better = F.create_map(*[x for k, v in DIRECTIONS.items() for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    return both.withColumn("direction", F.when(F.abs("delta") < 0.001, "neutral").when((F.col("delta") > 0) == better, "improved").otherwise("regressed"))


def headline_metric(deltas: DataFrame) -> DataFrame:
    """The metric of each pair with the largest absolute delta, ties by name."""
    return deltas.groupBy("pair_id").agg(F.max_by("metric", F.struct(F.abs("delta"), F.col("metric"))).alias("metric"), F.max(F.abs("delta")).alias("abs_delta"))


def kernel_diff_verdict(sides: DataFrame, diff: DataFrame) -> DataFrame:
    """Outcome of each pair of which both sides are there, by kernel time (ratio 1.05 and 0.95), else by labels; both are kept."""
    t = sides.groupBy("pair_id").agg(_on("before", "total_kernel_duration_us").alias("t0"), _on("after", "total_kernel_duration_us").alias("t1"), F.countDistinct("side").alias("n_sides")).where("n_sides = 2")
    ratio = F.when((F.col("t0") > 0) & (F.col("t1") > 0), half_up(F.col("t0") / F.col("t1"), 4))
    by_time = F.when(ratio >= 1.05, "improved").when(ratio <= 0.95, "regressed").when(ratio.isNotNull(), "neutral")
    n = diff.groupBy("pair_id").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("resolved", "new", "improved")])
    gone, new = F.coalesce(F.col("resolved") > 0, F.lit(False)), F.coalesce(F.col("new") > 0, F.lit(False))
    by_label = F.when(gone & ~new, "improved").when(new & ~gone, "regressed").when(gone & new, "mixed").when(F.col("improved") > 0, "improved").otherwise("neutral")
    return t.join(n, "pair_id", "left").select("pair_id", ratio.alias("time_ratio"), by_label.alias("label_outcome"), F.coalesce(by_time, by_label).alias("outcome"))


# --- versions of a kernel: findings, features, numbers, scores --------------------------------------

# Compared numbers and whether more is better; compared flags.
NUMBERS = {
    "kernel_count": False, "launch_count": False, "shared_memory_alloc_count": True, "register_count": False, "local_memory_bytes": False, "instruction_count": False, "global_load_count": False, "global_store_count": False,
    "shared_load_count": True, "shared_store_count": True, "spill_load_count": False, "spill_store_count": False, "branch_count": False, "conditional_branch_count": False, "avg_dram_throughput_pct": False, "avg_l1_cache_hit_rate_pct": True,
    "avg_l2_cache_hit_rate_pct": True, "avg_issue_slot_utilization_pct": True, "avg_occupancy_pct": True, "avg_tensor_core_utilization_pct": True, "memory_stall_fraction": False, "compute_stall_fraction": False,
}
FLAGS = ("has_bank_conflict_risk", "atomics_used", "reductions_used", "has_register_spills")
# Dimensions of the scorecard and their weights, and the difference that is a tie.
WEIGHTS = {"register_efficiency": 0.15, "memory_efficiency": 0.25, "compute_efficiency": 0.25, "launch_efficiency": 0.15, "sync_efficiency": 0.20}
TIE = 0.02


def finding_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, code, status) over the distinct codes of (pair_id, code) on both sides: resolved, new or shared."""
    a, b = (df.select("pair_id", "code").where("code <> ''").distinct().withColumn(n, F.lit(True)) for df, n in ((before, "a"), (after, "b")))
    return a.join(b, ["pair_id", "code"], "full_outer").select("pair_id", "code", F.when(F.col("b").isNull(), "resolved").when(F.col("a").isNull(), "new").otherwise("shared").alias("status"))


def feature_set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, added, removed) of arrays of features, one row per pair on each side; a missing side has none."""
    none = F.array().cast("array<string>")
    both = before.select("pair_id", F.col("features").alias("a")).join(after.select("pair_id", F.col("features").alias("b")), "pair_id", "full_outer").withColumns({c: F.coalesce(c, none) for c in ("a", "b")})
    return both.select("pair_id", F.array_sort(F.array_except("b", "a")).alias("added"), F.array_sort(F.array_except("a", "b")).alias("removed"))


def instruction_mix_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, category, before, after, delta) of counts (pair_id, category, n); a missing category counts 0."""
    both = before.select("pair_id", "category", F.col("n").alias("before")).join(after.select("pair_id", "category", F.col("n").alias("after")), ["pair_id", "category"], "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def numeric_bool_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, field, before, after, delta, better, change): the compared numbers and flags that the sides have as columns.

    ``better`` is a, b or tie where both sides have a number; ``change`` of a flag is resolved, introduced or empty.
    """
    have = [c for c in (*NUMBERS, *FLAGS) if c in before.columns or c in after.columns]

    def tall(df: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in have]
        return df.select("pair_id", *columns).unpivot("pair_id", have, "field", name)

    both = tall(before, "before").join(tall(after, "after"), ["pair_id", "field"], "full_outer").where("before is not null or after is not null")
    flag, up = F.col("field").isin(*FLAGS), F.col("field").isin(*[k for k, v in NUMBERS.items() if v])
    delta = F.when(~flag, F.col("after") - F.col("before"))
    a, b = (F.coalesce(F.col(c) > 0, F.lit(False)) for c in ("before", "after"))
    better = F.when(delta == 0, "tie").when((delta > 0) == up, "b").when(delta.isNotNull(), "a")
    return both.select("pair_id", "field", "before", "after", delta.alias("delta"), better.alias("better"), F.when(flag & a & ~b, "resolved").when(flag & ~a & b, "introduced").when(flag, "").alias("change"))


def tradeoffs(diff: DataFrame) -> DataFrame:
    """(pair_id, label) of contradictions between registers and occupancy in a numeric_bool_diff."""
    at = lambda field, c: F.max(F.when(F.col("field") == field, F.col(c)))
    by_pair = diff.groupBy("pair_id").agg(at("register_count", "better").alias("reg"), at("has_register_spills", "change").alias("spill"), at("avg_occupancy_pct", "better").alias("occ"), at("avg_occupancy_pct", "delta").alias("d"))
    true = lambda c: F.coalesce(c, F.lit(False))
    up, down = true(F.col("reg") == "b") | true(F.col("spill") == "resolved"), true(F.col("reg") == "a") | true(F.col("spill") == "introduced")
    labels = codes(
        ("register_pressure_improved_but_occupancy_regressed", up & (F.col("occ") == "a")), ("occupancy_improved_but_register_pressure_regressed", down & (F.col("occ") == "b")),
        ("large_occupancy_shift", (F.abs("d") >= 20.0) & ~(up | down)),
    )
    return by_pair.select("pair_id", F.explode(labels).alias("label"))


def _unit(c: Column) -> Column:
    """Within 0 and 1; null stays null (least and greatest skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def _mean(*parts: tuple[Column, float]) -> Column:
    """Weighted mean of the parts that are not null; null if none is."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return F.when(weight > 0, total / weight)


def version_scores(df: DataFrame) -> DataFrame:
    """(pair_id, dimension, score) of one side: profile first, compiled text where there is none.

    ``df`` has the profile means, register_count, has_register_spills, instruction, load and branch counts of compiled text
    (null where a layer is missing), and source_codes, the array of source findings (null without source).
    """
    c, ops = F.col, F.greatest(F.col("instruction_count"), F.lit(1))
    part = lambda *names: sum((c(n) for n in names[1:]), c(names[0])) / ops
    compiled = _unit(1.0 - _unit(part("global_load_count", "global_store_count") / 0.40) + F.least(F.lit(0.20), F.greatest(F.lit(0.0), part("shared_load_count", "shared_store_count") / 0.20)))
    code = lambda name: F.array_contains("source_codes", name)
    scores = {
        "register_efficiency": F.when(c("has_register_spills"), 0.0).otherwise(_unit(1.0 - (c("register_count") - 32) / 96)),
        "memory_efficiency": F.coalesce(_mean((_unit(1.0 - c("avg_dram_throughput_pct") / 100), 0.30), (_unit(c("avg_l1_cache_hit_rate_pct") / 100), 0.40), (_unit(c("avg_l2_cache_hit_rate_pct") / 100), 0.30)), F.when(c("instruction_count").isNotNull(), compiled)),
        "compute_efficiency": F.coalesce(_mean((_unit(c("avg_issue_slot_utilization_pct") / 100), 0.60), (_unit(c("avg_occupancy_pct") / 100), 0.40)), F.when(c("instruction_count").isNotNull(), _unit(1.0 - part("conditional_branch_count") / 0.15))),
        "launch_efficiency": F.coalesce(_unit(c("avg_occupancy_pct") / 100), F.when(c("source_codes").isNotNull(), _unit(1.0 - F.when(code("possible_shared_memory_bank_conflict"), 0.20).otherwise(0.0) - F.when(code("missing_obvious_bounds_guard"), 0.10).otherwise(0.0)))),
        "sync_efficiency": F.when(c("source_codes").isNotNull(), _unit(1.0 - F.when(code("conditional_syncthreads"), 0.40).otherwise(0.0) - F.when(code("unnecessary_syncthreads"), 0.25).otherwise(0.0))),
    }
    scores["register_efficiency"] = F.when(c("register_count").isNotNull(), scores["register_efficiency"])
    return df.select("pair_id", *[v.alias(k) for k, v in scores.items()]).unpivot("pair_id", list(scores), "dimension", "score")


def scorecard(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, dimension, score_a, score_b, winner) of two version_scores; dimensions that neither side has drop out."""
    both = before.withColumnRenamed("score", "a").join(after.withColumnRenamed("score", "b"), ["pair_id", "dimension"], "full_outer").where("a is not null or b is not null")
    gain = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return both.select("pair_id", "dimension", half_up(F.col("a"), 4).alias("score_a"), half_up(F.col("b"), 4).alias("score_b"), F.when(gain > TIE, "b").when(gain < -TIE, "a").otherwise("tie").alias("winner"))


def scorecard_verdict(card: DataFrame) -> DataFrame:
    """(pair_id, score_a, score_b, overall_winner): means weighted over the dimensions there are."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("dimension")]
    mean = lambda c: half_up(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * weight) / F.sum(weight), 4)
    out = card.groupBy("pair_id").agg(mean("score_a").alias("score_a"), mean("score_b").alias("score_b"))
    gain = half_up(F.col("score_b") - F.col("score_a"), 4)
    return out.withColumn("overall_winner", F.when(gain > TIE, "b").when(gain < -TIE, "a").otherwise("tie"))


def case_validation(cases: DataFrame, before: DataFrame, diff: DataFrame) -> DataFrame:
    """(pair_id, missing_before, missing_resolved, new_findings, passed) of cases (pair_id, detected_before, resolved_after, no_new_findings).

    ``before`` has (pair_id, code), ``diff`` is a finding_diff.
    """
    none = F.array().cast("array<string>")
    had = before.groupBy("pair_id").agg(F.collect_set("code").alias("had"))
    by_pair = diff.groupBy("pair_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("code")))).alias(s) for s in ("resolved", "new")])
    both = cases.join(had, "pair_id", "left").join(by_pair, "pair_id", "left").withColumns({c: F.coalesce(c, none) for c in ("had", "resolved", "new")})
    out = both.select("pair_id", F.array_except("detected_before", "had").alias("missing_before"), F.array_except("resolved_after", "resolved").alias("missing_resolved"), F.when(F.col("no_new_findings"), F.col("new")).otherwise(none).alias("new_findings"))
    return out.withColumn("passed", (F.size("missing_before") == 0) & (F.size("missing_resolved") == 0) & (F.size("new_findings") == 0))
