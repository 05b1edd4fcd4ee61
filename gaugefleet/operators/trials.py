"""Trials and variants: repeats, guards, noise, screening, winners, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugefleet.functions import codes, half_up
from gaugefleet.operators.ranges import medians

# Promotion thresholds.
MIN_SPEEDUP, MAX_MEMORY, MAX_STEP_REGRESSION, MIN_STEPS = 0.08, 0.90, 0.10, 3


def repeat_aggregate(trials: DataFrame) -> DataFrame:
    """Repeats of each (job, config) to one trial: medians of positive values, worst memory, fewest steps, all guards, the most common stall."""
    key, names = ["job", "config"], ("throughput", "gpu_util", "step_ms")
    tall = trials.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select(*key, "x.metric", "x.v")
    middle = medians(tall, [*key, "metric"], "v", "v").groupBy(*key).agg(*[F.max(F.when(F.col("metric") == c, F.col("v"))).alias(c) for c in names])
    stalls = trials.where("dominant_stall <> ''").groupBy(*key, "dominant_stall").agg(F.count("*").alias("n"))
    common = stalls.groupBy(*key).agg(F.min_by("dominant_stall", F.struct(-F.col("n"), F.col("dominant_stall"))).alias("dominant_stall"))
    repeats = trials.groupBy(*key).agg(
        F.count("*").alias("repeat_count"), F.coalesce(F.min_by("exit_code", F.when(F.col("exit_code") != 0, F.col("repeat"))), F.lit(0)).cast("long").alias("exit_code"),
        F.max("memory_ratio").alias("memory_ratio"), F.min("step_count").alias("step_count"), F.bool_and("passed_guards").alias("passed_guards"),
        F.coalesce(F.stddev_samp(F.when(F.col("throughput") > 0, F.col("throughput"))), F.lit(0.0)).alias("throughput_stddev"),
    )
    out = repeats.join(middle, key, "left").join(common, key, "left").na.fill(0.0, list(names)).na.fill("unknown", ["dominant_stall"])
    return out.select(*key, "repeat_count", "exit_code", *names, "memory_ratio", "step_count", "passed_guards", "throughput_stddev", "dominant_stall")


def with_baseline(trials: DataFrame, baseline: int = 0) -> DataFrame:
    """Each trial beside its job's baseline configuration (columns b_*)."""
    b = trials.where(F.col("config") == baseline).select("job", *[F.col(c).alias(f"b_{c}") for c in ("throughput", "step_ms", "throughput_stddev", "repeat_count")])
    return trials.where(F.col("config") != baseline).join(b, "job")


def guard_checks(pairs: DataFrame) -> DataFrame:
    """Adds guard_failures (codes) to trials with their baseline."""
    slower = F.when((F.col("b_step_ms") > 0) & (F.col("step_ms") > 0), (F.col("step_ms") - F.col("b_step_ms")) / F.col("b_step_ms"))
    return pairs.withColumn("guard_failures", codes(
        ("exit_code", F.col("exit_code") != 0), ("too_few_steps", F.col("step_count") < MIN_STEPS), ("zero_throughput", F.col("throughput") <= 0),
        ("memory", F.col("memory_ratio") > MAX_MEMORY), ("step_time_regression", slower > MAX_STEP_REGRESSION),
    ))


def noise_band(pairs: DataFrame) -> DataFrame:
    """Adds throughput_delta, noise_band (larger relative deviation of both sides) and confidence_label."""
    relative = lambda p: F.when((F.col(f"{p}repeat_count") > 1) & (F.col(f"{p}throughput") > 0), F.col(f"{p}throughput_stddev") / F.col(f"{p}throughput")).otherwise(0.0)
    delta = F.when((F.col("b_throughput") > 0) & (F.col("throughput") > 0), (F.col("throughput") - F.col("b_throughput")) / F.col("b_throughput")).otherwise(0.0)
    df = pairs.withColumns({"throughput_delta": delta, "noise_band": F.greatest(relative(""), relative("b_"))})
    n, gain, band = F.least("repeat_count", "b_repeat_count"), F.col("throughput_delta"), F.col("noise_band")
    label = F.when(n < 2, "low").when(gain <= F.greatest(band, F.lit(MIN_SPEEDUP)), "inconclusive").when((n >= 3) & (gain - band >= MIN_SPEEDUP), "high").when(gain - band >= MIN_SPEEDUP / 2, "medium").otherwise("low")
    within = (n > 1) & (gain > 0) & (gain <= band)
    return df.withColumns({"confidence_label": label, "within_noise": within})


def _guarded() -> Column:
    """Whether no guard failed, neither in the aggregate nor in any repeat."""
    return (F.size("guard_failures") == 0) & F.coalesce("passed_guards", F.lit(True))


def race_screening(pairs: DataFrame, promote: int = 2) -> DataFrame:
    """Adds place and decision: order by clean exit, guards, delta, throughput; the first viable ones go on."""
    clean, ok = F.col("exit_code") == 0, _guarded()
    order = [F.desc(clean.cast("int")), F.desc(ok.cast("int")), F.desc("throughput_delta"), F.desc("throughput"), F.col("config")]
    viable = clean & ok & (F.col("throughput") > 0)
    rank = F.row_number().over(Window.partitionBy("job").orderBy(*order))
    good = F.row_number().over(Window.partitionBy("job").orderBy(F.desc(viable.cast("int")), *order))
    return pairs.withColumns({"place": rank, "decision": F.when(viable & (good <= promote), "promoted").when(clean & ok, "slower").otherwise("guard_failure")})


def select_winner(pairs: DataFrame) -> DataFrame:
    """The viable trial of each job with the highest throughput at the minimum speedup; null where none is."""
    viable = (F.col("exit_code") == 0) & _guarded() & (F.col("throughput") > 0) & (F.col("throughput_delta") >= MIN_SPEEDUP) & ~F.col("within_noise")
    return pairs.groupBy("job").agg(F.max_by("config", F.when(viable, F.struct(F.col("throughput"), -F.col("config")))).alias("winner"), F.count_if(viable).alias("promoted"))


def variant_ranking(variants: DataFrame) -> DataFrame:
    """Adds place by falling throughput and the factor over the slowest variant of the job."""
    job = Window.partitionBy("job")
    low = F.min("throughput").over(job)
    return variants.withColumns({"place": F.row_number().over(job.orderBy(F.desc("throughput"), "variant")), "factor": F.when(low > 0, half_up(F.col("throughput") / low, 2))})


def variant_transitions(variants: DataFrame) -> DataFrame:
    """Neighbours in throughput order with the ratio between them."""
    order = Window.partitionBy("job").orderBy("throughput", "variant")
    df = variants.withColumns({"from_variant": F.lag("variant").over(order), "from_throughput": F.lag("throughput").over(order)}).where("from_variant is not null")
    return df.select("job", "from_variant", F.col("variant").alias("to_variant"), F.when(F.col("from_throughput") > 0, half_up(F.col("throughput") / F.col("from_throughput"), 2)).alias("factor"))


def stratified_quota(rows: DataFrame, correct: int, incorrect: int) -> DataFrame:
    """The first rows of each level by row_key: so many correct ones and so many others."""
    place = F.row_number().over(Window.partitionBy("level", "correct").orderBy("row_key"))
    return rows.withColumn("__n", place).where(F.col("__n") <= F.when(F.col("correct"), correct).otherwise(incorrect)).drop("__n")


def sample_deterministic(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample of ``n`` rows that depends on row_key and seed alone."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col("row_key").cast("string"), F.lit(seed)).cast("binary")), "row_key").limit(n)


def quality_aggregate(repeats: DataFrame, keys: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Adds up the quality maps of repeats by metric: counts as sums, extremes as extremes, the rest as medians. Returns keys, metric, value."""
    long = repeats.select(*keys, F.explode("quality").alias("metric", "value")).where("value is not null")
    m, v = F.col("metric"), F.col("value")
    sums, tops, lows = ("nan_count", "inf_count", "loss_count"), ("max_loss", "max_output_abs_diff", "max_output_rel_diff"), ("min_loss",)
    value = F.when(m.isin(*sums), F.sum(v)).when(m.isin(*tops), F.max(v)).when(m.isin(*lows), F.min(v)).otherwise(F.percentile(v, 0.5))
    return long.groupBy(*keys, "metric").agg(value.alias("value"))
