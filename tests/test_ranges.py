"""Running values, ranks and medians of large groups against plain windows and sorted lists."""

import random
import re
from collections import defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugefleet.operators import ranges as RA
from gaugefleet.operators import steps as S


def test_previous_values_cross_cells(spark):
    rng = random.Random(1)
    rows = [(k % 3, i * rng.choice((1, 1, 7)) + i, rng.choice((None, None, "a", "b"))) for k in range(3) for i in range(400)]
    rows = list({(k, i): (k, i, v) for k, i, v in rows}.values())
    df = spark.createDataFrame(rows, "run_id long, at long, v string")
    want = F.last("v", True).over(Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    got = RA.with_previous(df.withColumn("want", want), ["run_id"], "at", F.col("v"), "found", F.floor(F.col("at") / 16))
    assert got.count() == len(rows) and got.where("NOT found <=> want").count() == 0 and got.where("found IS NOT NULL").count() > 500
    assert got.columns == ["run_id", "at", "v", "want", "found"]


def test_a_million_steps_of_one_run(spark):
    """No window holds more steps than a cell has ids."""
    n = 1_000_000
    signature = F.when(F.col("id") % 1000 == 999, F.concat(F.lit("s"), F.floor(F.col("id") / 5000)))
    steps = spark.range(n).select(F.least(F.col("id"), F.lit(0)).alias("run_id"), F.col("id").alias("step_id"), signature.alias("shape_signature"))
    changed = S.shape_changes(steps)
    assert changed.where("shape_changed").count() == n // 5000 - 1
    windows = re.findall(r"windowspecdefinition\(([^#]+)#\d+L, ([^#]+)#\d+L,? ?([a-z_]*)", changed._jdf.queryExecution().executedPlan().toString())
    assert sorted(windows) == [("run_id", "__cell", ""), ("run_id", "__cell", "step_id")]  # one over the cells of a run, one over the steps of a cell
    assert steps.groupBy(F.floor(F.col("step_id") / RA.CELL)).count().agg(F.max("count"), F.count("*")).first() == (RA.CELL, 16)


def test_nth(spark):
    df = spark.createDataFrame([("a", i) for i in (5, 3, 9, 7)] + [("b", 1)], "k string, at long")
    assert {tuple(r) for r in RA.nth(df, ["k"], "at", 2, "x").collect()} == {("a", 5)}
    assert {tuple(r) for r in RA.nth(df, ["k"], "at", 1, "x", last=True).collect()} == {("a", 9), ("b", 1)}


def test_medians(spark):
    rng = random.Random(7)
    groups = {
        "odd": [rng.random() for _ in range(501)], "even": [rng.random() * 1e6 for _ in range(500)], "same": [2.5] * 40, "two": [1.0, 4.0], "one": [3.0], "copies": [rng.choice((1.0, 2.0, 2.0, 5.0)) for _ in range(300)],
        "wide": [10.0 ** rng.randrange(-300, 300) for _ in range(333)], "near": [1 + k * 2.0**-52 for k in range(100)], "zero": [0.0, -1.0, 0.0, 6.0, 8.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("none", -3.0), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    positive = {k: sorted(v for v in values if v > 0) for k, values in groups.items()}
    middle = {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in positive.items()}
    assert {r.k: r.m for r in RA.medians(df, ["k"], "v", "m").collect()} == middle
    assert {r.k: r.m for r in RA.medians(df, ["k"], "v", "m", upper=True).collect()} == {k: v[len(v) // 2] for k, v in positive.items()}


def test_scopes_and_steady_steps(spark):
    rows = [(run, i, "ok" if i % 4 else "error", 10 if i % 5 else 0) for run in (1, 2) for i in range(run * 10)] + [(3, 0, "ok", 10), (3, 1, "ok", 10)]
    steps = spark.createDataFrame(rows, "run_id long, step_id long, status string, step_wall_time_ns long")
    done = defaultdict(list)
    for run, i, status, wall in rows:
        if status == "ok" and wall > 0:
            done[run].append(i)
    pairs = lambda df: {(r.run_id, r.step_id) for r in df.collect()}
    assert pairs(S.with_scopes(steps).where("scope = 'steady'")) == {(r, i) for r, v in done.items() for i in v[2:]}
    assert S.with_scopes(steps).where("scope = 'run'").count() == len(rows)
    assert pairs(S.steady_state_steps(steps, 1, 3)) == {(r, i) for r, v in done.items() for i in v[1:][-3:]}
    assert pairs(S.steady_state_steps(steps, 0)) == {(r, i) for r, v in done.items() for i in v}
