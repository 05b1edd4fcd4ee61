"""What the layered queries read: equal kernels of a run once, telemetry of the first runs only, raw metrics summed up before names are looked up."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugefleet.operators import kernels as K
from gaugefleet.operators import source as S
from gaugefleet.operators import steps as ST
from gaugefleet.plans import texts as TX
from gaugefleet.plans import views as V
from gaugefleet.plans.shared import Shared

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@tables
def test_equal_kernels_of_a_run_are_matched_once(spark, tmp_path):
    keys = [(20 * (1 + k), 7) for k in range(200)]  # all of run 0; what a text holds repeats every 4620 parts
    spark.createDataFrame([(k + 4620 * 20 * i, n) for i in range(3) for k, n in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    shared = Shared(spark, str(tmp_path))
    found, styles, _ = TX._evidence(shared)
    scanned = TX._scan(spark, str(tmp_path))
    every = S.source_signals(scanned)
    assert shared._made["source_signals"].count() == scanned.where("kind = 'kernel'").select("body").distinct().count() < every.count()
    assert rows(found.distinct()) == rows(S.source_rule_match(every).select("run_id", F.col("rule").alias("label")).distinct())
    assert rows(styles.distinct()) == rows(every.select("run_id", F.explode("styles").alias("label")).distinct())


@tables
def test_telemetry_of_the_first_runs(spark):
    d = str(DATA)
    text = lambda df: rows(df.withColumns({"payload": F.to_json("payload"), "shapes": F.to_json("shapes")}))
    assert text(V.telemetry_events(spark, d, 10)) == text(V.telemetry_events(spark, d).where("run_id < 10"))
    plan = V.telemetry_events(spark, d, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("< 10")  # the filter stands below the window
    whole = ST.run_summary(V.written(ST.step_metrics(V.telemetry_events(spark, d))), V.gpu_samples(spark, d)).where("run_id < 10")
    assert rows(TX._telemetry(Shared(spark, d))) == rows(whole)


def test_two_raw_names_of_one_metric(spark):
    tall = [("k", "Duration", 5.0, 1), ("k", "gpu__time_duration.sum", 7.0, 3), ("k", "Duration", 6.0, 2), ("k", "launch__shared_mem_per_block_static", 8.7, 4), ("k", "launch__shared_mem_per_block_dynamic", 3.2, 5), ("k", "launch__shared_mem_per_block_static", 1.0, 6), ("k", "Mem Busy", 9.0, None), ("k", "Mem Busy", None, 7)]
    df = K.kernel_pivot(spark.createDataFrame([(1, *x) for x in tall], "run_id long, kernel_name string, metric_name string, value double, seq long"))
    (r,) = df.collect()
    assert (r.kernel_duration_us, r.shared_memory_per_block_bytes, r.memory_busy_pct) == (7.0, 12, None)
    (line,) = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "regexp_extract" in x]
    assert "Aggregate [" in line and "metric_name" in line.split("]")[0]  # names are looked up in what the sum by raw name gives out


@tables
@pytest.mark.parametrize("name", ["unreconciled_findings", "missing_evidence", "primary_reconciled"])
def test_only_the_steps_that_count_are_put_together(spark, monkeypatch, name):
    def never(self):
        raise AssertionError("steps of all runs")

    monkeypatch.setattr(Shared, "steps", never)
    assert TX.QUERIES[name](spark, str(DATA)).count() > 0
