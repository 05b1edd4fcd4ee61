"""Queries over pairs of profiled runs, before and after, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugefleet.operators import compare as D
from gaugefleet.operators import kernels as K
from gaugefleet.plans import profiling as P
from gaugefleet.plans.shared import Shared
from gaugefleet.plans.telemetry import _r, _rounded


def _diff(shared: Shared) -> DataFrame:
    return D.bottleneck_diff(P._sides(K.classify_kernels_run(shared.kernel_runs())))


def q_bottleneck_diff(spark, d):
    return _diff(Shared(spark, d))


def q_metric_deltas(spark, d):
    return _rounded(D.metric_deltas(P._sides(P._summary(spark, d))))


def q_headline_metric(spark, d):
    return D.headline_metric(D.metric_deltas(P._sides(P._summary(spark, d))))


def q_kernel_diff_verdict(spark, d):
    shared = Shared(spark, d)
    return D.kernel_diff_verdict(P._sides(shared.kernel_runs()), _diff(shared))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}
ORACLES = {
    "bottleneck_diff": f"{P._DIFF} SELECT * FROM bd",
    "metric_deltas": f"{P._SUMMARY}, dl AS ({P._delta}) SELECT pair_id, metric, before, after, delta, CASE WHEN abs(delta) < 0.001 THEN 'neutral' WHEN (delta > 0) = up THEN 'improved' ELSE 'regressed' END AS direction FROM dl",
    "headline_metric": f"{P._SUMMARY}, dl AS ({P._delta}) SELECT pair_id, metric, abs(delta) AS abs_delta FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(delta) DESC, metric DESC) AS n FROM dl) WHERE n = 1",
    "kernel_diff_verdict": f"""{P._DIFF}, n AS (SELECT pair_id AS p, count(CASE WHEN status = 'resolved' THEN 1 END) AS gone, count(CASE WHEN status = 'new' THEN 1 END)
      AS new, count(CASE WHEN status = 'improved' THEN 1 END) AS imp FROM bd GROUP BY 1),
      v AS (SELECT a.run_id // 2 AS pair_id, CASE WHEN a.total_kernel_duration_us > 0 AND b.total_kernel_duration_us > 0 THEN
      {_r('a.total_kernel_duration_us / b.total_kernel_duration_us')} END AS time_ratio FROM rs a JOIN rs b ON a.run_id // 2 = b.run_id // 2 WHERE a.run_id % 2 = 0 AND
      b.run_id % 2 = 1),
      w AS (SELECT pair_id, time_ratio, CASE WHEN gone > 0 AND new = 0 THEN 'improved' WHEN new > 0 AND gone = 0 THEN 'regressed' WHEN gone > 0 AND new > 0 THEN 'mixed'
      WHEN imp > 0 THEN 'improved' ELSE 'neutral' END AS label_outcome FROM v LEFT JOIN n ON p = pair_id)
      SELECT *, CASE WHEN time_ratio >= 1.05 THEN 'improved' WHEN time_ratio <= 0.95 THEN 'regressed' WHEN time_ratio IS NOT NULL THEN 'neutral' ELSE label_outcome END AS outcome FROM w""",
}
