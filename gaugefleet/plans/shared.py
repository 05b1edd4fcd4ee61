"""Intermediate tables of the layered queries: each is written once and read back by all that build on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.operators import classify as C
from gaugefleet.operators import kernels as K
from gaugefleet.operators import recommend as R
from gaugefleet.operators import steps as S
from gaugefleet.plans import profiling as P
from gaugefleet.plans.views import folder as _folder
from gaugefleet.plans.views import gpu_samples, telemetry_events

KERNEL_RUNS = 1000  # added to the ids of profiled runs where both kinds of runs stand in one table


class Shared:
    """The tables that layered queries share, over the base tables of one folder.

    A table is made when it is first asked for, out of others of these tables, and written to the shared folder; so
    every base table is read once, however many layers stand on it. Hand one object to several queries to share its tables
    between them; ``drop`` removes what was written.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        self.folder = _folder(spark)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            df = build()
            df.write.parquet(f"{self.folder}/{name}")
            self._made[name] = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        return self._made[name]

    def drop(self) -> None:
        """Remove the tables; frames that read them are of no more use."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._made = {}

    # --- telemetry ---

    def steps(self) -> DataFrame:
        return self.table("steps", lambda: S.step_metrics(telemetry_events(self.spark, self.sf_dir)))

    def both(self) -> DataFrame:
        """Run summaries in both scopes."""
        return self.table("runs", lambda: S.run_summary(S.with_scopes(self.steps()), gpu_samples(self.spark, self.sf_dir)))

    def runs(self) -> DataFrame:
        return self.both().where("scope = 'run'")

    # --- profiles ---

    def kernels(self) -> DataFrame:
        """Kernels with the profile of their device."""
        return self.table("kernels", lambda: P._profiled(self.spark, self.sf_dir))

    def kernel_runs(self) -> DataFrame:
        """Profiled runs with the device's profile and the roofline over the run's means."""
        return self.table("kernel_runs", lambda: P.with_roofline(K.kernel_run_summary(self.kernels())))

    # --- labels, signals and recommendations ---

    def labels(self, kind: str) -> DataFrame:
        """Labels of telemetry runs, or of profiled runs under shifted ids."""
        if kind == "telemetry":
            return C.classify_run(self.runs()).select("run_id", "label", "score")
        return K.classify_kernels_run(self.kernel_runs()).select((F.col("run_id") + KERNEL_RUNS).alias("run_id"), "label", "score")

    def signals(self, kind: str) -> DataFrame:
        if kind == "telemetry":
            return self.table("signals", lambda: C.extract_signals(self.runs()).select("run_id", "signals", "numbers", "input_frac", "h2d_frac"))
        return self.table("kernel_signals", lambda: K.extract_kernel_signals(self.kernel_runs()))

    def inputs(self, *kinds: str) -> tuple[DataFrame, DataFrame]:
        """Labels and signals of the kinds of runs that are asked for."""
        labels, signals = self.labels(kinds[0]), self._signals(kinds[0])
        for kind in kinds[1:]:
            labels, signals = labels.union(self.labels(kind)), signals.unionByName(self._signals(kind), allowMissingColumns=True)
        return labels, signals

    def _signals(self, kind: str) -> DataFrame:
        df = self.signals(kind)
        return df if kind == "telemetry" else df.withColumn("run_id", F.col("run_id") + KERNEL_RUNS)

    def matched(self, *kinds: str) -> DataFrame:
        return R.rule_match_join(*self.inputs(*kinds))

    def scored(self, *kinds: str) -> DataFrame:
        """Scored recommendations; ids of profiled runs are shifted."""
        return self.table("scored_" + "_".join(kinds), lambda: R.score_recommendations(R.catalog_join(R.best_rule_per_rec(self.matched(*kinds)))))

    def recommendations(self, *kinds: str) -> DataFrame:
        """Scored recommendations without the ones that say the same, in order."""
        return self.table("recommendations_" + "_".join(kinds), lambda: R.dedupe_and_order_recs(self.scored(*kinds)))


BOTH = ("telemetry", "kernel")
