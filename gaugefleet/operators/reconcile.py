"""Evidence of several layers brought together: diagnoses with confidence, what is missing, what nothing claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = ("source", "ptx", "ncu", "profiler")
# Diagnoses with severity and recommendations.
DIAGNOSES = [
    ("inefficient_global_memory_access", "high", ["rec_ncu_improve_coalescing", "rec_ncu_tiling_shared_mem"]),
    ("excessive_synchronization", "medium", []),
    ("register_pressure", "high", []),
    ("tensor_core_underutilization", "high", []),
    ("memory_bandwidth_saturation", "high", ["rec_ncu_memory_bandwidth_bound"]),
    ("warp_divergence_risk", "medium", []),
    ("roofline_memory_bound", "high", ["rec_roofline_tiling", "rec_roofline_kernel_fusion"]),
    ("roofline_low_mfu", "medium", ["rec_roofline_occupancy", "rec_roofline_batch_size"]),
]
# The check of a diagnosis in a layer. Any of the first signals confirms it, if none of the second does not.
CHECKS = [
    ("inefficient_global_memory_access", "source", ["strided_or_pitched"], []),
    ("inefficient_global_memory_access", "ptx", ["ptx_global_memory_heavy", "ptx_no_shared_memory"], []),
    ("inefficient_global_memory_access", "ncu", ["uncoalesced_global_loads"], []),
    ("excessive_synchronization", "source", ["unnecessary_syncthreads", "conditional_syncthreads"], []),
    ("excessive_synchronization", "ncu", ["warp_stall_is_sync"], []),
    ("excessive_synchronization", "profiler", ["sync_bound"], []),
    ("register_pressure", "ptx", ["ptx_has_register_spills", "ptx_high_register_count"], []),
    ("register_pressure", "ncu", ["occupancy_limited_by_registers"], ["occupancy_good"]),
    ("tensor_core_underutilization", "ncu", ["tensor_core_underutilized"], []),
    ("memory_bandwidth_saturation", "ptx", ["ptx_global_memory_heavy"], []),
    ("memory_bandwidth_saturation", "ncu", ["memory_bandwidth_saturated"], []),
    ("warp_divergence_risk", "ptx", ["ptx_branch_divergence_risk"], []),
    ("roofline_memory_bound", "ncu", ["roofline_memory_bound"], []),
    ("roofline_low_mfu", "ncu", ["mfu_very_low"], ["roofline_memory_bound"]),
]
# Labels of a layer that a confirmed diagnosis claims.
CLAIMS = [
    ("inefficient_global_memory_access", "source", "strided_or_pitched"),
    ("inefficient_global_memory_access", "ptx", "ptx_global_memory_heavy"),
    ("inefficient_global_memory_access", "ncu", "uncoalesced_access"),
    ("excessive_synchronization", "source", "unnecessary_syncthreads"),
    ("excessive_synchronization", "source", "conditional_syncthreads"),
    ("excessive_synchronization", "ncu", "warp_stall_sync"),
    ("excessive_synchronization", "profiler", "sync_bound"),
    ("register_pressure", "ptx", "ptx_register_spills"),
    ("register_pressure", "ptx", "ptx_register_pressure"),
    ("register_pressure", "ncu", "occupancy_limited_by_registers"),
    ("tensor_core_underutilization", "ncu", "tensor_core_underutilized"),
    ("memory_bandwidth_saturation", "ptx", "ptx_global_memory_heavy"),
    ("memory_bandwidth_saturation", "ncu", "memory_bandwidth_bound"),
    ("warp_divergence_risk", "ptx", "ptx_high_branch_density"),
    ("roofline_memory_bound", "ncu", "roofline_memory_bound"),
    ("roofline_low_mfu", "ncu", "roofline_low_mfu"),
]
# Profiler metrics that would confirm a diagnosis.
NEEDED = [
    ("inefficient_global_memory_access", "ncu", "l1tex__t_sectors_pipe_lsu_mem_global_op_ld.sum_per_request"),
    ("inefficient_global_memory_access", "ncu", "dram__throughput.avg.pct_of_peak_sustained_elapsed"),
    ("excessive_synchronization", "ncu", "smsp__warp_issue_stalled_barrier_per_warp_active.pct"),
    ("register_pressure", "ncu", "sm__warps_active.avg.pct_of_peak_sustained_active"),
    ("register_pressure", "ncu", "launch__registers_per_thread"),
    ("tensor_core_underutilization", "ncu", "sm__pipe_tensor_cycles_active.avg.pct_of_peak_sustained_active"),
    ("tensor_core_underutilization", "ncu", "smsp__inst_executed_pipe_tensor.sum"),
    ("tensor_core_underutilization", "ncu", "sm__warps_active.avg.pct_of_peak_sustained_active"),
    ("tensor_core_underutilization", "ncu", "smsp__inst_executed_pipe_fma.sum"),
    ("memory_bandwidth_saturation", "ncu", "dram__throughput.avg.pct_of_peak_sustained_elapsed"),
    ("memory_bandwidth_saturation", "ncu", "lts__t_bytes.sum.pct_of_peak_sustained_elapsed"),
    ("warp_divergence_risk", "ncu", "smsp__thread_inst_executed_per_inst_executed.ratio"),
    ("warp_divergence_risk", "ncu", "smsp__inst_executed_op_branch.sum"),
    ("roofline_memory_bound", "ncu", "dram__bytes_read.sum"),
    ("roofline_memory_bound", "ncu", "smsp__inst_executed_pipe_fma.sum"),
    ("roofline_low_mfu", "ncu", "sm__warps_active.avg.pct_of_peak_sustained_active"),
    ("roofline_low_mfu", "ncu", "smsp__inst_executed_pipe_fma.sum"),
]
CONFIDENCE = ("confirmed", "high", "medium-high", "medium", "low-medium")


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def confidence(confirming: Column, available: Column) -> Column:
    """How sure a diagnosis is that so many of so many layers confirm."""
    return F.when(confirming >= 3, "confirmed").when((confirming == 2) & (available == 2), "high").when(confirming == 2, "medium-high").when(available <= 1, "medium").otherwise("low-medium")


def kernel_layer(signals: DataFrame) -> DataFrame:
    """Signals of profiled runs as the names that checks ask for."""
    names = F.map_keys(F.map_filter("signals", lambda k, v: v == "true"))
    region, mfu = F.col("signals")["roofline_region"], F.col("numbers")["mfu_pct"]
    more = F.filter(F.array(F.when(region == "memory_bound", F.lit("roofline_memory_bound")), F.when(mfu < 20.0, F.lit("mfu_very_low"))), lambda x: x.isNotNull())
    return signals.select("run_id", F.lit("ncu").alias("layer"), F.concat(names, more).alias("names"))


def reconcile_layers(layers: DataFrame) -> DataFrame:
    """(run_id, label, severity, confidence, layers_confirming, n_available) of diagnoses that a layer confirms.

    ``layers`` has run_id, layer and names, the signals that hold, one row for every layer that a run has.
    """
    spark = layers.sparkSession
    checks = _table(spark, CHECKS, "label string, layer string, any_of array<string>, none_of array<string>")
    tried = layers.join(checks, "layer").withColumn("holds", F.arrays_overlap("names", "any_of") & ~F.arrays_overlap("names", "none_of"))
    confirmed = F.array_sort(F.collect_set(F.when(F.col("holds"), F.col("layer"))))
    by_label = tried.groupBy("run_id", "label").agg(confirmed.alias("layers_confirming"), F.count("*").alias("n_available")).where(F.size("layers_confirming") > 0)
    found = by_label.join(_table(spark, [d[:2] for d in DIAGNOSES], "label string, severity string"), "label")
    return found.select("run_id", "label", "severity", confidence(F.size("layers_confirming"), F.col("n_available")).alias("confidence"), "layers_confirming", "n_available")


def missing_evidence(diagnoses: DataFrame, layers: DataFrame) -> DataFrame:
    """(run_id, label, metrics, confidence_if_confirmed): what to measure in layers that don't confirm a diagnosis yet."""
    needed = _table(diagnoses.sparkSession, NEEDED, "label string, layer string, metric string")
    lacking = diagnoses.join(needed, "label").where(~F.array_contains("layers_confirming", F.col("layer")))
    there = layers.groupBy("run_id").agg(F.countDistinct("layer").alias("n_layers"))
    by_label = lacking.groupBy("run_id", "label").agg(F.array_sort(F.collect_set("metric")).alias("metrics"), F.first(F.size("layers_confirming")).alias("n"))
    both = by_label.join(there, "run_id")
    return both.select("run_id", "label", "metrics", confidence(F.col("n") + 1, F.greatest("n_layers", "n")).alias("confidence_if_confirmed"))


def unreconciled_findings(labels: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(run_id, layer, label) of layer labels that no confirmed diagnosis claims."""
    claims = _table(diagnoses.sparkSession, CLAIMS, "diagnosis string, layer string, claimed string")
    claimed = diagnoses.select("run_id", F.col("label").alias("diagnosis"), F.explode("layers_confirming").alias("layer")).join(claims, ["diagnosis", "layer"]).select("run_id", "layer", F.col("claimed").alias("label"))
    return labels.select("run_id", "layer", "label").distinct().join(claimed, ["run_id", "layer", "label"], "left_anti")


def primary_reconciled(diagnoses: DataFrame) -> DataFrame:
    """The surest diagnosis of each run, then the most severe, then the first of the list."""
    order = _table(diagnoses.sparkSession, [(d[0], i) for i, d in enumerate(DIAGNOSES)], "label string, n int")
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(rank, F.when(F.col("severity") == "high", 0).otherwise(1), "n"))
    return diagnoses.join(order, "label").withColumn("place", place).where("place = 1").select("run_id", "label", "confidence", "severity")
