"""Structured Streaming versions of the core reductions.

What only adds up (steps, run sessions) is reduced per micro-batch to mergeable partial rows, which are merged
when read: no state, no window edges, and late events count. What must be told at once or expire (spans,
device windows, repeated events) keeps state behind a watermark; rows later than that are dropped, and the batch job
is authoritative.
"""

from gaugefleet.streaming.ingest import STREAM_SCHEMA, ingest_traces, numbers, stream_health_alerts, stream_ingest, stream_trace
from gaugefleet.streaming.partials import collect_partials, open_and_closed_sessions, run_sessions, step_metrics_so_far
from gaugefleet.streaming.run import run_to_table, written_batches
from gaugefleet.streaming.spans import stream_gpu_windows, stream_span_pairing

__all__ = [
    "STREAM_SCHEMA", "collect_partials", "ingest_traces", "numbers", "open_and_closed_sessions", "run_sessions", "run_to_table", "step_metrics_so_far", "stream_gpu_windows", "stream_health_alerts",
    "stream_ingest", "stream_span_pairing", "stream_trace", "written_batches",
]
