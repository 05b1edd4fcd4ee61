"""Spans and device windows of a stream: what is told while it runs keeps state behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = ("run_id", "span_id", "start_us", "end_us", "duration_ns", "closed")
_STATE = ("run_id", "span_id", "begin", "end", "duration", "until", "told")
_NONE = -(1 << 62)


def _row(key: tuple, begin: int, end: int, duration: int) -> tuple:
    return (*key, None if begin == _NONE else begin, None if end == _NONE else end, None if end == _NONE else duration, end != _NONE)


def _load(held: tuple[Any, ...] | None) -> dict[tuple, tuple]:
    """The spans of a bucket from its state."""
    if held is None:
        return {}
    columns = [c.to_pylist() for c in pa.ipc.open_stream(held[0]).read_all().columns]
    return dict(zip(zip(columns[0], columns[1], strict=True), zip(*columns[2:], strict=True), strict=True))


def _dump(known: dict[tuple, tuple]) -> tuple[bytes]:
    table = pa.table(dict(zip(_STATE, [*map(list, zip(*known, strict=True)), *map(list, zip(*known.values(), strict=True))], strict=True)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _pair(timeout_us: int, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The markers of a bucket of spans. State: each span's begin, end and duration as far as known, when it expires, and whether it was told."""
    out: list[tuple] = []
    known = _load(state.getOption)
    if not state.hasTimedOut:
        markers = pd.concat(list(frames)).sort_values(["us", "duration_ns"])
        for *key, us, duration in zip(*(markers[c].tolist() for c in ("run_id", "span_id", "us", "duration_ns")), strict=True):
            span = known.get(key := tuple(key))
            if span and us > span[3]:  # it has expired, though no batch came to say so
                if not span[4]:
                    out.append(_row(key, *span[:3]))
                span = None
            begin, end, long, until, told = span or (_NONE, _NONE, 0, us + timeout_us, False)
            if not told:
                if duration > 0:
                    end, long = us, duration
                else:
                    begin = us if begin == _NONE else min(begin, us)
                told = begin != _NONE and end != _NONE
                if told:
                    out.append(_row(key, begin, end, long))
            known[key] = begin, end, long, until, told
    mark = state.getCurrentWatermarkMs()
    expired = [key for key, span in known.items() if span[3] // 1000 < mark]
    for key in expired:
        span = known.pop(key)
        if not span[4]:
            out.append(_row(key, *span[:3]))
    if known:
        state.update(_dump(known))
        state.setTimeoutTimestamp(max(min(span[3] for span in known.values()) // 1000, mark + 1))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=list(_OUT)).astype({"start_us": "Int64", "end_us": "Int64", "duration_ns": "Int64", "closed": bool})


def stream_span_pairing(events: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes", buckets: int = 512) -> DataFrame:
    """One row per span of a run: start, end, duration_ns and closed (append mode).

    A begin marker has no duration, the end marker has it. A span comes out closed in the batch in which the second of the
    two arrives, wherever in time they lie. Each span has its own time: ``timeout`` after its first marker it comes out
    as it is, not closed if only begun, without start if only the end came; what follows later is another span of that name.
    Until then it is remembered, so that repeated markers add nothing. Markers without run or span are left out.

    Spans are dealt to ``buckets``, each with one state and a timer for the first of its spans to expire, as a call for
    each span costs far more than the span; a batch's markers of one bucket are in memory at once. A checkpoint keeps its number of buckets.
    """
    timeout_us = events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {timeout})").first()[0]
    kind = dict(events.dtypes)
    markers = events.where("span_id is not null and run_id is not null and ts is not null").withWatermark("ts", delay)
    markers = markers.select(
        F.pmod(F.xxhash64("run_id", "span_id"), F.lit(buckets)).alias("bucket"), "run_id", "span_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("duration_ns", F.lit(0)).cast("long").alias("duration_ns")
    )

    def pair(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _pair(timeout_us, frames, state)

    out = markers.groupBy("bucket").applyInPandasWithState(
        pair, f"run_id {kind['run_id']}, span_id {kind['span_id']}, start_us long, end_us long, duration_ns long, closed boolean", "spans binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    at = lambda c: F.timestamp_micros(f"{c}_us").alias(c)
    return out.select("run_id", "span_id", at("start"), at("end"), "duration_ns", "closed")


def stream_gpu_windows(samples: DataFrame, width: str = "10 seconds", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Per device of a run and window: samples, mean and spread of utilisation, and peak memory share (append mode).

    Windows that slide share panes: samples are reduced to one row per device and ``slide``, of which ``width`` must be a
    multiple, and each window adds up its panes' rows, so no sample is copied. Rows without a device are one device, null.
    """
    util, pane = F.col("utilization_gpu_pct"), F.window("ts", slide or width)
    share = F.max(F.col("memory_used_bytes") / F.nullif(F.col("memory_total_bytes"), F.lit(0)))
    if "gpu_id" not in samples.columns:
        samples = samples.withColumn("gpu_id", F.lit(None).cast("int"))
    panes = samples.withWatermark("ts", delay).groupBy("run_id", "gpu_id", pane.alias("w")).agg(
        F.count("*").alias("n"), F.count(util).alias("k"), F.sum(util).alias("total"), F.max(util).alias("high"), F.min(util).alias("low"), share.alias("memory_ratio")
    )
    if slide:
        panes = panes.groupBy("run_id", "gpu_id", F.window(F.window_time("w"), width, slide).alias("w")).agg(
            *[F.sum(c).alias(c) for c in ("n", "k", "total")], F.max("high").alias("high"), F.min("low").alias("low"), F.max("memory_ratio").alias("memory_ratio")
        )
    return panes.select("run_id", "gpu_id", F.col("w.start").alias("start"), "n", (F.col("total") / F.nullif("k", F.lit(0))).alias("avg_util"), (F.col("high") - F.col("low")).alias("spread"), "memory_ratio")
