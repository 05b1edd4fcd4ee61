"""Chrome traces of any size: JSON documents, one or several after each other in a file, read by many tasks.

A document is cut at every closing brace, which Spark's text reader does within the splits of a file. What a split
begins with (how deep, within a text or not, in which array) follows from the splits before it: a first pass sums up
each split for both cases, within a text or not, into one row, and these rows are chained per file; files that are one
split begin with nothing before them, and are left out of it. The second pass then
knows where it is, gives out the objects of the ``traceEvents`` array, and those that run over the end of a split are
put together by the place where they began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "name string, cat string, ph string, ts double, dur double, pid string, tid string, args map<string,string>"
_ESCAPED = re.compile(r"\\.", re.S)
_BRACKET = re.compile(r"[{}\[\]]")
_KEYED = re.compile(r"\s*:\s*$")


class _Open(NamedTuple):
    """The last bracket that was opened at a depth: whether it is the array of events, and the number of the piece it stands in."""

    events: bool
    piece: int


class _Walk:
    """Goes through the pieces of a split from a depth and a state, within a text or not."""

    def __init__(self, depth: int, within: bool) -> None:
        self.depth, self.within, self.pieces = depth, within, 0
        self.opened: dict[int, _Open] = {}

    def step(self, piece: str) -> list[tuple[int, int]]:
        """Take a piece, which ends with a closing brace; gives (place, depth before) of each bracket opened in it."""
        plain = _ESCAPED.sub("__", piece) if "\\" in piece else piece
        parts, at, found = plain.split('"'), 0, []
        for i, part in enumerate(parts):
            if (i % 2 == 1) == self.within:
                for m in _BRACKET.finditer(part):
                    if m[0] in "{[":
                        key = parts[i - 1] if i and _KEYED.match(part[: m.start()]) else None
                        self.opened[self.depth] = _Open(m[0] == "[" and key == "traceEvents", self.pieces)
                        found.append((at + m.start(), self.depth))
                        self.depth += 1
                    else:
                        self.depth -= 1
            at += len(part) + 1
        self.within ^= len(parts) % 2 == 0
        self.pieces += 1
        return found


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(batch[0].to_pylist(), batch[1].to_pylist(), (f"{v}}}" for v in batch[2].to_pylist()), strict=True)


_SUM = pa.struct([("within", pa.bool_()), ("depth", pa.int64()), ("opened", pa.list_(pa.struct([("depth", pa.int64()), ("events", pa.bool_()), ("piece", pa.int64())])))])
_SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", _SUM), ("inside", _SUM)])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: what it does to the depth and the state, for both states that it may begin with."""
    here, walks = None, ()

    def row() -> pa.RecordBatch:
        sums = [{"within": w.within, "depth": w.depth, "opened": [{"depth": d, "events": o.events, "piece": o.piece} for d, o in w.opened.items()]} for w in walks]
        return pa.record_batch([pa.array([here[0]]), pa.array([here[1]], pa.int64()), *(pa.array([s], _SUM) for s in sums)], schema=_SUMS)

    for file, block, piece in _pieces(batches):
        if (file, block) != here:
            if here:
                yield row()
            here, walks = (file, block), (_Walk(0, False), _Walk(0, True))
        for w in walks:
            w.step(piece)
    if here:
        yield row()


class _Start(NamedTuple):
    """How a split begins: depth, whether within a text, whether in the array of events, and the number of the event that runs there."""

    depth: int
    within: bool
    events: bool
    event: int


_BEGIN = _Start(0, False, False, -1)


def _starts(rows: list) -> dict[tuple[str, int], _Start]:
    """Chains the splits of each file."""
    out, last, state = {}, None, _BEGIN
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != last:
            last, state = r.file, _BEGIN
        out[r.file, r.block] = state
        s = r.inside if state.within else r.outside
        opened = {o.depth + state.depth: o for o in s.opened}
        events = opened[1].events if 1 in opened else state.events
        event = r.block + opened[2].piece if 2 in opened else state.event
        state = _Start(state.depth + s.depth, s.within, events, event)
    return out


def read_chrome_trace(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of Chrome trace files: file, idx (rises along the file), name, cat, ph, ts_us, dur_us, pid, tid, args.

    Files are read in splits; one row for each split of a file that has several comes to the driver, between the two passes, and
    nothing of other files. A file may hold several documents after each other, as lines or not. Objects outside
    the top-level array ``traceEvents`` of a document are left out.
    """
    at = lambda c: F.col(f"_metadata.file_{c}")
    whole = (at("block_start") == 0) & (at("block_length") >= at("size"))
    text = spark.read.option("lineSep", "}").text(path).select(at("path").alias("file"), at("block_start").alias("block"), "value", whole.alias("whole"))
    one = "within boolean, depth long, opened array<struct<depth long, events boolean, piece long>>"
    cut, text = text.where("not whole").drop("whole"), text.drop("whole")
    starts = _starts(cut.mapInArrow(_sum_up, f"file string, block long, outside struct<{one}>, inside struct<{one}>").collect())
    schema = pa.schema([("file", pa.string()), ("idx", pa.int64()), ("block", pa.int64()), ("json", pa.string())])

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, walk, held, idx, rows = None, None, [], -1, []
        for file, block, piece in _pieces(batches):
            if (file, block) != here:
                if held:
                    rows.append((here[0], idx, here[1], "".join(held)))
                here, start = (file, block), starts.get((file, block), _BEGIN)
                walk, held, idx = _Walk(start.depth, start.within), [], start.event
                inside, array = start.depth > 2 and start.events, start.events
            number, begun = walk.pieces, False
            for at, depth in walk.step(piece):
                if depth == 1:
                    array = walk.opened[1].events
                elif depth == 2 and array:
                    inside, begun, idx, held = True, True, block + number, [piece[at:]]
            if inside:
                if not begun:
                    held.append(piece)
                if walk.depth == 2:
                    rows.append((file, idx, block, "".join(held)))
                    inside, held = False, []
            if len(rows) >= 5000:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if held:
            rows.append((here[0], idx, here[1], "".join(held)))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)

    parts = text.mapInArrow(events, "file string, idx long, block long, json string")
    whole = parts.groupBy("file", "idx").agg(F.array_sort(F.collect_list(F.struct("block", "json"))).alias("p"))  # the splits that an event runs over
    e = whole.select("file", "idx", F.from_json(F.array_join(F.col("p.json"), ""), EVENT).alias("e"))
    return e.select("file", "idx", *[F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("name", "cat", "ph")], F.col("e.ts").alias("ts_us"), F.col("e.dur").alias("dur_us"), "e.pid", "e.tid", "e.args")
