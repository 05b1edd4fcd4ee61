"""Compiled kernels as text: registers, instruction mix, findings, run summaries and static labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructType

from gaugefleet.functions import codes, environment, flags, half_up, numbers

# Instruction categories by the first pattern that a line has.
CATEGORIES = [
    ("global_loads", r"\bld\.global\b"),
    ("global_stores", r"\bst\.global\b"),
    ("shared_loads", r"\bld\.shared\b"),
    ("shared_stores", r"\bst\.shared\b"),
    ("local_loads", r"\bld\.local\b"),
    ("local_stores", r"\bst\.local\b"),
    ("tensor_ops", r"\bwmma\.\b"),
    ("special_func", r"\b(?:sin|cos|rsqrt|ex2|lg2)\.approx\b"),
    ("atomic_ops", r"\batom\.\b|\bred\.\b"),
    ("barrier_ops", r"\bbar\.\b|\bmembar\.\b"),
    ("control_flow", r"\b(?:bra|ret|exit|call)\b"),
    ("conversions", r"\bcvta?\.\b"),
    ("comparisons", r"\bsetp\.\b|\bselp\.\b"),
    ("fp64_ops", r"\.f64\b"),
    ("fp16_ops", r"\.(?:f16|bf16)\b"),
    ("fp32_ops", r"\.f32\b"),
    ("int_ops", r"\.[subu]\d+\b|\.b\d+\b"),
]
# Register types that take two registers, and the cuts of findings and labels.
WIDE = ("f64", "b64", "u64", "s64")
MANY_REGISTERS, VERY_MANY_REGISTERS, GLOBAL_RATIO, BRANCH_RATIO, UNSHARED_LOADS = 64, 128, 0.40, 0.15, 20
_MOVES = ("global_loads", "global_stores", "local_loads", "local_stores")
# What an entry, its registers and local arrays, and the head of a text look like.
_ENTRY = re.compile(r"\.(?:visible\s+|extern\s+)?\.entry\s+(\w+)")
_REGISTERS = r"\.reg\s+\.(\w+)\s+%\w+<(\d+)>"
_LOCALS = r"\.local\s+\.align\s+\d+\s+\.b8\s+\w+\[(\d+)\]"
_VERSION, _TARGET = r"\.version\s+([\d.]+)", r"\.target\s+(\w+)"
_BRACE = re.compile(r"[{}]")
# White space, and what labels, vector accesses, branches and their targets look like.
_SPACE = " \t\n\x0b\f\r"
_LABEL = re.compile(r"^\$?[\w.]+:\Z", re.A)
_VECTOR = re.compile(r"\b(?:ld|st)\.global(?:\.[a-z0-9_]+)*\.v([248])\.", re.A | re.I)
_BRANCH, _CONDITIONAL = re.compile(r"\bbra\b", re.A), re.compile(r"@%\w+\s+bra\b", re.A)
_TARGET_OF = re.compile(r"\bbra(?:\.uni)?\s+(\$?[\w.]+)", re.A)
_CATEGORIES = [(name, re.compile(pattern, re.A)) for name, pattern in CATEGORIES]
_MIX = (*(name for name, _ in CATEGORIES), "other", "fp64_memory_ops")
LINES_SEEN = 50_000  # a task forgets the lines that it knows when there are so many


def closing_brace(text: str, opening: int) -> int | None:
    """The place of the brace that closes the one at ``opening``."""
    depth = 0
    for m in _BRACE.finditer(text, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return None


def scan_ptx_kernels(texts: DataFrame) -> DataFrame:
    """One row per ``.entry`` body of (run_id, path, text): run_id, path, kernel_no, kernel_name, version, target, body, registers, local_bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for run_id, path, text in zip(pdf["run_id"], pdf["path"], pdf["text"], strict=True):
                version, target = (m[1] if (m := re.search(p, text or "")) else None for p in (_VERSION, _TARGET))
                for i, m in enumerate(_ENTRY.finditer(text or "")):
                    opening = text.find("{", m.end())
                    end = closing_brace(text, opening) if opening >= 0 else None
                    if end is not None:
                        rows.append((run_id, path, i, m[1], version, target, text[opening + 1 : end]))
            yield pd.DataFrame(rows, columns=["run_id", "path", "kernel_no", "kernel_name", "version", "target", "body"])

    kind = texts.schema["run_id"].dataType.simpleString()
    bodies = texts.select("run_id", "path", "text").mapInPandas(run, f"run_id {kind}, path string, kernel_no int, kernel_name string, version string, target string, body string")
    body = F.col("body")
    kinds, counts = (F.regexp_extract_all(body, F.lit(_REGISTERS), F.lit(g)) for g in (1, 2))
    registers = F.zip_with(kinds, counts, lambda k, n: F.when(k == "pred", 0).when(k.isin(*WIDE), 2).otherwise(1) * n.cast("long"))
    spills = F.regexp_extract_all(body, F.lit(_LOCALS), F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return bodies.withColumns({"registers": total(registers), "local_bytes": total(F.transform(spills, lambda x: x.cast("long")))})


class _Line(NamedTuple):
    """What a line is: the category, weight and kind of access of an instruction, where it jumps to, or the label that it sets."""

    category: str | None
    weight: int
    moves_fp64: bool
    jump: str | None
    conditional: bool
    label: str | None


def _line(text: str) -> _Line | None:
    """None for lines that hold nothing, and for directives that are no labels."""
    line = text.strip(_SPACE)
    if _LABEL.search(line):
        return _Line(None, 0, False, None, False, line[:-1])
    if not line or line.startswith("."):
        return None
    category = next((name for name, pattern in _CATEGORIES if pattern.search(line)), "other")
    wide = _VECTOR.search(line) if category in _MOVES[:2] else None
    jump = None
    if _BRANCH.search(line):
        jump = m[1] if (m := _TARGET_OF.search(line)) else ""
    return _Line(category, int(wide[1]) if wide else 1, category in _MOVES and ".f64" in line, jump, jump is not None and bool(_CONDITIONAL.search(line)), None)


def instruction_mix(body: str, seen: dict[str, _Line | None]) -> tuple[int, dict[str, int], int, int, int]:
    """Instructions, mix, branches, conditional branches and loops of a body; ``seen`` remembers lines, which repeat much."""
    counts, jumps, labels, n, conditional = dict.fromkeys(_MIX, 0), [], {}, 0, 0
    for i, text in enumerate(body.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        if text in seen:
            x = seen[text]
        else:
            if len(seen) >= LINES_SEEN:
                seen.clear()
            x = seen[text] = _line(text)
        if x is None:
            continue
        if x.label is not None:
            labels[x.label] = i
            continue
        n += 1
        counts[x.category] += x.weight
        if x.moves_fp64:
            counts["fp64_memory_ops"] += x.weight
        if x.jump is not None:
            jumps.append((x.jump, i))
            conditional += x.conditional
    loops = {t for t, i in jumps if t and labels.get(t, i) < i}
    return n, {k: v for k, v in counts.items() if v > 0}, len(jumps), conditional, len(loops)


def ptx_instruction_mix(kernels: DataFrame) -> DataFrame:
    """Adds instructions, mix (category to weighted count), branches, conditional_branches and loops to kernels with a body.

    A vector access of width w to global memory counts w times. A loop is a label that a later branch names.
    """
    place = kernels.columns.index("body")
    added = [("instructions", pa.int64()), ("mix", pa.map_(pa.string(), pa.int64())), ("branches", pa.int64()), ("conditional_branches", pa.int64()), ("loops", pa.int64())]
    schema = StructType([*kernels.schema.fields])
    for name, _ in added:
        schema = schema.add(name, MapType(StringType(), LongType()) if name == "mix" else LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, _Line | None] = {}
        for batch in batches:
            rows = [(None, {}, None, None, None) if body is None else instruction_mix(body, seen) for body in batch[place].to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(added)
            made = [pa.array([list(m.items()) for m in c] if name == "mix" else c, kind) for (name, kind), c in zip(added, columns, strict=True)]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *(name for name, _ in added)])

    return kernels.mapInArrow(run, schema)


def _n(category: str) -> Column:
    return F.coalesce(F.col("mix")[category], F.lit(0))


def _part(count: Column) -> Column:
    return F.when(F.col("instructions") > 0, count / F.col("instructions"))


def ptx_findings(kernels: DataFrame) -> DataFrame:
    """Adds findings, an array of codes, to kernels with their mix."""
    moved, registers = _n("global_loads") + _n("global_stores"), F.col("registers")
    return kernels.withColumn("findings", codes(
        ("register_spills_detected", F.col("local_bytes") > 0), ("very_high_register_count", registers > VERY_MANY_REGISTERS),
        ("high_register_count", (registers > MANY_REGISTERS) & (registers <= VERY_MANY_REGISTERS)), ("fp64_detected", _n("fp64_ops") > 0), ("fp64_data_movement_detected", _n("fp64_memory_ops") > 0),
        ("high_global_memory_ratio", _part(moved) > GLOBAL_RATIO), ("high_branch_count", _part(F.col("conditional_branches")) > BRANCH_RATIO), ("special_function_ops", _n("special_func") > 0),
        ("no_shared_memory_usage", (_n("shared_loads") == 0) & (_n("global_loads") > UNSHARED_LOADS)), ("tensor_ops_detected", _n("tensor_ops") > 0), ("atomics_detected", _n("atomic_ops") > 0),
    ))


def ptx_run_summary(kernels: DataFrame) -> DataFrame:
    """One row per run over its kernels: totals, registers, spills, ratios and the dominant category (ties by name)."""
    count = lambda c: F.count(F.when(c, 1))
    moved, branches = _part(_n("global_loads") + _n("global_stores")), _part(F.col("conditional_branches"))
    ratio = lambda f, c: F.coalesce(half_up(f(c), 4), F.lit(0.0))
    names = [*[n for n, _ in CATEGORIES], "other", "fp64_memory_ops"]
    totals = F.array(*[F.struct(F.sum(_n(n)).alias("n"), F.lit(n).alias("c")) for n in names])
    most = F.array_max(F.transform(totals, lambda x: x["n"]))
    first = F.array_min(F.transform(F.filter(totals, lambda x: (x["n"] == most) & (most > 0)), lambda x: x["c"]))
    return kernels.groupBy("run_id").agg(
        F.count("*").alias("kernel_count"), F.sum("instructions").alias("total_instructions"), half_up(F.avg("registers"), 1).alias("avg_register_count"), F.max("registers").alias("max_register_count"),
        count(F.col("local_bytes") > 0).alias("kernels_with_spills"), F.sum(_n("local_loads")).alias("total_spill_loads"), F.sum(_n("local_stores")).alias("total_spill_stores"),
        F.coalesce(first, F.lit("unknown")).alias("dominant_instruction_category"), count(_n("fp64_ops") > 0).alias("kernels_with_fp64"), count(_n("fp64_memory_ops") > 0).alias("kernels_with_fp64_data_movement"),
        F.sum(_n("fp64_memory_ops")).alias("total_fp64_data_movement_ops"), count(_n("tensor_ops") > 0).alias("kernels_with_tensor_ops"), ratio(F.max, moved).alias("max_global_memory_ratio"), ratio(F.avg, moved).alias("avg_global_memory_ratio"),
        count(moved > GLOBAL_RATIO).alias("kernels_with_high_global_memory_ratio"), count((_n("shared_loads") == 0) & (_n("shared_stores") == 0)).alias("kernels_without_shared_memory"),
        ratio(F.max, branches).alias("max_branch_density"), count(branches > BRANCH_RATIO).alias("kernels_with_high_branch_density"),
    )


def classify_ptx(summary: DataFrame) -> DataFrame:
    """(run_id, label, score, rule_no) of static risks."""
    c = F.col
    top = lambda base, most, x: F.least(F.lit(1.0), base + F.least(F.lit(most), x))
    registers = c("max_register_count")
    rules = [
        ("ptx_register_spills", c("kernels_with_spills") > 0, top(0.95, 0.05, 0.01 * c("kernels_with_spills"))),
        ("ptx_register_pressure", registers > MANY_REGISTERS, F.when(registers > VERY_MANY_REGISTERS, top(0.75, 0.15, (registers - VERY_MANY_REGISTERS) / 512)).otherwise(top(0.50, 0.20, (registers - MANY_REGISTERS) / 320))),
        ("ptx_global_memory_heavy", c("max_global_memory_ratio") > GLOBAL_RATIO, top(0.45, 0.35, c("max_global_memory_ratio") - GLOBAL_RATIO)),
        ("ptx_fp64_usage", (c("kernels_with_fp64") > 0) | (c("kernels_with_fp64_data_movement") > 0), F.when(c("kernels_with_fp64") > 0, 0.45).otherwise(0.35)),
        ("ptx_branch_divergence_risk", c("max_branch_density") > BRANCH_RATIO, top(0.40, 0.30, c("max_branch_density") - BRANCH_RATIO)),
    ]
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(n).alias("label"), half_up(score, 4).alias("score"), F.lit(i).cast("long").alias("rule_no"))) for i, (n, cond, score) in enumerate(rules)]), lambda x: x.isNotNull())
    return summary.select("run_id", F.explode(found).alias("x")).select("run_id", "x.*")


def extract_ptx_signals(summary: DataFrame) -> DataFrame:
    """``signals`` and ``numbers`` of every run of compiled kernels."""
    c = F.col
    fp64, moves = c("kernels_with_fp64") > 0, c("kernels_with_fp64_data_movement") > 0
    signals = flags({
        "ptx_has_register_spills": c("kernels_with_spills") > 0, "ptx_high_register_count": c("max_register_count") > MANY_REGISTERS, "ptx_very_high_register_count": c("max_register_count") > VERY_MANY_REGISTERS,
        "ptx_global_memory_heavy": c("max_global_memory_ratio") > GLOBAL_RATIO, "ptx_no_shared_memory": (c("kernel_count") > 0) & (c("kernels_without_shared_memory") == c("kernel_count")), "ptx_has_fp64": fp64 | moves,
        "ptx_has_fp64_arithmetic": fp64, "ptx_has_fp64_data_movement": moves, "ptx_branch_divergence_risk": c("max_branch_density") > BRANCH_RATIO,
        **environment(c("environment") if "environment" in summary.columns else None),
    })
    values = numbers({"ptx_max_register_count": c("max_register_count"), "ptx_max_global_memory_ratio": c("max_global_memory_ratio"), "ptx_max_branch_density": c("max_branch_density")})
    return summary.select("run_id", signals.alias("signals"), values.alias("numbers"))
