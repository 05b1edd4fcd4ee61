"""Source and compiled texts, rules over them and gold failures, worked out by hand."""

import random
import re
from collections import Counter

from gaugefleet.operators import evaluate as EV
from gaugefleet.operators import ptx as PX
from gaugefleet.operators import source as SR
from gaugefleet.plans import texts as TX
from gaugefleet.plans.catalog import QUERIES


def test_barriers_in_loops():
    one = "for (int i = 0; i < f(n); ++i) { a[i] = 0; __syncthreads(); }"
    assert SR.barriers_in_loops(one) == 1
    assert SR.barriers_in_loops("__syncthreads(); " + one + " __syncthreads();") == 1
    assert SR.barriers_in_loops("while (x) { for (;;) { __syncthreads(); } __syncthreads(); }") == 3  # the inner one is in both
    assert SR.barriers_in_loops("for (;;) __syncthreads();") == 0  # no braces
    assert SR.barriers_in_loops("for (;;) { __syncthreads(); if (a) { b(); }") == 1  # never closed
    assert SR.barriers_in_loops("for (int i = (0; i < n; ++i) { __syncthreads(); }") == 0  # its header never ends
    assert SR.barriers_in_loops("if (x) { __syncthreads(); }") == 0 and SR.barriers_in_loops("") == 0


def test_launch_arguments():
    assert [SR.launch_argument("dim3(1, 2), f<3, 4>(5, g[6, 7]), {8, 9}", n) for n in range(4)] == ["dim3(1, 2)", "f<3, 4>(5, g[6, 7])", "{8, 9}", None]
    assert SR.launch_argument("grid", 1) is None and SR.launch_argument("a), b", 1) == "b"
    assert [SR.threads_of(x) for x in ("256", "dim3(16, 3)", "dim3(8,8,4)", "dim3(4, 2,)", "dim3(64)", "n", "", None)] == [256, 48, 256, 8, None, None, None, None]


def test_scan_and_occupancy_rule(spark):
    text = """// __global__ void none() {}
__global__ void big(float* a) {
  __shared__ double tile[80][96];
  for (int j = 0; j < 4; ++j) { __syncthreads(); }
}
__global__ void small(float* a) { a[0] = 1; }
void run() { big<<<dim3(2, 2), dim3(16, 3), 0>>>(a); small<<<g, 20>>>(a); }
"""
    scanned = SR.scan_cuda_kernels(spark.createDataFrame([(1, "a.cu", text), (2, "b.cu", None)], "run_id long, path string, text string"))
    rows = {(r.kind, r.name): (r.line, r.syncs_in_loops, r.block_size) for r in scanned.collect()}
    assert rows == {("kernel", "big"): (2, 1, None), ("kernel", "small"): (6, 0, None), ("launch", "big"): (7, None, 48), ("launch", "small"): (7, None, 20)}
    kernels = SR.source_signals(scanned)
    occupancy = SR.occupancy_signals(kernels)  # one block of 256 threads fits, of 2048
    assert occupancy.columns == kernels.columns
    found = SR.source_rule_match(occupancy, scope="occupancy").collect()
    assert [(r.name, r.rule, r.severity) for r in found] == [("big", "low_theoretical_occupancy", "low")]


def test_versions_and_targets(spark):
    text = ".version 8.3\n.target sm_90a, debug\n.visible .entry k(\n)\n{\n .reg .b32 %r<5>;\n ret;\n}\n"
    rows = PX.scan_ptx_kernels(spark.createDataFrame([(1, "a.ptx", text), (1, "b.ptx", text.split("\n", 2)[2]), (1, "c.ptx", None)], "run_id long, path string, text string")).orderBy("path").collect()
    assert [(r.path, r.version, r.target, r.registers) for r in rows] == [("a.ptx", "8.3", "sm_90a", 5), ("b.ptx", None, None, 5)]


def test_gold_failures(spark):
    records = spark.createDataFrame([("a", "roofline_low_mfu", "high", True), ("b", None, "medium", False), ("c", "x", None, None)], "row_key string, primary_diagnosis string, confidence string, warning boolean")
    gold = spark.createDataFrame([("a", "register_pressure", "medium", False), ("b", "inconclusive", "high", True), ("c", None, None, None), ("z", "x", None, None)], "row_key string, expected_primary string, confidence_ceiling string, expect_warning boolean")
    joined = EV.gold_join(records, gold)
    got = sorted(tuple(r) for r in EV.gold_failures(joined).collect())
    assert got == [("a", "confidence_ceiling", "medium", "high"), ("a", "correctness_warning", "false", "true"), ("a", "primary", "register_pressure", "roofline_low_mfu"), ("b", "correctness_warning", "true", "false")]
    assert EV.gold_score(joined).first().failures == len(got)


def old_mix(body):
    """Mix, instructions, branches and loops line by line with the patterns of the categories."""
    lines = [x.strip(" \t\x0b\f") for x in re.split(r"\r\n|\r|\n", body)]
    label = re.compile(r"\$?[\w.]+:", re.A)
    ops = [(i, x) for i, x in enumerate(lines) if x and not label.fullmatch(x) and not x.startswith(".")]
    mix = Counter()
    for _, x in ops:
        c = next((n for n, p in PX.CATEGORIES if re.search(p, x, re.A)), "other")
        wide = re.search(r"(?i)\.v([248])\.", x) if c in ("global_loads", "global_stores") else None
        mix[c] += int(wide[1]) if wide else 1
        if c in ("global_loads", "global_stores", "local_loads", "local_stores") and ".f64" in x:
            mix["fp64_memory_ops"] += int(wide[1]) if wide else 1
    jumps = [(i, x) for i, x in ops if re.search(r"\bbra\b", x)]
    last = {x[:-1]: i for i, x in enumerate(lines) if label.fullmatch(x)}
    loops = {m[1] for i, x in jumps if (m := re.search(r"\bbra(?:\.uni)?\s+(\$?[\w.]+)", x)) and last.get(m[1], i) < i}
    return dict(mix), len(ops), len(jumps), len(loops)


def test_instruction_mix_of_odd_lines():
    odd = [
        "  ld.global.v4.f64 {a, b}, [c];", "st.global.v2.f32 [a], {b};", "LD.GLOBAL.V4.F32 x;", "ld.global.nc.V8.f32 x;", "ld.local.f64 a;", "$L1:  ", ".L2:", "@%p1 bra $L1;", "@!%p bra.uni .L2;", "bra $L9;", "$L9:", "bra;", "  ", ".reg .b32 %r<4>;", "// bra in a note",
        "call (r), f;", "cvt.f32.f64 a;", "setp.lt.s32 p;", "fma.rn.f64 a;", "add.bf16 a;", "atom.global.add.u32 a;", "mov.b64 a;", "nothing", "L1: add.f32 a;", "\tst.local.f64 a;\t", "sin.approx.f32 a;", "bar.sync 0;",
    ]
    rng, seen = random.Random(5), {}
    for end in ("\n", "\r\n", "\r"):
        for _ in range(60):
            body = end.join(rng.choices(odd, k=rng.randrange(0, 40)))
            n, mix, branches, conditional, loops = PX.instruction_mix(body, seen)
            assert (mix, n, branches, loops) == old_mix(body) and conditional == len(re.findall(r"@%\w+\s+bra\b", body))


def test_compiled_texts_are_read_once_and_by_many_tasks(spark, tmp_path):
    """One pass over the texts for both sides of a pair, in as many tasks as shuffles have; instructions cost no expression over arrays."""
    spark.range(1, 41).selectExpr("id AS p_partkey", "int(id % 50 + 1) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = QUERIES["ptx_instruction_mix"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rlike" not in plan.lower()
    assert TX.texts(spark, str(tmp_path), "ptx").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    diff = QUERIES["instruction_mix_diff"](spark, str(tmp_path))
    assert "Map" not in diff._jdf.queryExecution().optimizedPlan().toString()
    sizes = {r.category: (r.before, r.after) for r in diff.where("pair_id = 0").collect()}
    assert sizes["fp32_ops"] == (21 + 41, 2 + 22)  # parts 20 and 40, 1 and 21, of which each has its size in additions


def test_a_kernel_without_body(spark):
    kernels = spark.createDataFrame([(1, None), (2, " ret;")], "id long, body string")
    rows = {r.id: r for r in PX.ptx_instruction_mix(kernels).collect()}
    assert rows[1].instructions is None and rows[1].mix == {} and (rows[2].instructions, rows[2].mix) == (1, {"control_flow": 1})
