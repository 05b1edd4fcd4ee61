"""Queries over versions of kernels and over evaluation rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.operators import compare as D
from gaugefleet.operators import evaluate as V
from gaugefleet.operators import ptx as X
from gaugefleet.operators import source as S
from gaugefleet.plans import profiling as P
from gaugefleet.plans import texts as TX
from gaugefleet.plans.telemetry import _r, _rounded
from gaugefleet.plans.views import table, written


def _pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    sides = P._sides(df)
    return sides.where("side = 'before'").drop("side"), sides.where("side = 'after'").drop("side")


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return S.source_rule_match(S.source_signals(TX._scan(spark, d))).select("run_id", F.col("rule").alias("code")).distinct()


def _side(spark: SparkSession, d: str) -> DataFrame:
    """One row per run with what the layers say of it."""
    n = lambda c: F.sum(X._n(c))
    compiled = TX._ptx(spark, d).groupBy("run_id").agg(
        F.round(F.avg("registers")).cast("long").alias("register_count"), F.sum("local_bytes").alias("local_memory_bytes"), F.bool_or(F.col("local_bytes") > 0).alias("has_register_spills"), F.sum("instructions").alias("instruction_count"),
        n("global_loads").alias("global_load_count"), n("global_stores").alias("global_store_count"), n("shared_loads").alias("shared_load_count"), n("shared_stores").alias("shared_store_count"), F.sum("conditional_branches").alias("conditional_branch_count"),
    )
    profile = P._summary(spark, d).where("run_id % 4 < 2").select("run_id", "avg_dram_throughput_pct", "avg_l1_cache_hit_rate_pct", "avg_l2_cache_hit_rate_pct", "avg_issue_slot_utilization_pct", "avg_occupancy_pct")
    source = _codes(spark, d).groupBy("run_id").agg(F.collect_set("code").alias("source_codes"))
    return compiled.join(profile, "run_id", "left").join(source, "run_id", "left")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return D.numeric_bool_diff(*_pairs(_side(spark, d).drop("source_codes")))


def _card(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pairs(_side(spark, d))
    return D.scorecard(D.version_scores(a), D.version_scores(b))


def q_finding_diff(spark, d):
    return D.finding_diff(*_pairs(_codes(spark, d)))


def q_feature_set_diff(spark, d):
    kernels = S.patterns(S.source_signals(TX._scan(spark, d)))
    features = kernels.select("run_id", F.explode(F.concat("styles", "indexing")).alias("f")).groupBy("run_id").agg(F.collect_set("f").alias("features"))
    return D.feature_set_diff(*_pairs(features)).withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})


def q_instruction_mix_diff(spark, d):
    mix = TX._ptx(spark, d).select("run_id", F.explode("mix").alias("category", "n")).groupBy("run_id", "category").agg(F.sum("n").alias("n"))
    return D.instruction_mix_diff(*_pairs(written(mix)))


def q_numeric_bool_diff(spark, d):
    return _rounded(_diff(spark, d))


def q_tradeoffs(spark, d):
    return D.tradeoffs(_diff(spark, d))


def q_scorecard(spark, d):
    return _card(spark, d)


def q_scorecard_verdict(spark, d):
    return D.scorecard_verdict(_card(spark, d))


def q_case_validation(spark, d):
    a, b = _pairs(_codes(spark, d))
    strings = lambda *x: F.array(*map(F.lit, x))
    cases = a.select("pair_id").distinct().select("pair_id", strings("uncoalesced_access").alias("detected_before"), F.when(F.col("pair_id") % 2 == 0, strings("sync_inside_tight_loop")).otherwise(F.array().cast("array<string>")).alias("resolved_after"), (F.col("pair_id") % 3 > 0).alias("no_new_findings"))
    out = D.case_validation(cases, a, D.finding_diff(a, b))
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing_before", "missing_resolved", "new_findings")})


# --- evaluation -------------------------------------------------------------------------------------

_PRIMARY = "CASE doc_id % 5 WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'memory_bandwidth_saturation' WHEN 3 THEN 'roofline_low_mfu' WHEN 4 THEN 'inefficient_global_memory_access' END"
_SURE = "CASE doc_id % 7 WHEN 0 THEN 'low-medium' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium-high' WHEN 3 THEN 'high' WHEN 4 THEN 'confirmed' END"
_METRIC = "concat('''{n}'': {{''avg_value'': ', {v}, ', ''unit'': ''{u}''}}')"
_PROFILE = ", ', ', ".join(
    _METRIC.format(n=n, v=v, u=u)
    for n, v, u in (
        ("Achieved Occupancy", "doc_id % 97", "%"), ("Max Bandwidth", "doc_id % 89", "%"), ("Memory Throughput", "99", "byte/second"), ("L1/TEX Hit Rate", "doc_id % 83", "%"), ("L2 Hit Rate", "doc_id % 79", "byte"),
        ("Issue Slots Busy", "doc_id % 73", "%"), ("Block Limit Registers", "doc_id % 4", "block"), ("Block Limit Warps", "doc_id % 3", "block"), ("Block Limit SM", "16", "block"),
    )
)


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """row_key, level, correct, error, lint, speedup, source_codes and profile of every labelled document."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null")
    return both.selectExpr(
        "doc_id AS row_key", "doc_id % 3 + 1 AS level", "quality = 1 AS correct", "CASE WHEN toxic = 1 THEN 'failed to build' ELSE ' ' END AS error", "CASE WHEN doc_id % 31 = 0 THEN 'a.cu:3: error: no' ELSE 'a.cu:3: warning' END AS lint",
        "n_chars / 5000.0D AS speedup", "CASE WHEN doc_id % 29 = 0 THEN array('conditional_syncthreads') ELSE array('warp_divergence') END AS source_codes",
        f"CASE WHEN doc_id % 11 = 0 THEN 'not a profile' ELSE concat('{{''metrics'': {{', {_PROFILE}, '}}}}') END AS profile", f"{_PRIMARY} AS primary_diagnosis", f"{_SURE} AS confidence", "CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity",
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = V.correctness_warning(eval_rows(spark, d))
    weak = V.weak_label(V.adapt_eval_profile(rows)).select("row_key", "weak_label")
    return rows.join(weak, "row_key", "left").withColumn("weak_label", F.coalesce("weak_label", F.lit("no_ncu")))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("doc_id % 10 = 0 and quality is not null").selectExpr(
        "doc_id AS row_key", "CASE WHEN doc_id % 20 = 0 THEN 'inconclusive' END AS expected_primary", "CASE WHEN doc_id % 30 = 0 THEN 'medium' END AS confidence_ceiling", "CASE WHEN doc_id % 4 = 0 THEN toxic = 1 END AS expect_warning"
    )


def q_adapt_eval_profile(spark, d):
    return V.adapt_eval_profile(eval_rows(spark, d)).select("row_key", "achieved_occupancy_pct", "dram_throughput_pct", "l1_cache_hit_rate_pct", "l2_cache_hit_rate_pct", "issue_slot_utilization_pct", F.array_join("limiters", ",").alias("limiters"))


def q_weak_label(spark, d):
    return records(spark, d).select("row_key", "weak_label")


def q_weak_agreement(spark, d):
    return records(spark, d).select("row_key", V.weak_agreement(F.col("primary_diagnosis"), F.col("weak_label")).alias("agrees"))


def q_correctness_warning(spark, d):
    return V.correctness_warning(eval_rows(spark, d)).select("row_key", "warning", F.array_join("reasons", ",").alias("reasons"))


def q_eval_leaderboard(spark, d):
    return V.eval_leaderboard(records(spark, d))


def q_diagnosis_distribution(spark, d):
    return _rounded(V.diagnosis_distribution(eval_rows(spark, d)))


def q_gold_join(spark, d):
    return V.gold_join(V.correctness_warning(eval_rows(spark, d)), _gold(spark, d)).select("row_key", "primary_ok", "ceiling_ok", "warning_ok")


def q_gold_failures(spark, d):
    return V.gold_failures(V.gold_join(V.correctness_warning(eval_rows(spark, d)), _gold(spark, d)))


def q_gold_score(spark, d):
    return V.gold_score(V.gold_join(V.correctness_warning(eval_rows(spark, d)), _gold(spark, d)))


QUERIES = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}

_SIDES = f"""{P._SUMMARY}, {TX._P}, {TX._C},
    sco AS (SELECT DISTINCT run_id, rule AS code FROM fi WHERE rule NOT LIKE 'poor%'), sgr AS (SELECT run_id AS sr, list(code) AS source_codes FROM sco GROUP BY 1),
    ptx AS (SELECT run_id, CAST(round(avg(regs)) AS BIGINT) AS register_count, sum(loc) AS local_memory_bytes, bool_or(loc > 0) AS has_register_spills, sum(ins) AS
      instruction_count, sum(gl) AS global_load_count, sum(gs) AS global_store_count, sum(sl) AS shared_load_count, 0 AS shared_store_count, sum(cb) AS
      conditional_branch_count FROM px GROUP BY run_id),
    side AS (SELECT ptx.*, avg_dram_throughput_pct, avg_l1_cache_hit_rate_pct, avg_l2_cache_hit_rate_pct, avg_issue_slot_utilization_pct, avg_occupancy_pct, source_codes
      FROM ptx LEFT JOIN (SELECT * FROM rs WHERE run_id % 4 < 2) p ON p.run_id = ptx.run_id LEFT JOIN sgr ON sr = ptx.run_id)"""
_FIELDS = ["register_count", "local_memory_bytes", "instruction_count", "global_load_count", "global_store_count", "shared_load_count", "shared_store_count", "conditional_branch_count", "avg_dram_throughput_pct", "avg_l1_cache_hit_rate_pct", "avg_l2_cache_hit_rate_pct", "avg_issue_slot_utilization_pct", "avg_occupancy_pct"]
_UP = ("shared_load_count", "shared_store_count", "avg_l1_cache_hit_rate_pct", "avg_l2_cache_hit_rate_pct", "avg_issue_slot_utilization_pct", "avg_occupancy_pct")
_two = "FROM (SELECT * FROM side WHERE run_id % 2 = 0) a JOIN (SELECT * FROM side WHERE run_id % 2 = 1) b ON a.run_id // 2 = b.run_id // 2"
_NB = f"""{_SIDES}, nb AS ({" UNION ALL ".join(f"SELECT a.run_id // 2 AS pair_id, '{f}' AS field, a.{f}::DOUBLE AS before, b.{f}::DOUBLE AS after, (b.{f} - a.{f})::DOUBLE AS delta, CASE WHEN b.{f} = a.{f} THEN 'tie' WHEN b.{f} {'>' if f in _UP else '<'} a.{f} THEN 'b' WHEN b.{f} IS NOT NULL AND a.{f} IS NOT NULL THEN 'a' END AS better, NULL AS change {_two} WHERE a.{f} IS NOT NULL OR b.{f} IS NOT NULL" for f in _FIELDS)}
    UNION ALL SELECT a.run_id // 2, 'has_register_spills', a.has_register_spills::INT::DOUBLE, b.has_register_spills::INT::DOUBLE, NULL, NULL, CASE WHEN
      a.has_register_spills AND NOT b.has_register_spills THEN 'resolved' WHEN b.has_register_spills AND NOT a.has_register_spills THEN 'introduced' ELSE '' END {_two})"""
_u = lambda x: f"CASE WHEN {x} IS NOT NULL THEN least(1.0, greatest(0.0, {x})) END"
_SCORES = {
    "register_efficiency": f"CASE WHEN has_register_spills THEN 0.0 ELSE {_u('(1.0 - (register_count - 32) / 96)')} END",
    "memory_efficiency": f"coalesce(0.3 * {_u('(1.0 - avg_dram_throughput_pct / 100)')} + 0.4 * {_u('(avg_l1_cache_hit_rate_pct / 100)')} + 0.3 * {_u('(avg_l2_cache_hit_rate_pct / 100)')}, {_u('(1.0 - least(1.0, (global_load_count + global_store_count) / instruction_count / 0.4) + least(0.2, (shared_load_count + shared_store_count) / instruction_count / 0.2))')})",
    "compute_efficiency": f"coalesce(0.6 * {_u('(avg_issue_slot_utilization_pct / 100)')} + 0.4 * {_u('(avg_occupancy_pct / 100)')}, {_u('(1.0 - conditional_branch_count / instruction_count / 0.15)')})",
    "launch_efficiency": f"coalesce({_u('(avg_occupancy_pct / 100)')}, CASE WHEN source_codes IS NOT NULL THEN 1.0 - list_contains(source_codes, 'possible_shared_memory_bank_conflict')::INT * 0.2 - list_contains(source_codes, 'missing_obvious_bounds_guard')::INT * 0.1 END)",
    "sync_efficiency": "CASE WHEN source_codes IS NOT NULL THEN 1.0 - list_contains(source_codes, 'unnecessary_syncthreads')::INT * 0.25 END",
}
_CARD = f"""{_SIDES}, sco2 AS ({" UNION ALL ".join(f"SELECT run_id, '{k}' AS dimension, ({v})::DOUBLE AS score FROM side" for k, v in _SCORES.items())}),
    card AS (SELECT a.run_id // 2 AS pair_id, a.dimension, {_r("a.score")} AS score_a, {_r("b.score")} AS score_b, CASE WHEN coalesce(b.score, 0) - coalesce(a.score, 0) >
      0.02 THEN 'b' WHEN coalesce(b.score, 0) - coalesce(a.score, 0) < -0.02 THEN 'a' ELSE 'tie' END AS winner
      FROM sco2 a JOIN sco2 b ON a.run_id // 2 = b.run_id // 2 AND a.dimension = b.dimension WHERE a.run_id % 2 = 0 AND b.run_id % 2 = 1 AND (a.score IS NOT NULL OR b.score IS NOT NULL))"""
_FD = f"""WITH {TX._C}, sco AS (SELECT DISTINCT run_id, rule AS code FROM fi WHERE rule NOT LIKE 'poor%'),
    fd AS (SELECT coalesce(a.p, b.p) AS pair_id, coalesce(a.code, b.code) AS code, CASE WHEN b.p IS NULL THEN 'resolved' WHEN a.p IS NULL THEN 'new' ELSE 'shared' END AS
      status FROM (SELECT run_id // 2 AS p, code FROM sco WHERE run_id % 2 = 0) a FULL JOIN (SELECT run_id // 2 AS p, code FROM sco WHERE run_id % 2 = 1) b ON a.p = b.p AND
      a.code = b.code)"""
_CATS = {"global_loads": "gl", "global_stores": "gs", "shared_loads": "sl", "local_loads": "ll", "control_flow": "cb + 1", "fp64_ops": "f64", "fp32_ops": "sz", "fp64_memory_ops": "gs"}
_EVAL = f"""WITH er AS (SELECT l.doc_id AS row_key, l.doc_id, quality = 1 AS correct, CASE WHEN toxic = 1 THEN 'failed to build' ELSE ' ' END AS error, n_chars /
      5000.0::DOUBLE AS speedup, {_PRIMARY.replace("doc_id", "l.doc_id")} AS primary_diagnosis, {_SURE.replace("doc_id", "l.doc_id")} AS confidence,
      CASE WHEN l.doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, toxic = 1 OR l.doc_id % 31 = 0 OR l.doc_id % 29 = 0 AS warning, concat_ws(',', CASE WHEN toxic
      = 1 THEN 'error_text' END, CASE WHEN l.doc_id % 31 = 0 THEN 'lint_error' END, CASE WHEN l.doc_id % 29 = 0 THEN 'risk:conditional_syncthreads' END) AS reasons,
      coalesce(toxic = 1, false) AS failed FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL),
    ap AS (SELECT row_key, (doc_id % 97)::DOUBLE AS achieved_occupancy_pct, (doc_id % 89)::DOUBLE AS dram_throughput_pct, (doc_id % 83)::DOUBLE AS l1_cache_hit_rate_pct,
      NULL::DOUBLE AS l2_cache_hit_rate_pct, (doc_id % 73)::DOUBLE AS issue_slot_utilization_pct,
      CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'blocks' WHEN doc_id % 4 = 0 THEN 'threads' WHEN doc_id % 3 = 0 THEN 'registers' WHEN doc_id % 4 = doc_id % 3 THEN
      'registers,threads' WHEN doc_id % 4 < doc_id % 3 THEN 'registers' ELSE 'threads' END AS limiters FROM er WHERE doc_id % 11 <> 0),
    wl AS (SELECT row_key AS wk, CASE WHEN achieved_occupancy_pct < 40 THEN 'low_occupancy' WHEN dram_throughput_pct > 60 THEN 'memory_bound' WHEN l1_cache_hit_rate_pct <
      40 THEN 'cache_thrashing' WHEN issue_slot_utilization_pct < 60 THEN 'low_issue_efficiency' ELSE 'inconclusive' END AS weak FROM ap),
    re AS (SELECT er.*, coalesce(weak, 'no_ncu') AS weak_label, primary_diagnosis IS NOT NULL AND primary_diagnosis <> 'inconclusive' AS concrete, CASE confidence WHEN
      'low-medium' THEN 0 WHEN 'medium' THEN 1 WHEN 'medium-high' THEN 2 WHEN 'high' THEN 3 WHEN 'confirmed' THEN 4 ELSE -1 END AS rank FROM er LEFT JOIN wl ON wk = row_key),
    rw AS (SELECT *, coalesce((weak_label = 'memory_bound' AND primary_diagnosis IN ('memory_bandwidth_saturation', 'inefficient_global_memory_access')) OR (weak_label IN
      ('low_occupancy', 'low_issue_efficiency') AND primary_diagnosis = 'roofline_low_mfu'), false) AS agrees FROM re),
    go AS (SELECT re.row_key, CASE WHEN doc_id % 20 = 0 THEN coalesce(primary_diagnosis, 'inconclusive') = 'inconclusive' END AS primary_ok, CASE WHEN doc_id % 30 = 0
      THEN rank <= 1 END AS ceiling_ok, CASE WHEN doc_id % 4 = 0 THEN warning = failed END AS warning_ok FROM re WHERE doc_id % 10 = 0)"""
_rate = lambda part, whole="true": _r(f"count(CASE WHEN ({part}) AND ({whole}) THEN 1 END) / nullif(count(CASE WHEN {whole} THEN 1 END), 0)")
ORACLES = {
    "finding_diff": f"{_FD} SELECT * FROM fd",
    "feature_set_diff": f"""WITH {TX._C}, ft AS (SELECT DISTINCT run_id, f FROM (SELECT run_id, unnest([CASE WHEN loads > 0 THEN 'likely_coalesced_1d' END, CASE WHEN
      strided THEN 'strided_or_pitched' END, CASE WHEN sh THEN 'shared_memory_tiling' END, CASE WHEN loads = 0 AND NOT strided AND NOT sh AND accesses > 0 THEN
      'indexed_global_or_local_memory' END, CASE WHEN grid THEN '1d_grid_stride_index' WHEN diverge THEN 'thread_x_indexing' END]) AS f FROM cn) WHERE f IS NOT NULL),
      fl AS (SELECT run_id, list(f) AS fs FROM ft GROUP BY run_id) SELECT a.run_id // 2 AS pair_id, coalesce(list_aggregate(list_sort(list_filter(b.fs, lambda x: NOT
      list_contains(a.fs, x))), 'string_agg', ','), '') AS added, coalesce(list_aggregate(list_sort(list_filter(a.fs, lambda x: NOT list_contains(b.fs, x))), 'string_agg',
      ','), '') AS removed FROM fl a JOIN fl b ON a.run_id // 2 = b.run_id // 2 WHERE a.run_id % 2 = 0 AND b.run_id % 2 = 1""",
    "instruction_mix_diff": f"""WITH {TX._P}, sums AS (SELECT run_id // 2 AS p, run_id % 2 AS side, {", ".join(f"CAST(sum({x}) AS BIGINT) AS {k}" for k, x in _CATS.items())} FROM px GROUP BY ALL),
      tall AS (UNPIVOT sums ON {", ".join(_CATS)} INTO NAME category VALUE n)
      SELECT p AS pair_id, category, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS before, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS after,
        CAST(coalesce(sum(n) FILTER (side = 1), 0) - coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS delta FROM tall GROUP BY ALL HAVING sum(n) > 0""",
    "numeric_bool_diff": f"{_NB} SELECT pair_id, field, {', '.join(_r(c) + f' AS {c}' for c in ('before', 'after', 'delta'))}, better, change FROM nb",
    "tradeoffs": f"""{_NB}, t AS (SELECT pair_id, max(CASE WHEN field = 'register_count' THEN better END) AS reg, max(CASE WHEN field = 'has_register_spills' THEN change
      END) AS spill, max(CASE WHEN field = 'avg_occupancy_pct' THEN better END) AS occ, max(CASE WHEN field = 'avg_occupancy_pct' THEN delta END) AS d FROM nb GROUP BY 1),
      u AS (SELECT *, coalesce(reg = 'b', false) OR spill = 'resolved' AS up, coalesce(reg = 'a', false) OR spill = 'introduced' AS down FROM t) SELECT pair_id,
      'register_pressure_improved_but_occupancy_regressed' AS label FROM u WHERE up AND occ = 'a' UNION ALL SELECT pair_id,
      'occupancy_improved_but_register_pressure_regressed' FROM u WHERE down AND occ = 'b' UNION ALL SELECT pair_id, 'large_occupancy_shift' FROM u WHERE abs(d) >= 20 AND NOT
      up AND NOT down""",
    "scorecard": f"{_CARD} SELECT * FROM card",
    "scorecard_verdict": f"""{_CARD}, v AS (SELECT pair_id, {_r("sum(coalesce(score_a, 0) * w) / sum(w)")} AS score_a, {_r("sum(coalesce(score_b, 0) * w) / sum(w)")} AS
      score_b FROM (SELECT *, CASE dimension WHEN 'sync_efficiency' THEN 0.2 WHEN 'register_efficiency' THEN 0.15 WHEN 'launch_efficiency' THEN 0.15 ELSE 0.25 END::DOUBLE AS w
      FROM card) GROUP BY pair_id)
      SELECT *, CASE WHEN {_r("score_b - score_a")} > 0.02 THEN 'b' WHEN {_r("score_b - score_a")} < -0.02 THEN 'a' ELSE 'tie' END AS overall_winner FROM v""",
    "case_validation": f"""{_FD}, c AS (SELECT DISTINCT run_id // 2 AS pair_id FROM sco WHERE run_id % 2 = 0),
      m AS (SELECT pair_id, CASE WHEN EXISTS (SELECT 1 FROM sco WHERE run_id = 2 * pair_id AND code = 'uncoalesced_access') THEN '' ELSE 'uncoalesced_access' END AS
      missing_before, CASE WHEN pair_id % 2 = 1 OR EXISTS (SELECT 1 FROM fd f WHERE f.pair_id = c.pair_id AND code = 'sync_inside_tight_loop' AND status = 'resolved') THEN ''
      ELSE 'sync_inside_tight_loop' END AS missing_resolved,
        CASE WHEN pair_id % 3 = 0 THEN '' ELSE coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM fd f WHERE f.pair_id = c.pair_id AND status = 'new'), '') END AS
        new_findings FROM c) SELECT *, missing_before = '' AND missing_resolved = '' AND new_findings = '' AS passed FROM m""",
    "adapt_eval_profile": f"{_EVAL} SELECT * FROM ap",
    "weak_label": f"{_EVAL} SELECT row_key, weak_label FROM rw",
    "weak_agreement": f"{_EVAL} SELECT row_key, agrees FROM rw",
    "correctness_warning": f"{_EVAL} SELECT row_key, coalesce(warning, false) AS warning, reasons FROM er",
    "eval_leaderboard": f"""{_EVAL} SELECT count(*) AS rows_evaluated, {_rate("concrete")} AS coverage, {_rate("agrees", "weak_label NOT IN ('no_ncu', 'inconclusive')")}
      AS weak_agreement, count(CASE WHEN weak_label NOT IN ('no_ncu', 'inconclusive') THEN 1 END) AS weak_n, {_rate("warning", "NOT correct AND failed")} AS
      warned_build_errors,
      {_rate("warning", "NOT correct AND NOT failed")} AS warned_silent, {_rate("warning", "correct")} AS warned_correct,
      {_rate("NOT (severity = 'high' AND rank >= 3)", "speedup >= 1")} AS fast_not_overclaimed, {_rate("concrete", "speedup < 1")} AS slow_explained, {_rate("rank <= 2")} AS
      ceiling_respected, arg_max(confidence, rank) AS max_confidence FROM rw""",
    "diagnosis_distribution": f"{_EVAL} SELECT *, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT coalesce(primary_diagnosis, 'none') AS label, count(*) AS n FROM er GROUP BY 1)",
    "gold_join": f"{_EVAL} SELECT * FROM go",
    "gold_failures": f"""{_EVAL}, gf AS (SELECT go.*, primary_diagnosis, confidence, warning, failed FROM go JOIN re ON re.row_key = go.row_key)
      SELECT row_key, 'primary' AS "check", 'inconclusive' AS expected, primary_diagnosis AS got FROM gf WHERE NOT primary_ok UNION ALL SELECT row_key, 'confidence_ceiling', 'medium', confidence FROM gf WHERE NOT ceiling_ok
      UNION ALL SELECT row_key, 'correctness_warning', failed::VARCHAR, warning::VARCHAR FROM gf WHERE NOT warning_ok""",
    "gold_score": f"{_EVAL} SELECT count(*) AS matched, {_rate('primary_ok', 'primary_ok IS NOT NULL')} AS primary_accuracy, {_rate('ceiling_ok', 'ceiling_ok IS NOT NULL')} AS ceiling_accuracy, {_rate('warning_ok', 'warning_ok IS NOT NULL')} AS warning_accuracy, count(CASE WHEN NOT primary_ok THEN 1 END) + count(CASE WHEN NOT ceiling_ok THEN 1 END) + count(CASE WHEN NOT warning_ok THEN 1 END) AS failures FROM go",
}
