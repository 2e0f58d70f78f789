"""Queries of context validation, batch planning, capacity verdicts and allocation ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lengthlab.functions import keys
from lengthlab.functions.units import round_up
from lengthlab.operators import ledger as G
from lengthlab.operators import lengths as L
from lengthlab.operators import planning as P
from lengthlab.operators import stats as S
from lengthlab.plans.statistics import DERIVED, preference_lengths, stored_lengths, text_lengths
from lengthlab.scratch import stored
from lengthlab.views import duck, table, view

BUDGETS = [1024, 2048, 4096, 8192]
GPUS = [("g40", 40), ("g80", 80), ("g150", 150), ("unknown", None)]
_KEY = "CASE WHEN alias_group IS NULL THEN name ELSE alias_group END"
_NULLED = "CASE WHEN count(*) FILTER ({0} IS NULL) = 0 THEN {1}({0}) END"

LEDGER = DERIVED | {
    "live": """
SELECT a.*, t.ord, t.phase, t.tp FROM {v_allocations} a JOIN {v_timepoints} t ON a.live_at = t.tp OR a.live_at = t.phase || ':*'""",
    "items": f"""
SELECT scenario_id, ord, phase, tp, {_KEY} AS item, min(category) AS category, {_NULLED.format('bytes_low', 'max')} AS low,
  {_NULLED.format('bytes_high', 'max')} AS high FROM {{live}} GROUP BY scenario_id, ord, phase, tp, {_KEY}""",
    "totals": f"""
SELECT scenario_id, ord, phase, tp, CAST({_NULLED.format('low', 'sum')} AS BIGINT) AS low, CAST({_NULLED.format('high', 'sum')} AS BIGINT) AS high,
  CAST(coalesce(sum(low) FILTER (category IN ('weights_base', 'optimizer_states')), 0) AS BIGINT) AS floor,
  CAST(coalesce(sum(high), 0) AS BIGINT) AS known_high, coalesce(string_agg(DISTINCT item, ',' ORDER BY item) FILTER (high IS NULL), '') AS unknown
FROM {{items}} GROUP BY scenario_id, ord, phase, tp""",
    "peaks": """
SELECT scenario_id, tp, low, high, floor, known_high FROM (SELECT *, row_number() OVER (
  PARTITION BY scenario_id ORDER BY (high IS NULL) DESC, known_high DESC, ord) AS k FROM {totals}) t WHERE k = 1""",
    "phases": """
SELECT scenario_id, phase, tp, low, high FROM (SELECT *, row_number() OVER (
  PARTITION BY scenario_id, phase ORDER BY (high IS NULL) DESC, known_high DESC, ord) AS k FROM {totals}) t WHERE k = 1""",
    "limits": """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1000 + s_suppkey END AS model,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 1200 - s_suppkey END AS backend,
  CASE s_suppkey % 5 WHEN 0 THEN CAST(1e30 AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(900 AS DOUBLE) END AS tok FROM {supplier}""",
    "margins": "SELECT *, CASE WHEN high IS NOT NULL THEN greatest(10, (high * 15 + 99) // 100) END AS margin FROM {peaks}",
    "fits": """
SELECT *, CASE WHEN capacity IS NULL THEN 'not_evaluated' WHEN readiness = 'unsupported' THEN 'unsupported' WHEN floor > capacity THEN 'floor_exceeds_capacity'
    WHEN load_bytes > capacity THEN 'load_budget_insufficient' WHEN evidence = 'metadata_only' THEN 'unsupported' WHEN high IS NULL THEN 'unknown_components'
    WHEN high > capacity THEN 'high_exceeds_capacity' WHEN high + margin > capacity THEN 'margin_insufficient' ELSE 'fits_with_margin' END AS reason
FROM (SELECT m.*, CASE WHEN scenario_id % 17 = 0 THEN 'unsupported' ELSE 'ready' END AS readiness,
    CASE WHEN scenario_id % 19 = 0 THEN 'metadata_only' ELSE 'analytic' END AS evidence, scenario_id % 100 AS load_bytes FROM {margins} m) s,
  (VALUES ('g40', 40), ('g80', 80), ('g150', 150), ('unknown', NULL)) g(gpu, capacity)""",
    "status": """
SELECT *, CASE reason WHEN 'not_evaluated' THEN 'not_evaluated' WHEN 'unsupported' THEN 'unknown' WHEN 'unknown_components' THEN 'unknown'
  WHEN 'margin_insufficient' THEN 'low_margin' WHEN 'fits_with_margin' THEN 'expected_fit' ELSE 'exceeds' END AS status FROM {fits}""",
}


def sql(query: str) -> str:
    return duck(query, LEDGER)


def _live(spark, sf_dir):
    return G.expand_liveness(view(spark, sf_dir, "v_allocations"), view(spark, sf_dir, "v_timepoints"))


def _items(spark, sf_dir):
    return G.collapse_aliases(_live(spark, sf_dir))


def _totals(spark, sf_dir):
    return G.timepoint_totals(_items(spark, sf_dir))


def _peaks(spark, sf_dir):
    return G.peak_timepoint(_totals(spark, sf_dir))


def _margins(spark, sf_dir):
    return _peaks(spark, sf_dir).withColumn("margin", P.planning_margin(F.col("high"), 10))


def _fits(spark, sf_dir):
    k = F.col("scenario_id")
    rows = _margins(spark, sf_dir).withColumns(
        {
            "readiness": F.when(k % 17 == 0, "unsupported").otherwise("ready"),
            "evidence": F.when(k % 19 == 0, "metadata_only").otherwise("analytic"),
            "load_bytes": k % 100,
        }
    )
    return P.assess_fit(rows, spark.createDataFrame(GPUS, "gpu string, capacity long"))


def _limits(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("k"),
        F.when(k % 3 != 0, 1000 + k).alias("model"),
        F.when(k % 4 != 0, 1200 - k).alias("backend"),
        F.when(k % 5 == 0, F.lit(1e30)).when(k % 5 != 1, F.lit(900.0)).alias("tok"),
    )
    return rows.select("k", P.effective_limit(F.col("model"), F.col("backend"), F.col("tok")).alias("x")).select("k", "x.limit", "x.source")


def _grpo(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference").withColumns({"split": F.lit("train"), "shard_id": F.lit("c")})
    return L.grpo(rows)


def _facts(spark, sf_dir):
    """One fact row per shard of the text rows."""
    rows = text_lengths(spark, sf_dir).groupBy(F.col("shard_id").alias("dataset"))
    k = F.regexp_extract("dataset", "[0-9]+", 0).cast("int")
    return rows.agg(
        F.count("*").alias("rows_seen"),
        F.count_if(F.col("processing_status") == "ok").alias("rows_ok"),
        F.count_if(F.col("processing_status") == "failed").alias("rows_failed"),
        F.max(F.struct((F.col("context_status") == "exceeded"), "context_status"))["context_status"].alias("context_status"),
    ).withColumns(
        {
            "complete": F.lit(True), "packing": k % 7 == 3, "loss_rows": F.when(k % 5 == 2, 4).otherwise(0), "dropped_rows": F.when(k % 2 == 0, k % 3),
            "include_eval": k % 3 == 1,
        }
    )


_AUDIT = """
SELECT dataset, x.c AS "check", x.o AS outcome, CASE max(CASE x.o WHEN 'violated' THEN 3 WHEN 'unknown' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END) OVER (PARTITION BY dataset)
  WHEN 3 THEN 'violated' WHEN 2 THEN 'unknown' WHEN 1 THEN 'pending' ELSE 'verified' END AS overall
FROM (SELECT dataset, unnest([
    {'c': 'full_read', 'o': CASE WHEN failed = 0 THEN 'pass' ELSE 'unknown' END},
    {'c': 'no_length_drop', 'o': CASE WHEN k % 7 = 3 THEN 'violated' ELSE 'pass' END},
    {'c': 'no_split_or_concat', 'o': CASE WHEN k % 7 = 3 THEN 'violated' ELSE 'pass' END},
    {'c': 'template_content_preserved', 'o': CASE WHEN k % 5 = 2 THEN 'violated' WHEN ok = 0 THEN 'unknown' ELSE 'pass' END},
    {'c': 'last_batch_included', 'o': CASE WHEN k % 2 <> 0 THEN 'pending' WHEN k % 3 > 0 THEN 'violated' ELSE 'pass' END},
    {'c': 'context_within_limit', 'o': CASE WHEN exceeded THEN 'violated' WHEN failed > 0 THEN 'unknown' ELSE 'pass' END},
    {'c': 'eval_scope_consistent', 'o': CASE WHEN k % 3 = 1 THEN 'pending' ELSE 'na' END},
    {'c': 'packing_safe', 'o': CASE WHEN k % 7 = 3 THEN 'violated' ELSE 'na' END}]) AS x
  FROM (SELECT shard_id AS dataset, CAST(regexp_extract(shard_id, '[0-9]+') AS INT) AS k, count(*) FILTER (processing_status = 'failed') AS failed,
    count(*) FILTER (processing_status = 'ok') AS ok, bool_or(context_status = 'exceeded') AS exceeded FROM {sft} GROUP BY shard_id) f) t"""


def _val2(spark, sf_dir):
    lengths = stored_lengths(spark, sf_dir)
    value = F.col("sequence_tokens")
    out = [P.context_validation(lengths, value, limit, extra) for limit, extra in ((1024, 0), (10**6, 512), (None, 0))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _guarded(spark, sf_dir):
    k = F.col("scenario_id")
    out = P.guard_verdicts(_fits(spark, sf_dir), k % 5 == 0, F.when(k % 3 == 0, 2).otherwise(0), k % 7 == 0)
    return out.select("scenario_id", "gpu", "status", "reason")


def _bat1(spark, sf_dir):
    lengths = stored_lengths(spark, sf_dir)
    rows = [P.worst_batch(lengths, F.col("sequence_tokens"), b, m) for b, m in ((8, 64), (1, None))]
    return rows[0].unionByName(rows[1])


def _bat3(spark, sf_dir):
    lengths = stored_lengths(spark, sf_dir)
    batch = P.worst_batch(lengths, F.col("sequence_tokens"), 8, 64)
    return P.chunked_logits(lengths, batch, 8).select("b", "width", "logits")


def _configs(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), (k % 5).alias("g"), (k % 4 * 4).alias("gbs"), (k % 3 * 2).alias("b"), (k % 4).alias("spg")
    )


_CONFIG = "SELECT s_suppkey AS k, s_suppkey % 5 AS g, s_suppkey % 4 * 4 AS gbs, s_suppkey % 3 * 2 AS b, s_suppkey % 4 AS spg FROM {supplier}"


def _bat6(spark, sf_dir):
    rows = text_lengths(spark, sf_dir).groupBy("shard_id").agg(F.count("sequence_tokens").alias("n"))
    unit, batch = F.lit(4), F.lit(8)
    random, repeat = P.sampler_coverage(F.col("n"), None, batch), P.sampler_coverage(F.col("n"), unit, batch)
    return rows.select(
        "shard_id", random["dropped"].alias("random_dropped"), repeat["dropped"].alias("repeat_dropped"), repeat["covers_all"].alias("covers_all"),
        random["tail"].alias("tail"),
    )


def _bat7(spark, sf_dir):
    rows = text_lengths(spark, sf_dir).groupBy("shard_id").agg(F.count("sequence_tokens").alias("n"), F.max("sequence_tokens").alias("w"))
    worst = round_up(F.col("w"), 64)
    return rows.select(
        "shard_id", P.sampler_max(worst, F.col("n"), F.lit(40)).alias("random_max"), P.sampler_max(worst, F.col("n"), F.lit(40), F.lit(1)).alias("repeat_max")
    )


def _bat8(spark, sf_dir):
    rows = text_lengths(spark, sf_dir).groupBy("shard_id").agg(F.count("sequence_tokens").alias("n"))
    source = keys.stable_key("pre_", F.col("shard_id"))
    return rows.select("shard_id", keys.stable_key("bat_", source, F.col("n"), F.lit("random"), F.lit(64)).alias("batch_key"))


def _win7(spark, sf_dir):
    peaks = _peaks(spark, sf_dir).withColumn("owner", F.floor(F.col("scenario_id") / 50).cast("long"))
    return G.scenario_delta(peaks, "owner", "scenario_id").select("scenario_id", "owner", "high", "delta")


ENTRIES = {
    "val1_effective_limit": (
        _limits,
        sql("""
SELECT k, CAST(coalesce(least(model, backend), CASE WHEN tok < 1e20 THEN tok END) AS BIGINT) AS "limit",
  CASE WHEN model IS NOT NULL AND model <= coalesce(backend, model) THEN 'model' WHEN backend IS NOT NULL THEN 'backend' WHEN tok < 1e20 THEN 'tokenizer' END AS source FROM {limits}"""),
    ),
    "val2_context_validation": (
        _val2,
        sql(
            " UNION ALL ".join(
                f"SELECT CAST({limit} AS BIGINT) AS effective_limit, (max(sequence_tokens) + {extra})::BIGINT AS max_observed, "
                f"CASE WHEN {limit} IS NOT NULL THEN count(*) FILTER (sequence_tokens > {limit} - {extra}) END AS exceeded_rows, "
                f"{limit} IS NOT NULL AND count(*) FILTER (processing_status = 'failed') = 0 AS exceeded_rows_exact, "
                f"CASE WHEN {limit} IS NULL THEN 'unknown' WHEN max(sequence_tokens) + {extra} > {limit} THEN 'exceeded' "
                f"WHEN count(*) FILTER (processing_status = 'failed') = 0 THEN 'ok' ELSE 'unknown' END AS status FROM {{sft}}"
                for limit, extra in ((1024, 0), (10**6, 512), ("NULL", 0))
            )
        ),
    ),
    "val3_context_per_budget": (
        lambda s, d: P.context_per_budget(_grpo(s, d), F.col("prompt_tokens"), 4200, BUDGETS),
        sql("""
SELECT budget::BIGINT AS budget, (max(prompt_tokens) + budget)::BIGINT AS max_observed, count(*) FILTER (prompt_tokens > 4200 - budget) AS exceeded_rows,
  CASE WHEN max(prompt_tokens) + budget > 4200 THEN 'exceeded' ELSE 'ok' END AS status FROM {pref}, (VALUES (1024), (2048), (4096), (8192)) b(budget) GROUP BY budget"""),
    ),
    "val4_preservation_audit": (lambda s, d: P.preservation_audit(_facts(s, d).withColumn("context_status", F.when(F.col("context_status") == "exceeded", "exceeded").when(F.col("rows_failed") == 0, "ok").otherwise("unknown"))), sql(_AUDIT)),
    "val5_verdict_guard": (
        _guarded,
        sql("""
SELECT scenario_id, gpu, CASE WHEN scan OR failed OR context THEN 'unknown' ELSE status END AS status,
  CASE WHEN scan THEN 'scan_incomplete' WHEN failed THEN 'unknown_components' WHEN context THEN 'unsupported' ELSE reason END AS reason
FROM (SELECT *, scenario_id % 5 = 0 AND dep AND (pos OR status = 'exceeds') AS scan, scenario_id % 5 <> 0 AND scenario_id % 3 = 0 AND dep AND pos AS failed,
    scenario_id % 7 = 0 AND pos AS context
  FROM (SELECT *, reason NOT IN ('floor_exceeds_capacity', 'load_budget_insufficient', 'unsupported', 'not_evaluated') AS dep, status IN ('expected_fit', 'low_margin') AS pos FROM {status}) a) b"""),
    ),
    "bat1_sft_worst_batch": (
        _bat1,
        sql("""
SELECT (SELECT count(sequence_tokens) FROM {sft}) AS known_rows, count(*) AS b, count(*) AS sequences,
  CASE WHEN m > 1 THEN (max(sequence_tokens) + m - 1) // m * m ELSE max(sequence_tokens) END::BIGINT AS width,
  (count(*) * CASE WHEN m > 1 THEN (max(sequence_tokens) + m - 1) // m * m ELSE max(sequence_tokens) END)::BIGINT AS slots,
  string_agg(row_id, ',' ORDER BY sequence_tokens DESC, row_index) AS row_ids
FROM (SELECT *, row_number() OVER (ORDER BY sequence_tokens DESC, row_index) AS k FROM {sft} WHERE sequence_tokens IS NOT NULL) t, (VALUES (8, 64), (1, 1)) p(n, m)
WHERE k <= n GROUP BY n, m"""),
    ),
    "bat2_dpo_worst_batch": (
        lambda s, d: P.worst_batch(stored(preference_lengths(s, d).select("row_id", "row_index", "chosen_total_tokens", "rejected_total_tokens"), "pairs"), S.pair_max(), 4, 32, 2),
        sql("""
SELECT (SELECT count(*) FROM {pref} WHERE ok) AS known_rows, count(*) AS b, 2 * count(*) AS sequences, ((max(w) + 31) // 32 * 32)::BIGINT AS width,
  (2 * count(*) * ((max(w) + 31) // 32 * 32))::BIGINT AS slots, string_agg(row_id, ',' ORDER BY w DESC, row_index) AS row_ids
FROM (SELECT row_id, row_index, greatest(chosen_total_tokens, rejected_total_tokens) AS w FROM {pref} WHERE ok ORDER BY w DESC, row_index LIMIT 4) t"""),
    ),
    "bat3_sft_logit_positions": (
        _bat3,
        sql("""
SELECT 8::BIGINT AS b, ((max(sequence_tokens) + 63) // 64 * 64)::BIGINT AS width,
  (greatest(1, ceil((SELECT sum(loss_token_count) FROM (SELECT loss_token_count FROM {sft} WHERE text IS NOT NULL ORDER BY loss_token_count DESC, row_index LIMIT 8) l) / 256)) * 256)::BIGINT AS logits FROM {sft}"""),
    ),
    "bat4_grpo_scenarios": (
        lambda s, d: P.grpo_scenarios(_grpo(s, d), BUDGETS, 4, 64),
        sql("""
SELECT budget::BIGINT AS budget, pw::BIGINT AS prompt_width, budget::BIGINT AS completion_width, (4 * (pw + budget))::BIGINT AS slots, (4 * (budget + 1))::BIGINT AS logits, budget = 8192 AS worst, row_id
FROM (SELECT row_id, (prompt_tokens + 63) // 64 * 64 AS pw FROM {pref} WHERE prompt IS NOT NULL ORDER BY prompt_tokens DESC, row_index LIMIT 1) t, (VALUES (1024), (2048), (4096), (8192)) b(budget)"""),
    ),
    "bat5_grpo_layout": (
        lambda s, d: P.grpo_layout(_configs(s, d)),
        sql(f"""
SELECT *, CASE WHEN error IS NULL THEN gbs // g END AS unique_prompts, CASE WHEN error IS NULL THEN b * spg END AS live_sequences
FROM (SELECT *, CASE WHEN least(g, gbs, b, spg) < 1 THEN 'not_positive' WHEN g < 2 THEN 'too_few_generations' WHEN gbs % g <> 0 THEN 'not_divisible' WHEN gbs <> b * spg THEN 'batch_mismatch' END AS error FROM ({_CONFIG}) c) t"""),
    ),
    "bat6_sampler_coverage": (
        _bat6,
        sql("SELECT shard_id, 0::BIGINT AS random_dropped, n % 4 AS repeat_dropped, n % 4 = 0 AS covers_all, n % 8 AS tail FROM (SELECT shard_id, count(sequence_tokens) AS n FROM {sft} GROUP BY shard_id) t"),
    ),
    "bat7_sampler_max": (
        _bat7,
        sql("SELECT shard_id, CASE WHEN n <= 40 THEN w END AS random_max, w AS repeat_max FROM (SELECT shard_id, count(sequence_tokens) AS n, ((max(sequence_tokens) + 63) // 64 * 64)::BIGINT AS w FROM {sft} GROUP BY shard_id) t"),
    ),
    "bat8_batch_key": (
        _bat8,
        sql("SELECT shard_id, 'bat_' || sha256('pre_' || sha256(shard_id) || chr(31) || CAST(count(sequence_tokens) AS VARCHAR) || chr(31) || 'random' || chr(31) || '64') AS batch_key FROM {sft} GROUP BY shard_id"),
    ),
    "cap1_planning_margin": (lambda s, d: _margins(s, d).select("scenario_id", "high", "margin"), sql("SELECT scenario_id, high, margin::BIGINT AS margin FROM {margins}")),
    "cap2_fit_verdict": (lambda s, d: _fits(s, d).select("scenario_id", "gpu", "status", "reason"), sql("SELECT scenario_id, gpu, status, reason FROM {status}")),
    "cap3_worst_fit": (
        lambda s, d: P.worst_fit(_fits(s, d), "gpu", F.col("scenario_id") == 7),
        sql("SELECT gpu, coalesce(max(status) FILTER (scenario_id = 7), arg_max(status, CASE status WHEN 'exceeds' THEN 4 WHEN 'unknown' THEN 3 WHEN 'low_margin' THEN 2 WHEN 'not_evaluated' THEN 1 ELSE 0 END)) AS status FROM {status} GROUP BY gpu"),
    ),
    "cap4_budget_range": (
        lambda s, d: P.budget_range(_peaks(s, d).withColumn("owner", F.floor(F.col("scenario_id") / 10).cast("long")), "owner"),
        sql("SELECT scenario_id // 10 AS owner, CASE WHEN bool_and(high IS NOT NULL) THEN min(low) END AS low, CASE WHEN bool_and(high IS NOT NULL) THEN max(high) END AS high FROM {peaks} GROUP BY 1"),
    ),
    "led1_expand_liveness": (lambda s, d: _live(s, d).select("scenario_id", "name", "tp"), sql("SELECT scenario_id, name, tp FROM {live}")),
    "led2_collapse_aliases": (lambda s, d: _items(s, d).select("scenario_id", "tp", "item", "low", "high"), sql("SELECT scenario_id, tp, item, low, high FROM {items}")),
    "led3_timepoint_totals": (_totals, sql("SELECT * FROM {totals}")),
    "led4_peak_timepoint": (_peaks, sql("SELECT * FROM {peaks}")),
    "led5_phase_peaks": (
        lambda s, d: G.phase_peaks(_totals(s, d), view(s, d, "v_timepoints")),
        sql("""
SELECT e.scenario_id, e.phase, e.phase_order, p.tp IS NOT NULL AS included, p.tp, p.low, p.high
FROM (SELECT scenario_id, phase, phase_order FROM (SELECT DISTINCT scenario_id FROM {totals}) s, (SELECT phase, min(ord) AS phase_order FROM {v_timepoints} GROUP BY phase) o) e
LEFT JOIN {phases} p ON e.scenario_id = p.scenario_id AND e.phase = p.phase"""),
    ),
    "led6_peak_breakdown": (
        lambda s, d: G.peak_breakdown(_items(s, d), _totals(s, d)),
        sql("""
SELECT i.scenario_id, category, count(*) AS items, CAST(CASE WHEN count(*) FILTER (i.low IS NULL) = 0 THEN sum(i.low) END AS BIGINT) AS low,
  CAST(CASE WHEN count(*) FILTER (i.high IS NULL) = 0 THEN sum(i.high) END AS BIGINT) AS high
FROM {items} i JOIN {peaks} p ON i.scenario_id = p.scenario_id AND i.tp = p.tp GROUP BY i.scenario_id, category"""),
    ),
    "win7_scenario_delta": (
        _win7,
        sql("SELECT scenario_id, scenario_id // 50 AS owner, high, high - first_value(high) OVER (PARTITION BY scenario_id // 50 ORDER BY scenario_id) AS delta FROM {peaks}"),
    ),
}
