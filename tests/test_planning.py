"""Hand-computed batch shapes, ledger rules and verdicts."""

from pyspark.sql import functions as F

from lengthlab.operators import ledger as G
from lengthlab.operators import planning as P
from lengthlab.operators import stats as S

GIB = 1 << 30


def lengths(spark, rows, columns):
    names = [c.split()[0] for c in columns.split(",")]
    df = spark.createDataFrame([(f"train:{i}", i, *r) for i, r in enumerate(rows)], f"row_id string, row_index long, {columns}")
    for c in ("sequence_tokens", "loss_token_count", "chosen_total_tokens", "rejected_total_tokens", "prompt_tokens"):
        if c not in names:
            df = df.withColumn(c, F.lit(None).cast("long"))
    return df


def test_sft_shapes(spark):
    rows = lengths(spark, [(100,), (300,)], "sequence_tokens long")
    plain = P.worst_batch(rows, F.col("sequence_tokens"), 2, None).first()
    assert (plain.width, plain.slots, plain.row_ids) == (300, 600, "train:1,train:0")
    padded = P.worst_batch(rows, F.col("sequence_tokens"), 2, 64).first()
    assert (padded.width, padded.slots) == (320, 640)


def test_dpo_shape(spark):
    rows = lengths(spark, [(100, 700), (150, 200)], "chosen_total_tokens long, rejected_total_tokens long")
    out = P.worst_batch(rows, S.pair_max(), 2, None, 2).first()
    assert (out.sequences, out.width, out.slots) == (4, 700, 2800)


def test_chunked_logits(spark):
    rows = lengths(spark, [(60, 100), (200, 210), (49, 80)], "loss_token_count long, sequence_tokens long")
    batch = P.worst_batch(rows, F.col("sequence_tokens"), 2, None)
    assert P.chunked_logits(rows, batch, 2).first().logits == 512


def test_margin_is_exact_and_null_when_unknown(spark):
    df = spark.createDataFrame([(10,), (100 * GIB + 1,), (None,)], "high long")
    out = [r.m for r in df.select(P.planning_margin(F.col("high"), 2 * GIB).alias("m")).collect()]
    assert out == [2 * GIB, -(-(100 * GIB + 1) * 15 // 100), None]


TIMES = [(0, "LOAD", "LOAD:peak"), (1, "FB", "FB:forward"), (2, "OPT", "OPT:step")]


def totals(spark, rows):
    allocations = spark.createDataFrame(rows, "scenario_id long, name string, category string, live_at string, alias_group string, bytes_low long, bytes_high long")
    times = spark.createDataFrame(TIMES, "ord int, phase string, tp string")
    items = G.collapse_aliases(G.expand_liveness(allocations, times))
    return items, G.timepoint_totals(items), times


def test_phases_take_the_maximum_not_the_sum(spark):
    _, sums, times = totals(spark, [(1, "a", "x", "LOAD:*", None, 10, 10), (1, "b", "x", "FB:forward", None, 12, 12)])
    assert G.peak_timepoint(sums).first().high == 12
    phases = {r.phase: r for r in G.phase_peaks(sums, times).collect()}
    assert (phases["LOAD"].high, phases["FB"].high, phases["OPT"].included) == (10, 12, False)


def test_unknown_is_null_and_the_floor_stays(spark):
    items, sums, _ = totals(
        spark,
        [(1, "w", "weights_base", "LOAD:*", None, 7, 8), (1, "u", "x", "LOAD:*", None, None, None), (1, "z", "x", "FB:*", None, 99, 99)],
    )
    peak = G.peak_timepoint(sums).first()
    assert (peak.tp, peak.high, peak.floor, peak.known_high) == ("LOAD:peak", None, 7, 8)
    shares = {r.category: (r.low, r.high) for r in G.peak_breakdown(items, sums).collect()}
    assert shares == {"weights_base": (7, 8), "x": (None, None)}


def test_aliases_count_once(spark):
    _, sums, _ = totals(spark, [(1, "a", "x", "FB:*", "t", 5, 6), (1, "b", "x", "FB:*", "t", 9, 9)])
    assert sums.first().high == 9


def test_fit_ladder(spark):
    rows = [(1, 50, 10, 5, 0), (2, 75, 10, 5, 0), (3, 90, 10, 5, 0), (4, None, None, 5, 0), (5, None, None, 95, 0), (6, 1, 1, 1, 99)]
    df = spark.createDataFrame(rows, "scenario_id long, high long, margin long, floor long, load_bytes long")
    df = df.withColumns({"readiness": F.lit("ready"), "evidence": F.lit("analytic")})
    fits = P.assess_fit(df, spark.createDataFrame([("g", 80), ("none", None)], "gpu string, capacity long"))
    out = {r.scenario_id: (r.status, r.reason) for r in fits.where("gpu = 'g'").collect()}
    assert out == {
        1: ("expected_fit", "fits_with_margin"),
        2: ("low_margin", "margin_insufficient"),
        3: ("exceeds", "high_exceeds_capacity"),
        4: ("unknown", "unknown_components"),
        5: ("exceeds", "floor_exceeds_capacity"),
        6: ("exceeds", "load_budget_insufficient"),
    }
    assert {r.status for r in fits.where("gpu = 'none'").collect()} == {"not_evaluated"}
    guarded = P.guard_verdicts(fits.where("gpu = 'g'"), F.lit(True), F.lit(0), F.lit(False))
    kept = {r.scenario_id: r.status for r in guarded.collect()}
    assert kept == {1: "unknown", 2: "unknown", 3: "unknown", 4: "unknown", 5: "exceeds", 6: "exceeds"}


def test_context_without_a_limit_is_unknown(spark):
    rows = lengths(spark, [(10,), (20,)], "sequence_tokens long").withColumn("processing_status", F.lit("ok"))
    none = P.context_validation(rows, F.col("sequence_tokens"), None).first()
    assert (none.exceeded_rows, none.status) == (None, "unknown")
    over = P.context_validation(rows, F.col("sequence_tokens"), 15).first()
    assert (over.exceeded_rows, over.status, over.exceeded_rows_exact) == (1, "exceeded", True)
    assert P.context_validation(rows, F.col("sequence_tokens"), 50).first().status == "ok"
    assert P.context_validation(rows, F.col("sequence_tokens"), 50, complete=False).first().status == "unknown"


def test_presets(spark):
    found = {r.gpu: r.capacity for r in P.preset_capacities(spark, ["a100-80gb", "none"]).collect()}
    assert found == {"a100-80gb": 80 * GIB, "none": None}
    assert P.preset_capacities(spark).count() == 15
