"""Context limits, worst-case batches, margins and capacity verdicts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.functions.units import round_up
from lengthlab.operators.stats import k_longest

#: A tokenizer's declared limit from here on stands for "none".
NO_LIMIT = 1e20
CHUNK = 256
# Hardware presets and their nominal GiB.
GPU_PRESETS = {
    "rtx-3060-12gb": 12, "rtx-3090-24gb": 24, "rtx-4060-ti-16gb": 16, "rtx-4080-16gb": 16, "rtx-4090-24gb": 24, "rtx-5090-32gb": 32,
    "a10-24gb": 24, "a10g-24gb": 24, "l4-24gb": 24, "rtx-a6000-48gb": 48, "rtx-6000-ada-48gb": 48, "l40s-48gb": 48, "a100-40gb": 40,
    "a100-80gb": 80, "h100-80gb": 80,
}
# The checks of the preservation audit, in order.
CHECKS = (
    "full_read", "no_length_drop", "no_split_or_concat", "template_content_preserved", "last_batch_included", "context_within_limit",
    "eval_scope_consistent", "packing_safe",
)
# Outcomes by severity.
SEVERITY = {"na": 0, "pass": 0, "pending": 1, "unknown": 2, "violated": 3}
OVERALL = {0: "verified", 1: "pending", 2: "unknown", 3: "violated"}
FIT_SEVERITY = {"expected_fit": 0, "not_evaluated": 1, "low_margin": 2, "unknown": 3, "exceeds": 4}
# Verdict reasons that do not depend on row lengths.
LENGTH_FREE = ("floor_exceeds_capacity", "load_budget_insufficient", "unsupported", "not_evaluated")


def effective_limit(model: Column, backend: Column, tokenizer: Column) -> Column:
    """(limit, source): the smaller of model and backend; the tokenizer's only where neither is known and it is no sentinel."""
    m, b = model.cast("decimal(38,0)"), backend.cast("decimal(38,0)")
    least = F.least(m, b)
    fallback = F.when(tokenizer < NO_LIMIT, tokenizer.cast("decimal(38,0)"))
    source = F.when(least.isNotNull() & (m <= F.coalesce(b, m)), "model").when(least.isNotNull(), "backend").when(fallback.isNotNull(), "tokenizer")
    return F.struct(F.coalesce(least, fallback).cast("long").alias("limit"), source.alias("source"))


def context_validation(lengths: DataFrame, value: Column, limit: int | None, extra: int = 0, complete: bool = True) -> DataFrame:
    """One row: longest input, rows over the limit (null without a limit, never 0), whether that is exact, and the status."""
    bound = F.lit(limit).cast("long")
    found = lengths.agg(
        (F.max(value) + extra).alias("max_observed"),
        F.count_if(value > F.lit(None if limit is None else limit - extra).cast("long")).alias("over"),
        F.count_if(F.col("processing_status") == "failed").alias("rows_failed"),
    )
    known = F.lit(complete) & (F.col("rows_failed") == 0)
    status = F.when(bound.isNull() | F.col("max_observed").isNull(), "unknown").when(F.col("max_observed") > bound, "exceeded")
    return found.select(
        bound.alias("effective_limit"),
        "max_observed",
        F.when(bound.isNotNull() & F.col("max_observed").isNotNull(), F.col("over")).alias("exceeded_rows"),
        (known & bound.isNotNull()).alias("exceeded_rows_exact"),
        status.when(known, "ok").otherwise("unknown").alias("status"),
    )


def context_per_budget(lengths: DataFrame, value: Column, limit: int, budgets: list[int]) -> DataFrame:
    """The validation for each completion budget, in one pass over the lengths."""
    table = lengths.sparkSession.createDataFrame([(b,) for b in sorted(set(budgets))], "budget long")
    values = lengths.select(value.alias("v"), (F.col("processing_status") == "failed").alias("failed")).groupBy("v", "failed").agg(F.count("*").alias("n"))
    rows = values.crossJoin(F.broadcast(table))  # a handful of budgets
    found = rows.groupBy("budget").agg(
        (F.max("v") + F.col("budget")).alias("max_observed"),
        F.coalesce(F.sum(F.when(F.col("v") > limit - F.col("budget"), F.col("n"))), F.lit(0)).alias("exceeded_rows"),
        F.coalesce(F.sum(F.when(F.col("failed"), F.col("n"))), F.lit(0)).alias("rows_failed"),
    )
    status = F.when(F.col("max_observed").isNull(), "unknown").when(F.col("max_observed") > limit, "exceeded").when(F.col("rows_failed") == 0, "ok")
    return found.select("budget", "max_observed", "exceeded_rows", status.otherwise("unknown").alias("status"))


def preservation_audit(facts: DataFrame) -> DataFrame:
    """(dataset, check, outcome, overall) from one fact row per dataset.

    facts: dataset, rows_seen, rows_ok, rows_failed, complete, packing, loss_rows, dropped_rows (null before a
    plan), context_status, include_eval.
    """
    packing = F.when(F.col("packing"), "violated").otherwise("pass")
    context = F.when(F.col("context_status") == "ok", "pass").when(F.col("context_status") == "exceeded", "violated").otherwise("unknown")
    outcome = {
        "full_read": F.when(F.col("complete") & (F.col("rows_failed") == 0) & (F.col("rows_seen") > 0), "pass").otherwise("unknown"),
        "no_length_drop": packing,
        "no_split_or_concat": packing,
        "template_content_preserved": F.when(F.col("loss_rows") > 0, "violated").when(F.col("rows_ok") == 0, "unknown").otherwise("pass"),
        "last_batch_included": F.when(F.col("dropped_rows").isNull(), "pending").when(F.col("dropped_rows") > 0, "violated").otherwise("pass"),
        "context_within_limit": context,
        "eval_scope_consistent": F.when(F.col("include_eval"), "pending").otherwise("na"),
        "packing_safe": F.when(F.col("packing"), "violated").otherwise("na"),
    }
    wide = facts.select("dataset", *[outcome[c].alias(c) for c in CHECKS])
    long = wide.unpivot(["dataset"], list(CHECKS), "check", "outcome")
    level = F.coalesce(*[F.when(F.col("outcome") == o, F.lit(s)) for o, s in SEVERITY.items()])
    worst = F.max(level).over(Window.partitionBy("dataset"))
    overall = F.coalesce(*[F.when(worst == s, F.lit(name)) for s, name in OVERALL.items()])
    return long.select("dataset", "check", "outcome", overall.alias("overall"))


def guard_verdicts(fits: DataFrame, incomplete: Column, failed_rows: Column, context_exceeded: Column) -> DataFrame:
    """Verdicts that rest on unverified lengths become unknown, those that do not stay.

    An incomplete scan withholds every length-dependent verdict; failed rows withhold the positive ones; a
    budget over the context limit withholds its positive verdicts.
    """
    depends = ~F.col("reason").isin(*LENGTH_FREE)
    positive = F.col("status").isin("expected_fit", "low_margin")
    scan = incomplete & depends & F.col("status").isin("expected_fit", "low_margin", "exceeds")
    failed = ~incomplete & (failed_rows > 0) & depends & positive
    context = context_exceeded & positive
    reason = F.when(scan, "scan_incomplete").when(failed, "unknown_components").when(context, "unsupported").otherwise(F.col("reason"))
    status = F.when(scan | failed | context, "unknown").otherwise(F.col("status"))
    return fits.withColumns({"reason": reason, "status": status})


def worst_batch(lengths: DataFrame, value: Column, microbatch: int, multiple: int | None, per_row: int = 1) -> DataFrame:
    """The microbatch's longest rows together: rows, padded width, sequences, token slots and the rows' ids.

    Only the distributed top-k and a count leave the length table. per_row: sequences of one row (2 for pairs).
    """
    known = lengths.agg(F.count(value).alias("known_rows"))
    top = k_longest(lengths, value, microbatch)
    shape = top.agg(
        F.count("*").alias("b"),
        F.max("length").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("l"), "row_index", "row_id"))), lambda r: r["row_id"]), ",").alias("row_ids"),
    )
    out = shape.crossJoin(known).where("b > 0").withColumn("width", round_up(F.col("longest"), multiple))
    sequences = F.col("b") * per_row
    return out.select("known_rows", "b", sequences.alias("sequences"), "width", (sequences * F.col("width")).alias("slots"), "row_ids")


def chunked_logits(lengths: DataFrame, batch: DataFrame, microbatch: int) -> DataFrame:
    """Logit positions of the chunked loss: the b largest loss counts, in chunks of CHUNK; b * (width - 1) if fewer are known."""
    loss = k_longest(lengths, "loss_token_count", microbatch).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("loss"), F.count("*").alias("n"))
    valid = F.when(F.col("n") == F.col("b"), F.col("loss")).otherwise(F.col("b") * F.greatest(F.lit(0), F.col("width") - 1))
    chunks = F.greatest(F.lit(1), F.ceil(valid / CHUNK))
    return batch.crossJoin(loss).withColumn("logits", chunks * CHUNK).drop("loss", "n")


def grpo_scenarios(lengths: DataFrame, budgets: list[int], microbatch: int, multiple: int | None) -> DataFrame:
    """One row per completion budget: padded widths, slots and logit positions; the largest budget is the worst."""
    table = lengths.sparkSession.createDataFrame([(b,) for b in sorted(set(budgets))], "budget long")
    top = k_longest(lengths, "prompt_tokens", 1).select("row_id", round_up(F.col("length"), multiple).alias("prompt_width"))
    rows = top.crossJoin(F.broadcast(table)).withColumn("completion_width", round_up(F.col("budget"), multiple))
    width = F.col("prompt_width") + F.col("completion_width")
    worst = F.col("budget") == F.max("budget").over(Window.partitionBy("row_id"))
    return rows.select(
        "budget", "prompt_width", "completion_width", (width * microbatch).alias("slots"), ((F.col("completion_width") + 1) * microbatch).alias("logits"),
        worst.alias("worst"), "row_id",
    )


def grpo_layout(configs: DataFrame) -> DataFrame:
    """unique_prompts, live_sequences and the broken constraint of each configuration (g, gbs, b, spg)."""
    error = (
        F.when(F.least("g", "gbs", "b", "spg") < 1, "not_positive")
        .when(F.col("g") < 2, "too_few_generations")
        .when(F.col("gbs") % F.col("g") != 0, "not_divisible")
        .when(F.col("gbs") != F.col("b") * F.col("spg"), "batch_mismatch")
    )
    rows = configs.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.withColumns({"unique_prompts": F.when(ok, F.expr("try_divide(gbs - pmod(gbs, nullif(g, 0)), g)").cast("long")), "live_sequences": F.when(ok, F.col("b") * F.col("spg"))})


def sampler_coverage(rows: Column, unit: Column | None, batch: Column) -> dict[str, Column]:
    """dropped (rows mod the unit of the repeat sampler, 0 for the random one), covers_all and the last batch's rows."""
    dropped = F.lit(0).cast("long") if unit is None else rows % unit
    return {"dropped": dropped, "covers_all": dropped == 0, "tail": rows % batch}


def sampler_max(worst: Column, rows: Column, batch: Column, unit: Column | None = None) -> Column:
    """The worst shape where order cannot matter, else null."""
    fixed = (batch == 1) | (rows <= batch) if unit is None else (unit == 1) | (rows == unit)
    return F.when(fixed, worst)


def planning_margin(high: Column, least: int, fraction: str = "0.15") -> Column:
    """max(least, ceil(high * fraction)) in exact decimals; null where high is."""
    part = F.ceil(high.cast("decimal(20,0)") * F.lit(Decimal(fraction))).cast("long")
    return F.when(high.isNotNull(), F.greatest(F.lit(least).cast("long"), part))


def assess_fit(scenarios: DataFrame, gpus: DataFrame) -> DataFrame:
    """Scenario x hardware verdicts by the ordered ladder.

    scenarios: scenario_id, high, margin, floor, load_bytes, readiness, evidence; gpus: gpu, capacity. The
    hardware table is a short fixed list.
    """
    rows = scenarios.crossJoin(F.broadcast(gpus))
    c = F.col("capacity")
    ladder = (
        (c.isNull(), "not_evaluated", "not_evaluated"),
        (F.col("readiness") == "unsupported", "unknown", "unsupported"),
        (F.col("floor") > c, "exceeds", "floor_exceeds_capacity"),
        (F.col("load_bytes") > c, "exceeds", "load_budget_insufficient"),
        (F.col("evidence") == "metadata_only", "unknown", "unsupported"),
        (F.col("high").isNull() | F.col("margin").isNull(), "unknown", "unknown_components"),
        (F.col("high") > c, "exceeds", "high_exceeds_capacity"),
        (F.col("high") + F.col("margin") > c, "low_margin", "margin_insufficient"),
    )
    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, s, r in ladder:
        status, reason = status.when(test, s), reason.when(test, r)
    return rows.withColumns({"status": status.otherwise("expected_fit"), "reason": reason.otherwise("fits_with_margin")})


def preset_capacities(spark, chosen: list[str] | None = None) -> DataFrame:
    """(gpu, capacity in bytes) of the chosen presets; an id without a preset has no capacity."""
    rows = [(g, GPU_PRESETS[g] << 30 if g in GPU_PRESETS else None) for g in (chosen or GPU_PRESETS)]
    return spark.createDataFrame(rows, "gpu string, capacity long")


def worst_fit(fits: DataFrame, by: str, primary: Column) -> DataFrame:
    """The primary scenario's verdict where there is one, else the most severe."""
    level = F.coalesce(*[F.when(F.col("status") == s, F.lit(n)) for s, n in FIT_SEVERITY.items()])
    return fits.groupBy(by).agg(F.max_by("status", F.struct(primary.cast("int"), level, -F.col("scenario_id"))).alias("status"))


def budget_range(peaks: DataFrame, by: str) -> DataFrame:
    """The least low and the greatest high of a group, null unless every high is known."""
    known = F.every(F.col("high").isNotNull())
    return peaks.groupBy(by).agg(F.when(known, F.min("low")).alias("low"), F.when(known, F.max("high")).alias("high"))
