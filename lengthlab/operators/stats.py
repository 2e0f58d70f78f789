"""Exact length statistics over the length table, all from one mergeable state: counts per (branch, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The branches of each objective; the first is the primary one.
BRANCHES = {
    "sft": ("sequence", "prompt", "completion", "loss"),
    "dpo": ("pair_max", "prompt", "chosen_total", "rejected_total", "chosen_completion", "rejected_completion"),
    "grpo": ("prompt",),
}
COLUMNS = {
    "sequence": "sequence_tokens", "prompt": "prompt_tokens", "completion": "completion_tokens", "loss": "loss_token_count",
    "chosen_total": "chosen_total_tokens", "rejected_total": "rejected_total_tokens",
    "chosen_completion": "chosen_completion_tokens", "rejected_completion": "rejected_completion_tokens",
}
QUANTILES = (50, 90, 95, 99)
TOP_ROWS = 10
BINS = 32


def pair_max() -> Column:
    """The longer branch; null only if both are."""
    return F.greatest("chosen_total_tokens", "rejected_total_tokens")


def branch_rows(lengths: DataFrame, objective: str) -> DataFrame:
    """(row_id, row_index, branch, length): one row per known value, by one unpivot."""
    wide = lengths.select(
        "row_id", "row_index", *[(pair_max() if b == "pair_max" else F.col(COLUMNS[b])).alias(b) for b in BRANCHES[objective]]
    )
    return wide.unpivot(["row_id", "row_index"], list(BRANCHES[objective]), "branch", "length").where("length is not null")


def branch_dimension(spark, objective: str) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(BRANCHES[objective])], "branch string, branch_order int")


def length_counts(branches: DataFrame) -> DataFrame:
    return branches.groupBy("branch", "length").agg(F.count("*").alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("branch", "length").agg(F.sum("n").alias("n"))


def length_stats(branches: DataFrame, objective: str) -> DataFrame:
    """count, min, max, total, mean per branch; the primary branch is there even without rows."""
    found = branches.groupBy("branch").agg(
        F.count("*").alias("rows"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.sum("length").alias("total"),
        (F.sum("length") / F.count("*")).alias("mean_length"),
    )
    named = branch_dimension(branches.sparkSession, objective)
    out = named.join(found, "branch", "left")
    return out.where("branch_order = 0 or rows is not null").select(
        "branch", F.coalesce("rows", F.lit(0)).alias("rows"), "min_length", "max_length", "total", "mean_length"
    )


def running_counts(counts: DataFrame) -> DataFrame:
    """Adds at_or_below and total per branch. The window runs over distinct lengths, not over rows."""
    order = Window.partitionBy("branch").orderBy("length")
    return counts.withColumn("at_or_below", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy("branch"))
    )


def quantiles(counts: DataFrame, percents: tuple[int, ...] = QUANTILES) -> DataFrame:
    """Nearest-rank quantiles: the observed length at rank max(1, (p * n + 99) div 100)."""
    running = running_counts(counts)
    at = lambda p: F.min(F.when(F.col("at_or_below") >= F.greatest(F.lit(1), F.expr(f"({p} * total + 99) div 100")), F.col("length")))
    return running.groupBy("branch").agg(F.max("total").alias("rows"), *[at(p).alias(f"p{p}") for p in percents])


def histogram(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """(branch, lo, hi, n): power-of-two wide bins, empty ones too; the first lo is never below 0."""
    # The sum keeps both uses of `counts` alike, so that Spark computes and shuffles them once.
    span = counts.groupBy("branch").agg(F.min("length").alias("low"), F.max("length").alias("high"), F.sum("n").alias("rows")).where("rows > 0")
    need = F.expr(f"(high - low + 1 + {bins - 1}) div {bins}")
    span = span.withColumn("need", need)
    span = span.withColumn("width", F.expr("shiftleft(1L, cast(ceil(log2(need)) as int))"))
    index = lambda c: F.floor((c - 1) / F.col("width"))
    every = span.select("branch", "width", F.explode(F.sequence(index(F.col("low")), index(F.col("high")))).alias("bin"))
    sums = counts.join(span, "branch").groupBy("branch", index(F.col("length")).alias("bin")).agg(F.sum("n").alias("n"))
    out = every.join(sums, ["branch", "bin"], "left")
    return out.select(
        "branch",
        F.when(F.col("bin") < 0, 0).otherwise(F.col("bin") * F.col("width") + 1).cast("long").alias("lo"),
        ((F.col("bin") + 1) * F.col("width")).cast("long").alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def longest_row(branches: DataFrame) -> DataFrame:
    """The row id of each branch's maximum, the first row on ties."""
    return branches.groupBy("branch").agg(
        F.max_by("row_id", F.struct("length", -F.col("row_index"))).alias("row_id"), F.max("length").alias("length")
    )


def count_above(branches: DataFrame, threshold: int) -> DataFrame:
    return branches.groupBy("branch").agg(F.count_if(F.col("length") > threshold).alias("rows_above"), F.count("*").alias("rows"))


def top_rows(branches: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    order = Window.partitionBy("branch").orderBy(F.desc("length"), "row_index")
    return branches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def k_longest(lengths: DataFrame, value: Column | str, k: int) -> DataFrame:
    """The k longest known rows, ties to the lower index (a distributed top-k)."""
    value = F.col(value) if isinstance(value, str) else value
    rows = lengths.select("row_id", "row_index", value.alias("length")).where("length is not null")
    return rows.orderBy(F.desc("length"), "row_index").limit(k)


def duplicate_rows(lengths: DataFrame) -> DataFrame:
    known = lengths.where("processing_status = 'ok' and content_digest is not null and content_digest <> ''")
    return known.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("content_digest")).alias("duplicates"))


def scan_counters(lengths: DataFrame, expected: int | None = None, limit: int | None = None) -> DataFrame:
    """seen, ok, failed, unprocessed (null without an expectation), exceeded (null without a limit)."""
    unknown = F.lit(None).cast("long")
    return lengths.agg(
        F.count("*").alias("rows_seen"),
        F.count_if(F.col("processing_status") == "ok").alias("rows_ok"),
        F.count_if(F.col("processing_status") == "failed").alias("rows_failed"),
        (unknown if expected is None else F.greatest(F.lit(0).cast("long"), F.lit(expected) - F.count("*"))).alias("rows_unprocessed"),
        (unknown if limit is None else F.count_if(F.col("context_status") == "exceeded")).alias("rows_exceeded"),
    )


def coverage(counters: DataFrame, at_end: bool = True) -> DataFrame:
    """failed (nothing seen), complete (end reached, nothing missing, no failed row) or partial."""
    all_seen = F.lit(at_end) & (F.coalesce("rows_unprocessed", F.lit(0)) == 0)
    return counters.select(
        "*",
        all_seen.alias("all_rows_seen"),
        ((F.col("rows_seen") == 0) & F.lit(at_end)).alias("empty"),
        F.when(F.col("rows_seen") == 0, "failed")
        .when(all_seen & (F.col("rows_failed") == 0), "complete")
        .otherwise("partial")
        .alias("coverage"),
    )


def shard_progress(lengths: DataFrame, layout: DataFrame) -> DataFrame:
    """(shard_id, expected, seen, done) for every shard of the layout (shard_id, expected)."""
    seen = lengths.groupBy("shard_id").agg(F.count("*").alias("seen"))
    out = layout.join(seen, "shard_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return out.select("shard_id", "expected", "seen", (F.col("seen") >= F.col("expected")).alias("done"))


def finding_counts(flags: DataFrame, names: list[str], first: int = 20) -> DataFrame:
    """(finding, n, row_ids): how often each flag is set and the first rows with it."""
    long = flags.unpivot(["row_id", "row_index"], names, "finding", "found").where("found")
    place = Window.partitionBy("finding").orderBy("row_index")
    counts = long.groupBy("finding").agg(F.count("*").alias("n"))
    some = long.withColumn("place", F.row_number().over(place)).where(F.col("place") <= first)
    some = some.groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("row_index", "row_id"))).alias("rows"))
    return counts.join(some, "finding").select(
        "finding", "n", F.array_join(F.transform("rows", lambda r: r["row_id"]), ",").alias("row_ids")
    )


def token_set(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Sorted distinct tokens over all rows; cut only after the merge."""
    each = rows.select(F.explode(column).alias("token")).distinct().orderBy("token").limit(most)
    return each.agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("tokens"))


def failed_sample(lengths: DataFrame, most: int = 100) -> DataFrame:
    return (
        lengths.where("processing_status = 'failed'")
        .select("row_index", "row_id", "shard_id", "error_code")
        .orderBy("row_index")
        .limit(most)
    )


def fingerprint(lengths: DataFrame, columns: list[str]) -> DataFrame:
    """A content key that needs no order: 60 bits of each row's digest xored and summed, with the count.

    A null counts as a mark of its own, so rows that differ only in where a value is missing differ.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return lengths.agg(F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("rows")).select(
        F.sha2(F.concat_ws(":", F.col("x").cast("string"), F.col("s").cast("string"), F.col("rows").cast("string")), 256).alias("artifact_key"),
        "rows",
    )
