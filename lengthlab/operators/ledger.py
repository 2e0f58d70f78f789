"""Allocation ledgers: what is alive when, totals that stay unknown when a part is, and peaks.

All operators work on many scenarios at once. A null size is unknown: a group or a total with an unknown
part is null, and only the known part (the floor) is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories that stay in memory throughout.
RESIDENT = ("weights_base", "weights_adapter", "weights_other_models", "gradients", "optimizer_states", "master_weights")


def null_if_unknown(total: Column, part: str) -> Column:
    """An aggregate that is null when any of its parts is."""
    return F.when(F.count_if(F.col(part).isNull()) == 0, total)


def expand_liveness(allocations: DataFrame, timepoints: DataFrame) -> DataFrame:
    """Allocation x time point rows; live_at is a time point or "<phase>:*". Two equi joins, no nested loop."""
    wild = F.endswith("live_at", F.lit(":*"))
    points = F.broadcast(timepoints)  # a few rows by definition of the schedule
    exact = allocations.where(~wild).join(points, F.col("live_at") == F.col("tp"))
    phase = F.regexp_extract("live_at", r"^(.*):\*$", 1)
    whole = allocations.where(wild).withColumn("phase_of", phase).join(points, F.col("phase_of") == F.col("phase")).drop("phase_of")
    return exact.unionByName(whole)


def collapse_aliases(live: DataFrame) -> DataFrame:
    """Allocations that share storage count once per time point: the largest; unknown if any member is."""
    key = ["scenario_id", "ord", "phase", "tp", F.coalesce("alias_group", "name").alias("item")]
    return live.groupBy(*key).agg(
        F.min("category").alias("category"),
        null_if_unknown(F.max("bytes_low"), "bytes_low").alias("low"),
        null_if_unknown(F.max("bytes_high"), "bytes_high").alias("high"),
    )


def timepoint_totals(items: DataFrame) -> DataFrame:
    """Totals per time point, the floor of known resident items, what is known, and the unknown items."""
    resident = F.col("category").isin(*RESIDENT)
    return items.groupBy("scenario_id", "ord", "phase", "tp").agg(
        null_if_unknown(F.sum("low"), "low").alias("low"),
        null_if_unknown(F.sum("high"), "high").alias("high"),
        F.coalesce(F.sum(F.when(resident, F.col("low"))), F.lit(0)).alias("floor"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("known_high"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("high").isNull(), F.col("item")))), ",").alias("unknown"),
    )


def _peak_order() -> Column:
    return F.struct(F.col("high").isNull(), F.col("known_high"), -F.col("ord"))


def peak_timepoint(totals: DataFrame, by: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """The largest known total, the earliest on ties; if any point is unknown, the unknown one with the largest known part."""
    best = F.max_by(F.struct("tp", "ord", "low", "high", "floor", "known_high"), _peak_order())
    return totals.groupBy(*by).agg(best.alias("peak")).select(*by, "peak.tp", "peak.low", "peak.high", "peak.floor", "peak.known_high")


def phase_peaks(totals: DataFrame, timepoints: DataFrame) -> DataFrame:
    """The peak of every phase of the schedule; phases without allocations are there as not included."""
    peaks = peak_timepoint(totals, ("scenario_id", "phase"))
    phases = timepoints.groupBy("phase").agg(F.min("ord").alias("phase_order"))
    every = totals.select("scenario_id").distinct().crossJoin(F.broadcast(phases))
    out = every.join(peaks, ["scenario_id", "phase"], "left")
    return out.select("scenario_id", "phase", "phase_order", F.col("tp").isNotNull().alias("included"), "tp", "low", "high")


def peak_breakdown(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(scenario_id, category, items, low, high) at the peak; the sums equal the peak's totals."""
    peak = peak_timepoint(totals).select("scenario_id", "tp")
    return items.join(peak, ["scenario_id", "tp"]).groupBy("scenario_id", "category").agg(
        F.count("*").alias("items"), null_if_unknown(F.sum("low"), "low").alias("low"), null_if_unknown(F.sum("high"), "high").alias("high")
    )


def scenario_delta(peaks: DataFrame, by: str, order: str) -> DataFrame:
    """Each scenario's high less that of the first of its group; null if either is unknown."""
    first = F.first("high").over(Window.partitionBy(by).orderBy(order))
    return peaks.withColumn("delta", F.col("high") - first)
