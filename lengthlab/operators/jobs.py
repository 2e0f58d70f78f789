"""Job, event, upload and cache tables as queries. "Now" is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a job.
ACTIVE = ("QUEUED", "TOKENIZING", "ESTIMATING")
TERMINAL = ("COMPLETED", "FAILED")
# Which configuration fields invalidate lengths; all others only the estimate.
LENGTH_FIELDS = ("objective", "model", "revision", "dataset", "split", "scan_mode", "mapping", "template", "packing", "data_policy")


def events_after(events: DataFrame, cursor: int, page: int = 200) -> DataFrame:
    return events.where(F.col("event_id") > cursor).orderBy("event_id").limit(page)


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("analysis_id").agg(F.max("event_id").alias("last_event_id"))


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("analysis_id").agg(F.max_by("status", "event_id").alias("status"))


def stalled(jobs: DataFrame, now: Column, lease: str = "1 hour", idle: str = "2 days", grace: str = "1 day") -> DataFrame:
    """Active jobs with a reason: an expired lease, a queue without progress, a cancel request that was not followed."""
    before = lambda span: now - F.expr(f"interval {span}")
    active = F.col("status").isin(*ACTIVE)
    reason = (
        F.when(active & F.col("lease_owner").isNotNull() & (F.col("lease_expires_at") < now), "lease_expired")
        .when((F.col("status") == "QUEUED") & F.col("lease_owner").isNull() & (F.col("updated_at") < before(idle)), "queued_too_long")
        .when(active & (F.col("cancel_requested_at") < before(grace)), "cancel_not_followed")
    )
    return jobs.withColumn("reason", reason).where("reason is not null")


def expired_jobs(jobs: DataFrame, cutoff: Column) -> DataFrame:
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.coalesce("finished_at", "created_at") < cutoff))


def uploads_to_delete(uploads: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Expired uploads that no active analysis uses."""
    used = jobs.where(F.col("status").isin(*ACTIVE)).select("analysis_id").distinct()
    return uploads.where(F.col("expires_at") < now).join(used, "analysis_id", "left_anti")


def cache_to_evict(cache: DataFrame, files: DataFrame, cutoff: Column) -> DataFrame:
    """Entries not used since the cutoff, or whose artifact is gone."""
    there = files.select(F.col("path").alias("artifact_path"), F.lit(True).alias("present")).distinct()
    out = cache.join(there, "artifact_path", "left")
    return out.where((F.col("last_used_at") < cutoff) | F.col("present").isNull()).drop("present")


def orphans(folders: DataFrame, owners: DataFrame, cutoff: Column) -> DataFrame:
    """Artifact folders without an owning row, older than the grace time."""
    return folders.where(F.col("modified_at") < cutoff).join(owners, "analysis_id", "left_anti")


def idempotent_requests(requests: DataFrame) -> DataFrame:
    """Per (owner, key): the first request answers all later ones; different fingerprints are a conflict."""
    own = Window.partitionBy("owner_id", "request_key")
    placed = requests.withColumns(
        {
            "place": F.row_number().over(own.orderBy("request_id")),
            "same": F.min("fingerprint").over(own) == F.max("fingerprint").over(own),
            "answer": F.first("request_id").over(own.orderBy("request_id")),
        }
    )
    outcome = F.when(F.col("place") == 1, "new").when(F.col("same"), "reuse").otherwise("conflict")
    return placed.select("request_id", "owner_id", outcome.alias("outcome"), "answer")


def cache_upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry per (owner, key); a summary is kept for complete scans only."""
    latest = Window.partitionBy("owner_id", "key").orderBy(F.desc("used_at"), F.desc("entry_id"))
    rows = current.unionByName(new).withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")
    return rows.withColumn("summary", F.when(F.col("complete"), F.col("summary")))


def cascade(analyses: DataFrame, events: DataFrame, uploads: DataFrame, doomed: DataFrame) -> DataFrame:
    """(kind, id) of all that goes with the doomed analyses: themselves, their events, uploads no other analysis of the owner uses."""
    gone = doomed.select("analysis_id").distinct()
    kept = analyses.join(gone, "analysis_id", "left_anti").select("analysis_id", "owner_id")
    row = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).cast("long").alias("id"))
    mine = uploads.join(gone, "analysis_id", "left_semi")
    shared = uploads.join(kept, ["analysis_id", "owner_id"], "left_semi").select("upload_id").distinct()
    parts = (
        row(analyses.join(gone, "analysis_id", "left_semi"), "analysis", "analysis_id"),
        row(events.join(gone, "analysis_id", "left_semi"), "event", "event_id"),
        row(mine.join(shared, "upload_id", "left_anti"), "upload", "upload_id"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reanalysis_reasons(old: DataFrame, new: DataFrame) -> DataFrame:
    """(config_id, field, layer): fields that differ, and whether they invalidate the lengths or only the estimate."""
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.config_id") == F.col("b.config_id")) & (F.col("a.field") == F.col("b.field"))
    joined = a.join(b, same, "full_outer").where(~F.col("a.value").eqNullSafe(F.col("b.value")))
    field = F.coalesce("a.field", "b.field")
    layer = F.when(field.isin(*LENGTH_FIELDS), "lengths").otherwise("estimate")
    return joined.select(F.coalesce("a.config_id", "b.config_id").alias("config_id"), field.alias("field"), layer.alias("layer"))


def owner_active_count(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE)).groupBy("owner_id").agg(F.count("*").alias("active"))


def owner_upload_bytes(owners: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """Bytes of unexpired uploads per owner, 0 where there are none."""
    live = uploads.where(F.col("expires_at") >= now).groupBy("owner_id").agg(F.sum("size_bytes").alias("bytes"))
    return owners.select("owner_id").distinct().join(live, "owner_id", "left").select("owner_id", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def manifest_bytes(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Known bytes per source: low is what is known, high null if a size is unknown; both null without files."""
    sums = files.groupBy("source").agg(F.sum("size").alias("known"), F.count_if(F.col("size").isNull()).alias("missing"), F.count("*").alias("n"))
    out = sources.join(sums, "source", "left")
    return out.select(
        "source", F.when(F.col("n") > 0, F.coalesce("known", F.lit(0))).alias("bytes_low"), F.when((F.col("n") > 0) & (F.col("missing") == 0), F.col("known")).alias("bytes_high")
    )
