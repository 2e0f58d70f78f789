"""Queries of the streaming operators: the tables are written as files, streamed, and compared with batch SQL."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from lengthlab.operators import lengths as L
from lengthlab.plans.statistics import sql
from lengthlab.scratch import new_folder, stored
from lengthlab.sources.files import list_files
from lengthlab.streaming import scan, seen
from lengthlab.views import view

#: Rows of one written file.
ROWS = 10_000
ALL_FILES = 2**31 - 1


def _files(spark, sf_dir, name="v_text", parts=4, where=None, path=None):
    """A view written as a folder of at least `parts` files (of a table with as many rows), and its schema.

    Each task writes what it has read, with no shuffle, and a file holds ROWS rows at most, so that files and tasks
    grow in number, not in size.
    """
    rows = view(spark, sf_dir, name)
    rows = rows.where(where) if where else rows
    path = path or new_folder(spark, "stream")
    most = max(1, min(ROWS, rows.count() // parts))
    rows.write.mode("append").option("maxRecordsPerFile", most).parquet(path)
    return path, rows.schema


def _share(spark, path, batches=2):
    """Files per batch that make so many batches of those in a folder."""
    return -(-list_files(spark, path, "*.parquet").count() // batches)


def _str1(spark, sf_dir):
    """Half of the files are there at first; the second run resumes with the rest."""
    path, schema = _files(spark, sf_dir, where="row_index % 2 = 0")
    out, share = new_folder(spark, "resumable"), _share(spark, path)
    scan.resumable_scan(spark, path, schema, L.sft_text, out, "pre_a", share)
    _files(spark, sf_dir, where="row_index % 2 = 1", path=path)
    table = scan.resumable_scan(spark, path, schema, L.sft_text, out, "pre_a", share)
    return table.select("row_id", "sequence_tokens", "processing_status")


def _str2(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    stats = scan.running_stats(L.sft_text(scan.file_stream(spark, path, schema, _share(spark, path))), "sft")
    return scan.run_complete(stats, f"running_{uuid.uuid4().hex[:8]}", new_folder(spark, "log"))


def _str3(spark, sf_dir):
    """The event log in three writes in order of the events, each streamed before the next; of each analysis one event in six hours and the last."""
    rows = view(spark, sf_dir, "v_events")
    path, out, log = (new_folder(spark, name) for name in ("progress", "given", "log"))
    last = F.max("event_id").over(Window.partitionBy("analysis_id"))
    rows = stored(rows.select("analysis_id", "event_id", "ts", (F.col("event_id") == last).alias("final")), "events")
    low, high = rows.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    for part in (F.col("event_id") <= low, (F.col("event_id") > low) & (F.col("event_id") <= high), F.col("event_id") > high):
        rows.where(part).write.mode("append").parquet(path)
        events = scan.file_stream(spark, path, rows.schema, ALL_FILES)  # the files of a write are in no order, so they are one batch
        given = scan.throttled(events, "analysis_id", "event_id", "ts", F.col("final"), 6 * 3600)
        query = given.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).select(F.col("key").cast("long").alias("analysis_id"), F.col("order").alias("event_id"))


def _str4(spark, sf_dir):
    """Every other event is there when the query starts; those between are written while it runs, so the log is whole only then."""
    path, schema = _files(spark, sf_dir, "v_events", 2, "event_id % 2 = 0")
    out, share = new_folder(spark, "tail"), _share(spark, path)
    terminal = F.col("status").isin("COMPLETED", "FAILED")
    with ThreadPoolExecutor(1) as writer:
        late = writer.submit(lambda: time.sleep(1) or _files(spark, sf_dir, "v_events", 1, "event_id % 2 = 1", path))
        # What is there first may hold a later terminal event than the rest, so the terminal event is told by the whole log.
        first = view(spark, sf_dir, "v_events").where((F.col("analysis_id") == 3) & (F.col("event_id") > 50) & terminal).agg(F.min("event_id")).first()[0]
        out = scan.tail_events(spark, path, schema, 50, F.col("analysis_id") == 3, F.col("event_id") == first, out, settled=late.done, files_per_batch=share)
        late.result()
    return out.select("event_id", "status").where(F.lit(first is not None))  # the SQL has no rows where nothing ends


def _str5(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    records = L.sft_text(scan.file_stream(spark, path, schema, _share(spark, path)))
    return scan.incremental_merge(records, "sft", new_folder(spark, "counts"), new_folder(spark, "log"))


def _str6(spark, sf_dir):
    path, schema = _files(spark, sf_dir)
    records = L.sft_text(scan.file_stream(spark, path, schema, _share(spark, path, 4))).select("row_id", "content_digest")
    return seen.stream_dedup(records, new_folder(spark, "seen"), new_folder(spark, "log")).select("content_digest")


ENTRIES = {
    "str1_resumable_scan": (_str1, sql("SELECT row_id, sequence_tokens::BIGINT AS sequence_tokens, processing_status FROM {sft}")),
    "str2_running_stats": (
        _str2,
        sql("""
SELECT branch, count(*) AS rows, max(length)::BIGINT AS longest FROM (SELECT branch, length FROM {br}
UNION ALL SELECT 'failed', 0 FROM {sft} WHERE processing_status = 'failed') t GROUP BY branch"""),
    ),
    "str3_throttled_progress": (
        _str3,
        sql("""
SELECT * FROM (WITH RECURSIVE e AS (SELECT analysis_id, event_id, ts, event_id = max(event_id) OVER (PARTITION BY analysis_id) AS final FROM {v_events}),
given AS (
  SELECT analysis_id, min(event_id) AS event_id, arg_min(ts, event_id) AS ts FROM e GROUP BY analysis_id
  UNION ALL
  SELECT g.analysis_id, n.event_id, n.ts FROM given g, LATERAL (
    SELECT event_id, ts FROM e WHERE e.analysis_id = g.analysis_id AND e.event_id > g.event_id AND (e.final OR e.ts - g.ts >= INTERVAL 6 HOUR) ORDER BY event_id LIMIT 1) n)
SELECT analysis_id::BIGINT AS analysis_id, event_id::BIGINT AS event_id FROM given) t"""),
    ),
    "str4_tail_events": (
        _str4,
        sql("""
SELECT event_id, status FROM {v_events} WHERE analysis_id = 3 AND event_id > 50
  AND event_id <= (SELECT min(event_id) FROM {v_events} WHERE analysis_id = 3 AND event_id > 50 AND status IN ('COMPLETED','FAILED'))"""),
    ),
    "str5_incremental_merge": (_str5, sql("SELECT branch, length::BIGINT AS length, n FROM {lc}")),
    "str6_stream_dedup": (_str6, sql("SELECT DISTINCT sha256('text' || chr(31) || text) AS content_digest FROM {v_text} WHERE text IS NOT NULL")),
}
