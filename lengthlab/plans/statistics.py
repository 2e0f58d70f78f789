"""Queries of the statistics core over the length table of `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lengthlab.functions.text import TOKENS
from lengthlab.operators import lengths as L
from lengthlab.operators import stats as S
from lengthlab.scratch import stored
from lengthlab.views import duck, view

LIMIT = 1024


def text_lengths(spark, sf_dir):
    return L.sft_text(view(spark, sf_dir, "v_text"), limit=LIMIT)


def stored_lengths(spark, sf_dir):
    """What the planners read of the length table, from one scan of the texts."""
    chosen = text_lengths(spark, sf_dir).select("row_id", "row_index", "sequence_tokens", "loss_token_count", "processing_status", "context_status")
    return stored(chosen, "lengths")


def preference_lengths(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference").withColumns({"split": F.lit("train"), "shard_id": F.lit("conversations")})
    return L.dpo(rows, limit=LIMIT)


def text_branches(spark, sf_dir):
    return S.branch_rows(text_lengths(spark, sf_dir), "sft")


def counts(spark, sf_dir):
    """Counts per branch and length, from one scan of the texts; small, whatever the number of rows."""
    return stored(S.length_counts(text_branches(spark, sf_dir)), "counts")


def _n(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKENS}'))"


S_, E_ = "'<|im_start|>'", "'<|im_end|>' || chr(10)"
_TURN = f"{S_} || {{0}} || chr(10) || {{1}} || {E_}"
_SYS = f"CASE WHEN trim(system) = '' THEN '' ELSE {_TURN.format(chr(39) + 'system' + chr(39), 'system')} END"
_PROMPT = f"{_SYS} || {_TURN.format(chr(39) + 'user' + chr(39), 'prompt')}"
_GEN = f"{_PROMPT} || {S_} || 'assistant' || chr(10)"


def _branch(name: str) -> str:
    return f"{_PROMPT} || {_TURN.format(chr(39) + 'assistant' + chr(39), name)}"


DERIVED = {
    "sft": f"""
SELECT split || ':' || CAST(row_index AS VARCHAR) AS row_id, row_index, shard_id, split, text,
  {_n('text')} AS sequence_tokens, CASE WHEN text IS NOT NULL THEN greatest({_n('text')} - 1, 0) END AS loss_token_count,
  CASE WHEN text IS NULL THEN 'failed' ELSE 'ok' END AS processing_status,
  CASE WHEN text IS NULL THEN 'missing_text' END AS error_code,
  CASE WHEN text IS NULL THEN 'unknown' WHEN {_n('text')} > {LIMIT} THEN 'exceeded' ELSE 'ok' END AS context_status,
  CASE WHEN text IS NOT NULL THEN sha256('text' || chr(31) || text) END AS content_digest
FROM {{v_text}}""",
    "br": """
SELECT row_id, row_index, 'sequence' AS branch, sequence_tokens AS length FROM {sft} WHERE text IS NOT NULL
UNION ALL SELECT row_id, row_index, 'loss', loss_token_count FROM {sft} WHERE text IS NOT NULL""",
    "lc": "SELECT branch, length, count(*) AS n FROM {br} GROUP BY branch, length",
    "run": """
SELECT *, sum(n) OVER (PARTITION BY branch ORDER BY length)::BIGINT AS at_or_below, sum(n) OVER (PARTITION BY branch)::BIGINT AS total
FROM {lc}""",
    "pref": f"""
SELECT 'train:' || CAST(row_index AS VARCHAR) AS row_id, row_index, system, prompt, chosen, rejected, p AS prompt_tokens,
  CASE WHEN ok THEN greatest(c - p, 0) END AS chosen_completion_tokens, CASE WHEN ok THEN p + greatest(c - p, 0) END AS chosen_total_tokens,
  CASE WHEN ok THEN greatest(r - p, 0) END AS rejected_completion_tokens,
  CASE WHEN ok THEN p + greatest(r - p, 0) END AS rejected_total_tokens, ok
FROM (SELECT *, prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL AS ok, {_n(_GEN)} AS p,
  {_n(_branch('chosen'))} AS c, {_n(_branch('rejected'))} AS r FROM {{v_preference}}) x""",
}


def sql(text: str) -> str:
    return duck(text, DERIVED)


def _prj12(spark, sf_dir):
    return text_lengths(spark, sf_dir).select("row_id", "context_status")


def _agg2(spark, sf_dir):
    return preference_lengths(spark, sf_dir).select("row_id", S.pair_max().alias("pair_max"))


def _agg4(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    one, other = (S.length_counts(S.branch_rows(L.sft_text(rows.where(c)), "sft")) for c in ("split = 'train'", "split = 'test'"))
    return S.merge_counts(one, other)


def _agg10(spark, sf_dir):
    return S.scan_counters(text_lengths(spark, sf_dir), limit=LIMIT)


def _agg11(spark, sf_dir):
    return S.coverage(S.scan_counters(text_lengths(spark, sf_dir), limit=LIMIT))


def _agg12(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    layout = rows.groupBy("shard_id").agg(F.count("*").alias("expected"))
    return S.shard_progress(L.sft_text(rows.where("row_index % 13 <> 0 or shard_id <= 'src3'")), layout)


def _agg13(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    flags = rows.select(
        L.row_id().alias("row_id"),
        "row_index",
        F.coalesce(F.contains("text", F.lit("@")), F.lit(False)).alias("literal_token"),
        F.coalesce(F.col("text").rlike("^[0-9]"), F.lit(False)).alias("template_loss"),
        F.col("text").isNull().alias("missing"),
    )
    return S.finding_counts(flags, ["literal_token", "template_loss", "missing"])


def _agg14(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[a-z0-9]+@[a-z0-9]+"), F.lit(0))
    return S.token_set(view(spark, sf_dir, "v_text").where("text is not null").select(found.alias("found")), "found")


def _agg16(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference")
    blank = F.trim("system") == ""
    return rows.agg(
        F.count_if(blank).alias("omitted_under_omit"), F.lit(None).cast("long").alias("omitted_under_keep"), F.count("*").alias("rows")
    )


def _agg17(spark, sf_dir):
    """The key of the length table, from rows in another order than the scan's."""
    return S.fingerprint(text_lengths(spark, sf_dir).repartition(7).sortWithinPartitions("sequence_tokens"), list(ARTIFACT))


ARTIFACT = ("row_id", "sequence_tokens", "loss_token_count", "processing_status")
_DIGEST = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ARTIFACT) + ")"
_AGG17 = f"""
SELECT sha256(concat_ws(':', CAST(bit_xor(h) AS VARCHAR), CAST(sum(h) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS artifact_key, count(*) AS rows
FROM (SELECT CAST('0x' || substr(md5({_DIGEST}), 1, 15) AS BIGINT) AS h FROM {{sft}}) t"""


def _win2(spark, sf_dir):
    return S.k_longest(text_lengths(spark, sf_dir), "sequence_tokens", 25)


def _set1(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    one = rows.where("split = 'train'").select("row_index", "split", "lang")
    other = rows.where("split = 'test'").select("row_index", "split", "shard_id")
    return one.unionByName(other, allowMissingColumns=True)


ENTRIES = {
    "prj12_context_status": (_prj12, sql("SELECT row_id, context_status FROM {sft}")),
    "agg1_branch_unpivot": (text_branches, sql("SELECT row_id, row_index, branch, length::BIGINT AS length FROM {br}")),
    "agg2_pair_max": (_agg2, sql("SELECT row_id, CASE WHEN ok THEN greatest(chosen_total_tokens, rejected_total_tokens) END AS pair_max FROM {pref}")),
    "agg3_length_stats": (
        lambda s, d: S.length_stats(text_branches(s, d), "sft"),
        sql(
            "SELECT branch, count(*) AS rows, min(length) AS min_length, max(length) AS max_length, sum(length)::BIGINT AS total, "
            "sum(length)::DOUBLE / count(*) AS mean_length FROM {br} GROUP BY branch"
        ),
    ),
    "agg4_length_counts": (_agg4, sql("SELECT branch, length, n FROM {lc}")),
    "agg5_nearest_rank_quantiles": (
        lambda s, d: S.quantiles(counts(s, d)),
        sql(
            "SELECT branch, max(total) AS rows, "
            + ", ".join(
                f"min(CASE WHEN at_or_below >= greatest(1, ({p} * total + 99) // 100) THEN length END) AS p{p}" for p in S.QUANTILES
            )
            + " FROM {run} GROUP BY branch"
        ),
    ),
    "agg6_pow2_histogram": (
        lambda s, d: S.histogram(counts(s, d)),
        sql("""
SELECT e.branch, CASE WHEN e.bin < 0 THEN 0 ELSE e.bin * w + 1 END::BIGINT AS lo, ((e.bin + 1) * w)::BIGINT AS hi, coalesce(n, 0)::BIGINT AS n
FROM (SELECT branch, w, unnest(generate_series(floor((low - 1) / w)::BIGINT, floor((high - 1) / w)::BIGINT)) AS bin
  FROM (SELECT branch, low, high, (1 << ceil(log2((high - low + 32) // 32))::INT)::BIGINT AS w
    FROM (SELECT branch, min(length) AS low, max(length) AS high FROM {lc} GROUP BY branch) a) b) e
LEFT JOIN (SELECT branch, floor((length - 1) / w)::BIGINT AS bin, sum(n) AS n
  FROM {lc} JOIN (SELECT branch, (1 << ceil(log2((max(length) - min(length) + 32) // 32))::INT)::BIGINT AS w FROM {lc} GROUP BY branch) z USING (branch)
  GROUP BY 1, 2) c ON e.branch = c.branch AND e.bin = c.bin"""),
    ),
    "agg7_arg_max_first": (
        lambda s, d: S.longest_row(text_branches(s, d)),
        sql("SELECT branch, row_id, length::BIGINT AS length FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY length DESC, row_index) AS k FROM {br}) t WHERE k = 1"),
    ),
    "agg8_count_above": (
        lambda s, d: S.count_above(text_branches(s, d), 512),
        sql("SELECT branch, count(*) FILTER (length > 512) AS rows_above, count(*) AS rows FROM {br} GROUP BY branch"),
    ),
    "agg9_duplicate_rows": (
        lambda s, d: S.duplicate_rows(text_lengths(s, d)),
        sql("SELECT count(*) AS rows, count(*) - count(DISTINCT content_digest) AS duplicates FROM {sft} WHERE processing_status = 'ok'"),
    ),
    "agg10_scan_counters": (
        _agg10,
        sql(
            "SELECT count(*) AS rows_seen, count(*) FILTER (processing_status = 'ok') AS rows_ok, count(*) FILTER (processing_status = 'failed') AS rows_failed, "
            "CAST(NULL AS BIGINT) AS rows_unprocessed, count(*) FILTER (context_status = 'exceeded') AS rows_exceeded FROM {sft}"
        ),
    ),
    "agg11_coverage_status": (
        _agg11,
        sql(
            "SELECT count(*) AS rows_seen, count(*) FILTER (processing_status = 'ok') AS rows_ok, count(*) FILTER (processing_status = 'failed') AS rows_failed, "
            "CAST(NULL AS BIGINT) AS rows_unprocessed, count(*) FILTER (context_status = 'exceeded') AS rows_exceeded, true AS all_rows_seen, count(*) = 0 AS empty, "
            "CASE WHEN count(*) = 0 THEN 'failed' WHEN count(*) FILTER (processing_status = 'failed') = 0 THEN 'complete' ELSE 'partial' END AS coverage FROM {sft}"
        ),
    ),
    "agg12_shard_progress": (
        _agg12,
        sql(
            "SELECT shard_id, count(*) AS expected, count(*) FILTER (row_index % 13 <> 0 OR shard_id <= 'src3') AS seen, "
            "count(*) FILTER (row_index % 13 <> 0 OR shard_id <= 'src3') >= count(*) AS done FROM {v_text} GROUP BY shard_id"
        ),
    ),
    "agg13_diagnostic_counts": (
        _agg13,
        sql("""
SELECT finding, count(*) AS n, string_agg(row_id, ',' ORDER BY row_index) FILTER (k <= 20) AS row_ids
FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY row_index) AS k FROM (
  SELECT split || ':' || CAST(row_index AS VARCHAR) AS row_id, row_index,
    unnest(list_filter([CASE WHEN contains(text, '@') THEN 'literal_token' END, CASE WHEN regexp_matches(text, '^[0-9]') THEN 'template_loss' END,
      CASE WHEN text IS NULL THEN 'missing' END], lambda x: x IS NOT NULL)) AS finding FROM {v_text}) a) b GROUP BY finding"""),
    ),
    "agg14_literal_token_set": (
        _agg14,
        sql(
            "SELECT string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z0-9]+@[a-z0-9]+')) AS token "
            "FROM {v_text} WHERE text IS NOT NULL ORDER BY token LIMIT 20) t"
        ),
    ),
    "agg15_failed_sample": (
        lambda s, d: S.failed_sample(text_lengths(s, d)),
        sql("SELECT row_index, row_id, shard_id, error_code FROM {sft} WHERE processing_status = 'failed' ORDER BY row_index LIMIT 100"),
    ),
    "agg16_omitted_system": (
        _agg16,
        sql("SELECT count(*) FILTER (trim(system) = '') AS omitted_under_omit, CAST(NULL AS BIGINT) AS omitted_under_keep, count(*) AS rows FROM {v_preference}"),
    ),
    "agg17_artifact_fingerprint": (_agg17, sql(_AGG17)),
    "win1_top_rows": (
        lambda s, d: S.top_rows(text_branches(s, d)).select("branch", "place", "row_id", "length"),
        sql("SELECT branch, place::INT AS place, row_id, length::BIGINT AS length FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY length DESC, row_index) AS place FROM {br}) t WHERE place <= 10"),
    ),
    "win2_k_longest": (
        _win2,
        sql("SELECT row_id, row_index, sequence_tokens::BIGINT AS length FROM {sft} WHERE text IS NOT NULL ORDER BY sequence_tokens DESC, row_index LIMIT 25"),
    ),
    "win3_running_count": (lambda s, d: S.running_counts(counts(s, d)), sql("SELECT branch, length::BIGINT AS length, n, at_or_below, total FROM {run}")),
    "set1_union_of_shards": (
        _set1,
        sql("SELECT row_index, split, CASE WHEN split = 'train' THEN lang END AS lang, CASE WHEN split = 'test' THEN shard_id END AS shard_id FROM {v_text}"),
    ),
    "udaf1_length_accumulator": (
        lambda s, d: S.quantiles(_agg4(s, d)).select("branch", "rows", "p50"),
        sql("SELECT branch, max(total) AS rows, min(CASE WHEN at_or_below >= greatest(1, (50 * total + 99) // 100) THEN length END) AS p50 FROM {run} GROUP BY branch"),
    ),
}
