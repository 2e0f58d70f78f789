"""Hand-computed cases of the statistics core, and its invariants."""

import pytest
from pyspark.sql import functions as F

from lengthlab.operators import lengths as L
from lengthlab.operators import stats as S


def branch(spark, lengths, name="sequence"):
    rows = [(f"train:{i}", i, name, n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "row_id string, row_index long, branch string, length long")


def test_nearest_rank_quantiles(spark):
    one = S.quantiles(S.length_counts(branch(spark, range(1, 101)))).first()
    assert (one.p50, one.p90, one.p95, one.p99) == (50, 90, 95, 99)
    other = S.quantiles(S.length_counts(branch(spark, range(10, 80, 10)))).first()
    assert (other.p50, other.p90, other.p95, other.p99) == (40, 70, 70, 70)


@pytest.mark.parametrize("lengths", [[0], [0, 1, 2], [1, 33, 64, 65], [5] * 9, list(range(0, 5000, 7)), [3, 100_000]])
def test_histogram_covers_every_row(spark, lengths):
    rows = S.histogram(S.length_counts(branch(spark, lengths))).orderBy("lo").collect()
    assert sum(r.n for r in rows) == len(lengths)
    width = rows[-1].hi - rows[-1].lo + 1
    assert width & (width - 1) == 0 and len(rows) <= 33
    assert all(a.hi + 1 == b.lo or a.lo == 0 for a, b in zip(rows, rows[1:])) and rows[0].lo >= 0
    for r in rows:
        assert r.n == sum(r.lo <= n <= r.hi for n in lengths)


def test_ties_go_to_the_lowest_row(spark):
    rows = branch(spark, [5, 9, 9, 1])
    assert S.longest_row(rows).first().row_id == "train:1"
    assert [r.row_id for r in S.top_rows(rows, 3).orderBy("place").collect()] == ["train:1", "train:2", "train:0"]


def test_primary_branch_without_rows(spark):
    out = S.length_stats(branch(spark, []), "sft").collect()
    assert [(r.branch, r.rows, r.min_length, r.total) for r in out] == [("sequence", 0, None, None)]


def test_counts_merge_and_do_not_depend_on_partitions(spark):
    rows = branch(spark, [n % 17 for n in range(500)])
    whole = S.length_counts(rows)
    parts = S.merge_counts(S.length_counts(rows.where("row_index < 100")), S.length_counts(rows.where("row_index >= 100").repartition(9)))
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_failed_rows_are_kept_counted_and_without_lengths(spark):
    df = spark.createDataFrame([(0, "a b", "s", "train"), (1, None, "/data/x/s.json", "train")], "row_index long, text string, shard_id string, split string")
    out = {r.row_index: r for r in L.sft_text(df, limit=1).collect()}
    assert (out[0].processing_status, out[0].sequence_tokens, out[0].context_status) == ("ok", 2, "exceeded")
    assert (out[1].processing_status, out[1].error_code, out[1].sequence_tokens, out[1].context_status) == ("failed", "missing_text", None, "unknown")
    assert out[1].shard_id == "s.json"
    counters = S.scan_counters(L.sft_text(df), expected=3).first()
    assert counters.rows_seen == counters.rows_ok + counters.rows_failed == 2
    assert counters.rows_unprocessed == 1 and counters.rows_exceeded is None
    assert S.coverage(S.scan_counters(L.sft_text(df), expected=2)).first().coverage == "partial"
    assert S.coverage(S.scan_counters(L.sft_text(df.where("row_index = 0")), expected=1)).first().coverage == "complete"
    assert S.coverage(S.scan_counters(L.sft_text(df.where("false")))).first().coverage == "failed"


def test_keys_of_a_table_refuse_to_mix(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "s", "train")], "row_index long, text string, shard_id string, split string")
    path = str(tmp_path / "lengths")
    L.write_lengths(L.sft_text(df), path, "a")
    assert L.read_lengths(spark, path).count() == 1
    L.write_lengths(L.sft_text(df), path, "b")
    with pytest.raises(ValueError):
        L.read_lengths(spark, path)
    assert L.read_lengths(spark, path, "b").count() == 1


def test_fingerprint_changes_with_a_value(spark):
    rows = branch(spark, [1, 2, 3])
    one = S.fingerprint(rows, ["row_id", "length"]).first().artifact_key
    assert one == S.fingerprint(rows.repartition(5), ["row_id", "length"]).first().artifact_key
    assert one != S.fingerprint(rows.withColumn("length", F.col("length") + 1), ["row_id", "length"]).first().artifact_key
