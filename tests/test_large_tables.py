"""Queries over tables of many files, in an order of rows that the SQL does not rely on."""

import pytest
from pyspark.sql import functions as F

from lengthlab.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """documents in nine files, last ids first."""
    root = str(tmp_path_factory.mktemp("scattered"))
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rows.repartitionByRange(9, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{root}/documents.parquet")
    return root


def indexed(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("source >= 'src3'").orderBy("source", "doc_id").collect()
    return [(r.doc_id, i) for i, r in enumerate(rows)]


def test_row_index_follows_the_order_of_the_split_s_files(spark, scattered):
    rows = registry.queries()["src9_with_row_index"](spark, scattered).collect()
    assert sorted((r.row_index, r.doc_id, r.row_id) for r in rows) == [(i, d, f"train:{i}") for d, i in indexed(spark)]


def test_a_sample_is_the_first_rows(spark, scattered):
    rows = registry.queries()["src15_sample_scan"](spark, scattered).collect()
    assert sorted((r.row_index, r.doc_id) for r in rows) == [(i, d) for d, i in indexed(spark)[:30]]


def test_a_record_s_tokens_are_found_once(spark):
    """Lengths, loss, status and digest of a text come from one pass of the pattern."""
    from lengthlab.operators import lengths as L

    rows = spark.createDataFrame([(0, "t", "s", "a b"), (1, "t", "s", None)], "row_index long, split string, shard_id string, text string")
    out = L.sft_text(rows, limit=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r.sequence_tokens, r.loss_token_count, r.context_status, r.token_digest is None) for r in out.orderBy("row_index").collect()] == [(2, 1, "exceeded", False), (None, None, "unknown", True)]


def test_streamed_files_grow_in_number_not_in_size(spark, monkeypatch):
    from lengthlab.plans import streams

    monkeypatch.setattr(streams, "ROWS", 10)
    path, schema = streams._files(spark, SF)
    per_file = spark.read.schema(schema).parquet(path).groupBy(F.input_file_name()).count().collect()
    assert max(r[1] for r in per_file) <= 10 and sum(r[1] for r in per_file) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert streams._share(spark, path) == -(-len(per_file) // 2)
