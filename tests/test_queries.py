"""Registered queries against their DuckDB SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lengthlab.functions import redact
from lengthlab.operators import mapping, stats
from lengthlab.plans import preprocessing, registry
from lengthlab.sources import arrow, files, text

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return None if value is None else str(value)


def test_every_query_has_its_sql():
    """All but the tokenizer file's, which no SQL can express; it is compared with the library below."""
    assert set(registry.queries()) - set(ORACLES) == {"udf2_tokenizer_plugin"} and len(ORACLES) >= 130


def test_tokenizer_file_counts_match_the_library(spark, duck):
    from tokenizers import Tokenizer

    from lengthlab.functions.tokenizer import default_file

    tokenizer = Tokenizer.from_file(default_file())
    texts = duck.sql("SELECT doc_id, text FROM documents WHERE doc_id % 97 <> 0 AND text IS NOT NULL").fetchall()
    wanted = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts}
    assert {r.row_index: r.n for r in registry.queries()["udf2_tokenizer_plugin"](spark, SF).collect()} == wanted


def agrees(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    return found == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    assert agrees(spark, duck, name)


def _after(change):
    """An operator whose result is changed."""
    return lambda right: lambda *given, **more: change(right(*given, **more))


#: Query, module, operator and how it is broken; the SQL must notice each.
BROKEN = (
    ("src1_scan_json_lines", text, "_too_large", lambda right: lambda t: F.lit(False)),  # infinite numbers pass
    ("src4_scan_csv", text, "scan_csv", _after(lambda df: df.withColumn("lang", F.upper("lang")))),
    ("src6_scan_arrow_ipc", arrow, "scan_arrow", _after(lambda df: df.where("doc_id <> 5"))),  # a row is lost
    ("src10_build_manifest", files, "build_manifest", _after(lambda df: df.withColumn("sha256", F.reverse("sha256")))),
    ("src13_sniff_format", files, "sniff_format", _after(lambda df: df.withColumn("format", F.lit("text")))),
    ("snk3_export_results", redact, "redact_text", lambda right: lambda t: F.concat(t)),  # nothing is masked
    ("fn16_redact_text", redact, "redact_text", lambda right: lambda t: F.concat(t)),
    ("agg17_artifact_fingerprint", stats, "fingerprint", lambda right: lambda df, columns: right(df.where("row_index <> 3"), columns)),
    ("prj4_validate_mapping", mapping, "validate_mapping", _after(lambda df: df.where("issue <> 'kind_mismatch'"))),
    ("set2_except", preprocessing, "schemas", _after(lambda df: df.where("name <> 'prompt'"))),
)


@pytest.mark.parametrize("name, module, operator, broken", BROKEN, ids=[b[0] for b in BROKEN])
def test_sql_notices_a_broken_operator(spark, duck, monkeypatch, name, module, operator, broken):
    monkeypatch.setattr(module, operator, broken(getattr(module, operator)))
    assert not agrees(spark, duck, name)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
