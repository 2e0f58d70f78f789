"""JSON arrays and fields read by many tasks, with strings that look like structure across the edges of blocks."""

import json
import random

import pytest
from pyspark.sql import types as T

from lengthlab.sources import text

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])
HARD = ['"', "\\", ",", "[", "]", "{", "}", '\\"', "a", "é", "\n", '",', "\\\\", '],"id":7,[']


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("700b", "1b", "16")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def made_up(rng, n):
    return [{"s": "".join(rng.choice(HARD) for _ in range(rng.randrange(40))), "id": i, "more": [[1, {"x": [2, 3]}], "],["]} for i in range(n)]


def test_arrays_split_at_any_place(spark, small_blocks, tmp_path):
    rng = random.Random(4)
    files = {}
    for name, indent in (("a", None), ("b", 2), ("c", None)):
        files[name] = made_up(rng, 80)
        (tmp_path / name).write_text(json.dumps(files[name], indent=indent, ensure_ascii=name != "c"), encoding="utf-8")
    rows = text.scan_json_array(spark, str(tmp_path), RECORD)
    found = {(r.path[-1], r.element): (r.id, r.s, r.error_code) for r in rows.collect()}
    assert found == {(name, i): (i, r["s"], None) for name, own in files.items() for i, r in enumerate(own)}
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 15


def test_odd_arrays(spark, tmp_path):
    cases = {
        "empty": "[]", "blank": "  \n[ \n ]", "scalars": '["x, y", 1.5, null, true]', "mixed": '[{"id":1},[2],{"id":"no"},{bad,},{"id":3}]',
        "cut": '[{"id":1},{"id":2,"s":"a', "open": '[{"id":1},', "object": '{"id":1}', "mark": '﻿[{"id":9}]', "trailing": '[{"id":1},]',
    }
    for name, data in cases.items():
        (tmp_path / name).write_text(data)
    (tmp_path / "bytes").write_bytes(b'[{"id":1,"s":"\xff"},{"id":2}]')
    rows = text.scan_json_array(spark, str(tmp_path), T.StructType([*RECORD.fields, T.StructField("text", T.StringType())]))
    found = {}
    for r in rows.collect():
        found.setdefault(r.path.split("/")[-1], []).append((r.element, r.id, r.text, r.error_code))
    found = {name: sorted(own, key=str) for name, own in found.items()}
    assert found == {
        "scalars": [(0, None, "x, y", None), (1, None, "1.5", None), (2, None, None, "not_an_object"), (3, None, "true", None)],
        "mixed": [(0, 1, None, None), (1, None, None, "not_an_object"), (2, None, None, "schema_mismatch"), (3, None, None, "json_parse"), (4, 3, None, None)],
        "cut": [(0, 1, None, None), (1, None, None, "json_parse")], "open": [(0, 1, None, None), (1, None, None, "json_parse")],
        "object": [(None, None, None, "not_an_array")], "mark": [(0, 9, None, None)],
        "trailing": [(0, 1, None, None), (1, None, None, "json_parse")], "bytes": [(0, None, None, "invalid_utf8"), (1, 2, None, None)],
    }


def test_fields_split_at_any_place(spark, small_blocks, tmp_path):
    rng = random.Random(5)
    rows = made_up(rng, 60)
    before, after = made_up(rng, 20), made_up(rng, 20)
    whole = {"meta": {"rows": [1, 2], "n": before}, "x": '"rows":[', "other": before, "rows": rows, "later": after, "k": 5}
    (tmp_path / "a").write_text(json.dumps(whole))
    (tmp_path / "b").write_text(json.dumps(whole, indent=1))
    (tmp_path / "c").write_text('{"ro\\u0077s" : [{"id":1},[1],{"id":"x"},{"id":4,"s":"cut')
    (tmp_path / "d").write_text('{"others":[{"id":1}]}')
    (tmp_path / "e").write_text('{"rows":{"id":1}}')
    (tmp_path / "f").write_text('{"rows":[]}')
    found = {}
    for r in text.scan_json_field(spark, str(tmp_path), "rows", RECORD).collect():
        found.setdefault(r.path[-1], []).append((r.element, r.id, r.s, r.error_code))
    good = sorted((i, i, r["s"], None) for i, r in enumerate(rows))
    assert sorted(found["a"]) == good and sorted(found["b"]) == good and "f" not in found
    assert sorted(found["c"]) == [(0, 1, None, None), (1, None, None, "not_an_object"), (2, None, None, "schema_mismatch"), (3, None, None, "json_parse")]
    assert found["d"] == found["e"] == [(None, None, None, "json_field_unreadable")]
