"""Chat, mapping, source and streaming cases on small inline rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.functions import chat, redact, units
from lengthlab.functions.text import token_length
from lengthlab.operators import mapping as M
from lengthlab.sources import files, text
from lengthlab.sources.arrow import scan_compressed_text
from lengthlab.sources.members import kind_of

MESSAGES = "a array<struct<role:string,content:string>>, b array<struct<role:string,content:string>>"


def test_extract_prompt_keeps_the_last_shared_turn_out(spark):
    u, x, y = ("user", "q"), ("assistant", "x"), ("assistant", "y")
    rows = [([u, x], [u, y]), ([u, x], [u]), ([u], [u]), ([], [u])]
    df = spark.createDataFrame(rows, MESSAGES).select(chat.extract_prompt("a", "b").alias("p"))
    sizes = [None if r.p is None else tuple(len(v) for v in r.p) for r in df.collect()]
    assert sizes == [(1, 1, 1), (0, 2, 1), (0, 1, 1), None]


def test_rendering_and_policies(spark):
    df = spark.createDataFrame([([("system", " "), ("user", "hi")], [])], MESSAGES)
    row = df.select(
        chat.render_chat(chat.omit_blank_system("a"), True).alias("text"), chat.render_chat("b").alias("none"), F.size(chat.omit_blank_system("a")).alias("n")
    ).first()
    assert row.text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and row.none is None and row.n == 1


def test_loss_positions(spark):
    df = spark.createDataFrame([(4, [0, 1, 1, 1], [1, 1, 0, 1]), (1, [1], [1]), (0, [], [])], "n long, a array<int>, b array<int>")
    out = df.select(chat.loss_positions(None, F.col("n")).alias("free"), chat.loss_positions([F.col("a"), F.col("b")], F.col("n")).alias("both")).collect()
    assert [(r.free, r.both) for r in out] == [(3, 2), (0, 0), (0, 0)]


def test_lengths_and_rounding(spark):
    row = spark.createDataFrame([("héllo, wörld 👍",)], "t string").select(
        token_length("t").alias("tokens"), token_length("t", "bytes").alias("bytes"), token_length("t", "chars").alias("chars"),
        units.round_up(F.lit(65), 64).alias("up"), units.round_up(F.lit(64), 64).alias("same"),
    ).first()
    assert (row.tokens, row.bytes, row.chars, row.up, row.same) == (8, 19, 14, 128, 64)


def test_redaction(spark):
    rows = [
        ("hf_abcdefgh1234", "hf_***"),
        ("see https://u:p@example.com:8443/a/b?x=1#y, ok", "see https://example.com:8443/a/b, ok"),
        ("http://localhost/x http://192.168.1.4/ https://a.internal/z", "<redacted-url> <redacted-url> <redacted-url>"),
        ("text/event-stream and docs/x.md stay, /usr/lib/x goes", "text/event-stream and docs/x.md stay, <redacted-path> goes"),
        ("Bearer abcd1234", "Bearer ***"),
    ]
    df = spark.createDataFrame(rows, "given string, wanted string")
    assert [r.out for r in df.select(redact.redact_text("given").alias("out")).collect()] == [w for _, w in rows]


def kinds(spark, *schemas):
    rows = [(f"d{i}", p, n, "string") for i, names in enumerate(schemas) for p, n in enumerate(names)]
    return spark.createDataFrame(rows, "dataset string, position int, name string, kind string")


def test_mapping_candidates(spark):
    found = M.mapping_candidates(kinds(spark, ("prompt", "question", "chosen", "rejected", "answer"), ("Question", "chosen", "rejected"), ("chosen", "rejected"), ("text",)), "dpo")
    best = {r.dataset: r for r in M.suggest(found).collect()}
    assert set(best) == {"d1", "d2"}
    assert (best["d1"].prompt, best["d1"].format, best["d2"].format) == ("Question", "preference", "preference_implicit")
    assert found.where("dataset = 'd0' and ambiguous").count() > 0
    assert [r.format for r in M.suggest(M.mapping_candidates(kinds(spark, ("text",)))).collect()] == ["text"]


def test_column_kinds(spark):
    df = spark.createDataFrame([([("user", "x")], 1, True, None)], "m array<struct<role:string,content:string>>, n int, b boolean, s string")
    assert [r.kind for r in M.column_kinds(df).orderBy("position").collect()] == ["messages", "number", "other", "string"]


SCHEMA = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("n", T.LongType())])


def test_bad_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "a", "n": 1}\n\n{bad\n[1]\n{"prompt": "b", "prompt": "c"}\n{"n": 1e999}\n{"n": "x"}\n{"prompt": null}\n')
    rows = text.scan_json_lines(spark, str(tmp_path), SCHEMA).orderBy("line").collect()
    assert [(r.line, r.error_code) for r in rows] == [
        (1, None), (3, "json_parse"), (4, "not_an_object"), (5, "json_parse"), (6, "json_parse"), (7, "schema_mismatch"), (8, None),
    ]


def test_array_elements_and_scalars(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "a"}, "b", {"text": "c"}]')
    rows = text.scan_json_array(spark, str(tmp_path), T.StructType([T.StructField("text", T.StringType())])).orderBy("element").collect()
    assert [(r.element, r.text, r.error_code) for r in rows] == [(0, "a", None), (1, "b", None), (2, "c", None)]


def test_csv_quotes_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('prompt,n\n"a, ""b""\nc",1\nNA,2\nx,y\n')
    rows = text.scan_csv(spark, str(tmp_path), SCHEMA).orderBy("element").collect()
    assert [(r.prompt, r.n, r.error_code) for r in rows] == [('a, "b"\nc', 1, None), (None, 2, None), (None, None, "schema_mismatch")]


def test_compressed_text(spark, tmp_path):
    import bz2
    import gzip
    import lzma

    import pyarrow as pa

    body = b"one\ntwo\n"
    for name, data in {
        "a.gz": gzip.compress(body), "b.bz2": bz2.compress(body), "c.xz": lzma.compress(body), "d.txt": body,
        "e.zst": pa.compress(body, codec="zstd", asbytes=True),
    }.items():
        (tmp_path / name).write_bytes(data)
    out = scan_compressed_text(spark, str(tmp_path)).groupBy("path").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    assert len(out) == 5 and all(r.v == ["one", "two"] for r in out)
    try:
        kind_of(b"PAR1....")
    except ValueError:
        pass
    else:
        raise AssertionError("columnar files must be refused")


def test_row_index_follows_file_and_record_order(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    found = files.layout(files.list_files(spark, str(tmp_path), "*.parquet"), {"train": "part"})
    rows = files.with_row_index(spark, files.load_split(spark, found, "train"), found, "train").orderBy("row_index").collect()
    assert [(r.row_index, r.id) for r in rows] == list(enumerate([*range(5), *range(10, 15), *range(20, 25)]))
    assert rows[7].row_id == "train:7"
