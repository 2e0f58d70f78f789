"""Readers on odd files, redaction against a plain version, names, dtypes and pluggable tokenizers."""

import ipaddress
import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.functions import names, redact, units
from lengthlab.operators import lengths as L
from lengthlab.operators import mapping as M
from lengthlab.sources import files, text

RECORD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])


def test_json_lines_fail_for_what_stands_outside_strings(spark, tmp_path):
    lines = [
        b'{"doc_id":1,"lang":"sha 9e1234 id"}', b'{"doc_id":2,"lang":"\xff\xfe"}', b'{"doc_id":3,"x":1e999}',
        b'{"doc_id":4,"x":1.5e100,"lang":"q\\"9e999\\""}', b'{"doc_id":5,"doc_id":6}', b"", b"[1]", b"{bad",
        b'{"doc_id":7,"n":{"a":1,"a":2}}', b'{"doc_id":"x"}', b'{"doc_id":8,"lang":"k\\\\","x":[1E+400]}', b'{"doc_id":9,"x":1e-999}',
    ]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    rows = text.scan_json_lines(spark, str(tmp_path), RECORD).orderBy("line").collect()
    assert [(r.line, r.doc_id, r.error_code) for r in rows] == [
        (1, 1, None), (2, None, "invalid_utf8"), (3, None, "json_parse"), (4, 4, None), (5, None, "json_parse"),
        (7, None, "not_an_object"), (8, None, "json_parse"), (9, None, "json_parse"), (10, None, "schema_mismatch"),
        (11, None, "json_parse"), (12, 9, None),
    ]
    assert rows[3].lang == 'q"9e999"'


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rejected,chosen,more\nbad,good,1\nNA,-,2\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("chosen", "rejected", "absent")])
    rows = text.scan_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("element").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "good", "bad", None, None), (1, "-", None, None, None)]
    assert text.scan_csv(spark, str(tmp_path / "a.csv"), schema, na=("-",)).where("chosen is null").count() == 1
    (tmp_path / "b.csv").write_text("chosen,rejected,more\ngood,bad,1\n")
    with pytest.raises(Exception, match="b.csv|header"):
        text.scan_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema).collect()


def test_formats_are_told_by_content(spark, tmp_path):
    for name, data in (("a", b"PAR1xxPAR1"), ("b", b"PAR1"), ("c", b"ARROW1.."), ("d", b" \n[1]"), ("e", b"{}"), ("g", b"PAR1 no tail")):
        (tmp_path / name).write_bytes(data)
    found = {r.path[-1]: r.format for r in files.sniff_format(spark, str(tmp_path)).collect()}
    assert found == {"a": "parquet", "b": "parquet", "c": "arrow", "d": "json_array", "e": "json_lines", "g": "text"}


def plain_private(host):
    if host.startswith("[") or host in redact.PRIVATE_NAMES or host.endswith(redact.PRIVATE_SUFFIXES) or "." not in host:
        return True
    try:
        return not ipaddress.ip_address(host).is_global
    except ValueError:
        return False


def test_hosts_stay_where_they_are_global(spark):
    rng = random.Random(3)
    edges = ["9.255.255.255", "10.0.0.0", "100.63.255.255", "100.64.0.1", "172.15.0.1", "172.16.0.1", "172.32.0.0", "192.0.2.7", "192.1.2.3"]
    edges += ["198.17.1.1", "198.18.0.1", "198.20.0.1", "203.0.113.9", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "01.2.3.4"]
    hosts = edges + [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(200)] + ["a.local", "ex.org", "box", "localhost", "[::1]"]
    df = spark.createDataFrame([(f"see http://u:p@{h}:81/x?q#f. now",) for h in hosts], "t string").withColumn("o", redact.redact_text("t"))
    for h, row in zip(hosts, df.collect()):
        assert row.o == ("see <redacted-url>. now" if plain_private(h) else f"see http://{h}:81/x. now"), h


def test_paths_and_secrets(spark):
    cases = {
        "(/usr/x) a(/b/c)|/d/e| \"/q/w\" /single //a/b": "(<redacted-path> a(<redacted-path>|<redacted-path>| \"<redacted-path>\" /single //a/b",
        "/a/b//c x=/etc/passwd/ é/a/b and/or P50/P90 local:models/x": "<redacted-path>/c x=<redacted-path> é/a/b and/or P50/P90 local:models/x",
        "C:\\Users\\x y cC:\\no D:\\ ~/ (~/b a~/b/c": "<redacted-path> y cC:\\no D:\\ ~/ (<redacted-path> a~/b/c",
        "hf_abcdefgh hf_short xhf_abcdefghij hf_abcdefgh_tail": "hf_*** hf_short xhf_abcdefghij hf_***_tail",
        f"ghp_{'a' * 20} ghx_{'a' * 20} gho_{'b' * 19}": f"gh_*** ghx_{'a' * 20} gho_{'b' * 19}",
        "BEARER \t tok.1~2 bearer abc forbearer tokens": "BEARER *** bearer abc forbearer tokens",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").withColumn("o", redact.redact_text("t"))
    out = {r.t: r.o for r in df.collect()}
    assert out.pop(None) is None and out == cases


def test_whole_texts_without_secrets_stay(spark):
    rng = random.Random(1)
    pieces = ["word", "a/b", "http", "://", ":", "~", "\\", "'", '"', "<", ">", "|", "\n", "  ", "x.y", "10.0.0.1", "é", "/"]
    texts = ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("o", redact.redact_text("t"))
    for row in df.collect():
        for found in re.findall(r"https?://[^\s'\"<>`]+", row.o):  # what is left is public
            host = urlsplit(found).hostname or ""
            assert host and not plain_private(host), (row.t, row.o)
        if "/" not in row.t and "\\" not in row.t:
            assert row.o == row.t


def test_names_of_real_checkpoints(spark):
    cases = {
        "bert.encoder.layer.11.attention.self.query.weight": ("text", 11), "vision_encoder.blocks.3.mlp.fc1.weight": ("vision", 3),
        "gpt_neox.embed_in.weight": ("text", None), "audio_encoder.conv1.weight": ("audio", None), "model.connector.weight": ("projector", None),
        "model.layers.0.block_sparse_moe.experts.3.w1.weight": ("text", 0),
    }
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    out = {r.name: (r.c, r.l) for r in df.select("name", names.component("name").alias("c"), names.layer_index("name").alias("l")).collect()}
    assert out == cases
    roles = {"x.embed_in.weight": "embedding", "x.wpe.weight": "parameter", "x.LayerNorm.weight": "linear_weight", "x.ln_1.weight": "norm", "x.lnear.weight": "linear_weight"}
    df = spark.createDataFrame([(n,) for n in roles], "name string")
    role = names.role("name", F.lit(2), F.lit(False), F.lit(True))
    assert {r.name: r.r for r in df.select("name", role.alias("r")).collect()} == roles


def test_dtype_spellings_in_any_case(spark):
    rows = [("FP16",), ("Float32",), ("torch.BFloat16",), (" tfloat32 ",), ("F8_E4M3",), ("f8_e4m3",), ("half",), ("nonsense",)]
    df = units.with_bytes(spark.createDataFrame(rows, "raw_dtype string").withColumn("numel", F.lit(3)))
    out = {r.raw_dtype: (r.dtype, r.nbytes) for r in df.collect()}
    assert out["FP16"] == ("float16", 6) and out["Float32"] == ("float32", 12) and out["torch.BFloat16"] == ("bfloat16", 6)
    assert out[" tfloat32 "] == ("tfloat32", 12) and out["F8_E4M3"][0] == "float8_e4m3fn" and out["f8_e4m3"][0] is None and out["nonsense"] == (None, None)


def test_records_take_any_tokenizer(spark):
    from tokenizers import Tokenizer

    from lengthlab.functions.tokenizer import default_file, file_token_length

    tokenizer = Tokenizer.from_file(default_file())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = [(0, "train", "s", "Some unusual wording.", "An answer, at last"), (1, "train", "s", None, "x")]
    df = spark.createDataFrame(rows, "row_index long, split string, shard_id string, prompt string, completion string")
    out = L.sft_prompt_completion(df, "prompt", "completion", by=file_token_length()).orderBy("row_index").collect()
    p, whole = count(rows[0][3]), count(rows[0][3] + rows[0][4] + L.EOS)
    assert (out[0].prompt_tokens, out[0].sequence_tokens, out[0].completion_tokens) == (p, whole, whole - p)
    assert out[1].processing_status == "failed" and out[1].sequence_tokens is None
    assert out[0].tokenizer_fingerprint != L.TOKENIZER


def test_assistant_only_loss(spark):
    turns = [("system", "be kind"), ("user", "one two"), ("assistant", "three four five"), ("user", "six"), ("assistant", None)]
    kind = "row_index long, split string, shard_id string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(0, "t", "s", turns), (1, "t", "s", turns[:2])], kind)
    rows = L.sft_messages(df, assistant_only=True).orderBy("row_index").collect()
    mark = 5  # tokens of the end mark: < | im_end | >
    assert [r.loss_token_count for r in rows] == [3 + 2 * mark, 0]
    assert L.sft_messages(df).where("row_index = 1").first().loss_token_count > 0


def test_mixed_types_in_one_pass(spark):
    rows = [(i, "1" if i < 7 else '"x"', "{}" if i != 4 else "[1]", "null" if i else "2") for i in range(10)]
    df = spark.createDataFrame(rows, "row_index long, a string, b string, c string")
    assert sorted(tuple(r) for r in M.mixed_types(df, ["a", "b", "c"]).collect()) == [("a", "BIGINT", 7), ("b", "OBJECT", 4)]


def test_manifest_reads_in_pieces_and_its_identity_is_a_tree(spark, tmp_path):
    """Files below, at and above the piece, one without a byte, which is not listed; the identity against a plain version of its definition."""
    import hashlib
    from collections import defaultdict

    contents = {"a": b"", "b": b"x" * 99, "c": b"y" * 100, "d": b"z" * 1001, "sub/e.gz": b"\x1f\x8b not really"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r.path.split(f"{tmp_path.name}/")[1]: (r.size, r.sha256) for r in files.build_manifest(spark, str(tmp_path), 100).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(f"p{i}", None if i == 7 else i, sha(str(i))) for i in range(3000)]
    lines = ["\t".join(str(x) for x in r if x is not None) for r in rows]
    groups = {sha(line): line for line in lines}
    level = [(k[:4], v) for k, v in groups.items()]
    for digits in (4, 2, 0):
        held = defaultdict(list)
        for at, line in level:
            held[at[:digits]].append(line)
        level = [(at, f"{at}\t" + sha("\n".join(sorted(held[at])))) for at in held]
    df = spark.createDataFrame(rows, "path string, size long, sha256 string")
    for dealt in (df, df.orderBy(F.desc("path")).repartition(7)):
        assert tuple(files.content_identity(dealt).first()) == (level[0][1][1:], 3000)
    assert tuple(files.content_identity(df.limit(0)).first()) == (sha(""), 0)
