"""Lines of files of several members, for ranges of any size."""

import io
import random

import pyarrow as pa
import pytest

from lengthlab.plans.reading import _coded
from lengthlab.sources import arrow, members


def made_up(rng, kind):
    """A file of members that end anywhere, with bytes that look like beginnings, and its lines."""
    text = b"first " + b"".join(rng.choice([b"a", b"\n", b"\n\n", b"word " * 20, rng.randbytes(60).replace(b"\n", b""), *members.MAGIC.values()]) for _ in range(400))
    data, at = b"", 0
    while at < len(text):
        n = rng.choice([1, 40, 500, 4000])
        data += _coded(kind, text[at : at + n])
        if kind == "zstd" and rng.random() < 0.2:
            data += (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
        at += n
    return data, text.removesuffix(b"\n").split(b"\n") if text.endswith(b"\n") else text.split(b"\n")


@pytest.mark.parametrize("kind", ["gzip", "bz2", "xz", "zstd", "lz4", "plain"])
def test_ranges_give_every_line_once(kind):
    rng = random.Random(kind)
    for _ in range(4):
        data, wanted = made_up(rng, kind)
        assert list(members.lines(io.BytesIO(data), len(data))) == wanted
        for step in (37, 400, 2500):
            found = []
            for start in range(0, len(data), step):
                found += members.lines(io.BytesIO(data), len(data), start, min(len(data), start + step))
            assert found == wanted


def test_cut_and_columnar_files_are_errors():
    data = _coded("gzip", b"x\n" * 1000)
    with pytest.raises(EOFError):
        list(members.lines(io.BytesIO(data[:-9]), len(data) - 9))
    with pytest.raises(ValueError, match="columnar"):
        list(members.lines(io.BytesIO(b"PAR1xx"), 6))
    assert list(members.lines(io.BytesIO(b""), 0)) == []


def test_bad_bytes_are_failed_rows(spark, tmp_path):
    (tmp_path / "a.zst").write_bytes(_coded("zstd", b"one\n\xff\xfe\nth") + _coded("zstd", b"ree\n"))
    wanted = [(1, "one", None), (2, None, "invalid_utf8"), (3, "three", None)]
    for rows in (arrow.scan_compressed_text(spark, str(tmp_path)), arrow.scan_text_files(spark, [str(tmp_path / "a.zst")], split=20)):
        assert sorted((r.line, r.value, r.error_code) for r in rows.collect()) == wanted


def test_arrow_files_are_read_by_batch_and_column(spark, tmp_path):
    batches = [pa.RecordBatch.from_pydict({"a": [i, i], "b": [f"x{i}", None], "c": [1.0, 2.0]}) for i in range(5)]
    for name, form in (("f.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with form(str(tmp_path / name), batches[0].schema) as writer:
            for batch in batches:
                writer.write_batch(batch)
    rows = arrow.scan_arrow_files(spark, [str(tmp_path / "f.arrow"), str(tmp_path / "s.arrow")], "b string, a long")
    assert rows.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(b, i) for i in range(5) for b in (f"x{i}", None)] * 2, key=str)
