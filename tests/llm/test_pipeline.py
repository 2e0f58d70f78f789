"""Every stage of the pipeline against a plain version over its own input, on a small table."""

import hashlib

import corpus_pipeline
from lengthlab.llm import pii, quality
from tests.llm.test_packing import verify
from tests.llm.test_pii import base, expected
from tests.llm.test_quality import plain
from tests.llm.test_simhash import five_word_groups
from tests.llm.test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (given, docs.collect())
        if name != "packing":
            assert docs.columns == columns

    given, left = seen["quality rules"]
    verdict = {r.doc_id: r for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {r.doc_id for r in left} == {i for i, r in verdict.items() if r.kept}
    for r in left:
        words, _, _, _, repeated = plain(r.text)
        assert words >= 50 and 100 * repeated <= 50 * words and r == given[r.doc_id]

    given, left = seen["near-dedup"]
    ids = sorted(given)
    least = five_word_groups([given[i].text for i in ids])
    assert {r.doc_id for r in left} == {ids[k] for k, group in enumerate(least) if group == k}

    given, left = seen["repeated passages"]
    wanted = {row[0]: row for row in brute(sorted((i, r.text) for i, r in given.items()))}
    for r in left:
        _, size, removed, _, digest = wanted[r.doc_id]
        data = r.text.encode()
        assert r.n_chars == len(r.text)
        if len(data) == size - removed:  # no character was cut in two
            assert hashlib.sha256(data).hexdigest() == digest
        else:
            assert size - removed - len(data) <= 6 * wanted[r.doc_id][3]

    given, left = seen["personal data"]
    assert {r.doc_id for r in left} == set(given)
    ids = sorted(given)
    spans = dict(zip(ids, (s for _, s in expected([given[i].text for i in ids]))))
    for r in left:
        at, clean, text = 0, "", given[r.doc_id].text
        for kind, s, e in (x.split(":") for x in filter(None, spans[r.doc_id].split(","))):
            if int(s) >= at:
                clean += text[at : int(s)] + f"[{kind.upper()}]"
            at = max(at, int(e))
        assert r.text == clean + text[at:] and r.n_chars == len(r.text) and not base(r.text)

    given, pieces = seen["packing"]
    verify(pieces, [(i, r.text) for i, r in given.items()])
    assert pii.KINDS[4] == "term"


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, rid int, spans string, component string, key int, q int"


def odd_rows():
    base = " ".join(f"the word{i} of item{i} and" for i in range(40))
    other = " ".join(f"is thing{i} in part{i} that" for i in range(40))
    rows = [(1, base), (1, base), (None, base), (2, None), (3, ""), (None, None), (4, other), (5, other.upper()), (6, "short"), (6, "short")]
    rows += [(7, base + " mail ann@corp.example.org or +49 30 1234567"), (8, "\0 \t é😀 " * 60), (9, "long text " * 30_000), (10, other + " \n" + base)]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "x", k, "y", "z", k, 1) for k, (i, t) in enumerate(rows)]


def test_every_stage_bears_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, empty and very long texts, clashing names; and no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame(odd_rows(), ODD)
        out = stage(spark, given, SF)
        if name == "packing":
            assert out.selectExpr("sum(length)").first()[0] == out.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
        else:
            assert out.columns == given.columns
            rows = out.collect()
            texts = [r.text for r in rows]
            if name == "quality rules":
                assert all(t and len(t.split()) >= 50 for t in texts) and {1, 10} <= {r.doc_id for r in rows}
            elif name == "near-dedup":
                assert sorted((str(r.doc_id) for r in rows)) == ["1", "10", "2", "4", "6", "8", "9"]  # 7 is a near copy of 1
            else:
                assert len(rows) == len(given.collect()) and texts.count(None) == 2
        assert stage(spark, given.limit(0), SF).count() == 0

