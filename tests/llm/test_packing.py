import zlib

import numpy as np
from tokenizers import Tokenizer

from lengthlab.llm import packing, vocab


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def verify(pieces, texts):
    """texts: list of (doc_id, text); every id in exactly one piece, sequences gapless and full but for the last."""
    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    wanted = sorted((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in texts)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, ids in wanted:
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) and all(p.doc_tokens == len(ids) for p in own)
        at = 0
        for p in own:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or s == len(sequences) - 1


def test_pieces_cover_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    verify(packing.packed(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "x" * 9000), (5, "é😀 \n\n  don't 日本 123"), (6, " word" * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, ids int")
    verify(packing.packed(df).collect(), texts)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other")], "doc_id long, text string")
    out = packing.packed(df).collect()
    assert sum(p.length for p in out) == sum(p.doc_tokens for p in out) and len(out) == 3
    assert packing.packed(df.limit(0)).count() == 0
