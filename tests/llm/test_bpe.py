import hashlib
import random
import time

import pytest
from tokenizers import Tokenizer

from lengthlab.llm import bpe, vocab


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab.path("word_bpe_49k.json"))


TEXTS = [
    "",
    " \n\t",
    "Hello, World!",
    "aaaa aaaaa aaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "don't we're I'll 'S 'RE it's",
    "É é é ß İ ı ΑΣ Σ ς straße ŉ ǆ",
    "日本語 テキスト 한국어 😀👍🏽 ‍ ﻿",
    "123 4567 ½ ² ٣",
    "<|startoftext|>Some <|endoftext|> text<|endoftext|>",
    "a b c\x1cd\x85e",
    "tab\tand\x0bvertical\x0cfeed\rreturn",
    "x" * 5000 + " " + "ab" * 3000,
    "#$%&### ... --- __init__ foo_bar",
]


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(decoded)


def test_texts_match_the_library(spark, library):
    rng = random.Random(4)
    letters = "abcdefghinorstu  éü'.,1<|>\n"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.digests(df).collect():
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected(library, texts[row.doc_id]), texts[row.doc_id][:80]


def test_real_texts_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in bpe.digests(docs).collect():
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected(library, texts[row.doc_id])


def test_ids_round_trip_and_small_memory(library):
    own = bpe.WordBpe(vocab.path("word_bpe_49k.json"))
    texts = [f"some words number {i} and unseen{i}" for i in range(50)]
    before, bpe.REMEMBERED = bpe.REMEMBERED, 20
    try:
        for text in texts:
            (words,) = own.encode_all([text])
            ids = [int(i) for _, joined, _ in words for i in joined.split(" ")]
            assert ids == library.encode(text, add_special_tokens=False).ids
    finally:
        bpe.REMEMBERED = before


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", None), (1, None, "x")], "doc_id long, text string, ids string")
    out = bpe.digests(df).collect()
    assert len(out) == 3 and sum(r.n_tokens for r in out) == 2
    assert [r.ids for r in bpe.encoded(df).where("doc_id is null").collect()][0] is not None
    assert bpe.digests(df.limit(0)).count() == 0


def test_nul_and_control_characters_match_the_library(spark, library):
    texts = ["a\0b", "\0", "\0\0#x \0", "\0<|endoftext|>\0", "<|endoftext|> \0<|startoftext|>", "\x01\x02a\x7f\x9f \x1b[0m"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.digests(df).collect():
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == expected(library, texts[row.doc_id]), repr(texts[row.doc_id])


def test_both_ways_of_merging_agree(library):
    """Words on either side of LONG, alone and together, with runs of one letter and repeats of a few."""
    own, rng = bpe.WordBpe(vocab.path("word_bpe_49k.json")), random.Random(9)
    kinds = ("a", "ab", "abc", "eins", "abcdefghijklmnopqrstuvwxyz", "éüßa")
    words = ["".join(rng.choice(kind) for _ in range(rng.choice((1, 2, 3, 40, 255, 256, 257, 700)))) for kind in kinds for _ in range(12)]
    coded = [w.encode() for w in words]
    ids, bounds = own.merged(coded)
    long_ids, long_bounds = own.merged_long(coded)
    assert bounds.tolist() == long_bounds.tolist() and ids.tolist() == long_ids.tolist()
    for word, one in zip(words, coded):
        assert own.merged_long([one])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_one_very_long_word_takes_linear_time(library):
    own, rng = bpe.WordBpe(vocab.path("word_bpe_49k.json")), random.Random(10)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "x"):
        word = "".join(rng.choice(letters) for _ in range(200_000))
        began = time.monotonic()
        (pieces,) = own.encode_all([word])
        assert time.monotonic() - began < 30
        assert [int(i) for _, joined, _ in pieces for i in joined.split(" ")] == library.encode(word, add_special_tokens=False).ids
