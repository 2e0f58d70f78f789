import random

from tokenizers import Tokenizer

from lengthlab.llm import token_counts, vocab


def lengths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "n_tokens long")


def test_histogram_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    wanted = [len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.select("text").collect()]
    rows = token_counts.op1_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(wanted))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.n_tokens_here) == (wanted.count(n), n * wanted.count(n))
        assert (r.docs_le, r.docs_gt) == (sum(x <= n for x in wanted), sum(x > n for x in wanted))
        assert (r.tokens_le, r.tokens_gt) == (sum(x for x in wanted if x <= n), sum(x for x in wanted if x > n))
        assert (r.total_docs, r.total_tokens, r.truncated_tokens) == (len(wanted), sum(wanted), sum(min(x, n) for x in wanted))


def test_limits_and_quantiles(spark):
    values = [0, 3, 3, 10, 255, 256, 257, 5000]
    histogram = token_counts.length_histogram(lengths(spark, values)).cache()
    for limit in (0, 1, 3, 100, 256, 4999, 9000):
        row = token_counts.at_limit(histogram, limit).first()
        assert (row.docs_within, row.docs_cut) == (sum(v <= limit for v in values), sum(v > limit for v in values))
        assert (row.total_tokens, row.truncated_tokens) == (sum(values), sum(min(v, limit) for v in values))
    for percent, wanted in ((0, 0), (1, 0), (50, 10), (90, 5000), (100, 5000)):
        assert token_counts.quantile(histogram, percent).first().n_tokens == wanted


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a b", 3), ("a b", 3), ("x " * 40000, 4)], "text string, n_tokens int")
    rows = {r.n_tokens: r.n_docs for r in token_counts.length_histogram(token_counts.encoded_lengths(df)).collect()}
    assert rows[0] == 2 and rows[2] == 2 and sum(rows.values()) == 5
    empty = token_counts.length_histogram(token_counts.encoded_lengths(df.limit(0)))
    assert empty.count() == 0 and token_counts.quantile(empty, 50).first().n_tokens is None


def test_ranks_encode_as_the_merges_do():
    rng = random.Random(11)
    encode = vocab.byte_encoder(vocab.path("byte_bpe_50k.tiktoken")).encode_ordinary
    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = ["a", "The", " the", "'s", "'LL", " ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "1", "12345", "é", "e\u0301", "日本", "😀", "\0", "!?", "...", "<|endoftext|>", "\u200b", "ß", "ǅ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, text
