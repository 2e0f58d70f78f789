"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

The documents are encoded once, on the executors; only (length, count) pairs are shuffled, summed before
the shuffle. Suffix sums run in two levels (within a block of lengths, then over the few blocks), so no
task sorts the whole histogram. Lengths are by the vocabulary's file of ranks, which encodes as its file of merges
does (tested); very long texts are encoded whole. Null texts count as empty (length 0); repeated rows count each time; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.llm import vocab
from lengthlab.llm.common import materialise, read, text_or_empty

#: Lengths of one block of the two-level sums.
BLOCK = 256


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (n_tokens) per document."""
    file = vocabulary or vocab.path("byte_bpe_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocab.byte_encoder(file).encode_ordinary
        for batch in batches:
            lengths = [len(tokens(text)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["n_tokens"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(encode, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct length: its documents and tokens, and what lies at or below and above it.

    Columns: n_tokens, n_docs, n_tokens_here, docs_le, tokens_le, docs_gt, tokens_gt, total_docs,
    total_tokens, truncated_tokens (tokens left when each document is cut at n_tokens).
    """
    # Both levels read these counts; written once, the texts are encoded once.
    counts = materialise(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("n_tokens_here", F.col("n_tokens") * F.col("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(
        F.sum("n_docs").alias("block_docs"), F.sum("n_tokens_here").alias("block_tokens")
    )
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("total_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "n_tokens_here",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_gt"),
        (F.col("tokens_above") + F.coalesce(F.sum("n_tokens_here").over(inside), F.lit(0))).alias("tokens_gt"),
        "total_docs",
        "total_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "n_tokens_here",
        (F.col("total_docs") - F.col("docs_gt")).alias("docs_le"),
        (F.col("total_tokens") - F.col("tokens_gt")).alias("tokens_le"),
        "docs_gt",
        "tokens_gt",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_gt") + F.col("n_tokens") * F.col("docs_gt")).alias("truncated_tokens"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """Total, kept and cut documents and tokens for one context limit, which need not be an observed length."""
    below = F.col("n_tokens") <= limit
    return histogram.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.when(below, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum("n_tokens_here"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
    )


def quantile(histogram: DataFrame, percent: int) -> DataFrame:
    """The observed length at rank max(1, ceil(percent * n / 100)), one row; null for an empty histogram."""
    rank = F.greatest(F.lit(1), F.expr(f"({percent} * total_docs + 99) div 100"))
    return histogram.agg(F.min(F.when(F.col("docs_le") >= rank, F.col("n_tokens"))).alias("n_tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(read(spark, sf_dir, "documents")))
