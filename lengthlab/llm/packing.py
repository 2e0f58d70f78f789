"""Packing documents into fixed-length sequences in the order of a space-filling curve.

Each text is encoded once; its ids, an end id after them, and a document vector (the mean of fixed
pseudo-random vectors, one per id: a hashed bag of tokens projected to DIMENSIONS) are written to the shared
folder. The vectors, standardised over the corpus, give each document a place on a Hilbert curve, so that
similar documents are neighbours. A range sort by (curve key, row) deals the order out over partitions;
running token sums within partitions plus the prefix sums of the few partition totals give every document
its place in one long stream, which is cut at multiples of the sequence length. Only the last sequence is
shorter, so padding is less than one sequence in all. Documents are cut where a sequence ends; the pieces of
a document lie in consecutive sequences. No task sees more than its own rows; ids move once, by row number.

Ids come from the vocabulary's file of ranks, which encodes as its file of merges does (tested). Null text counts as
empty (the end id alone). Documents with equal curve keys follow each other by row. A very long text is encoded whole
and lies in as many sequences as it needs. Repeated rows are packed as often as they occur. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.llm import vocab
from lengthlab.llm.common import materialise, read, slices, text_or_empty

SEQUENCE = 1024
END_ID = 0
DIMENSIONS = 3
#: Bits of each coordinate on the curve.
BITS = 16


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of non-negative integer coordinates (n, dimensions).

    The transposed form of the index: undo the rotations from the highest bit down, Gray-encode across the
    coordinates, then interleave their bits.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (((x[i] ^ flip) >> b) & 1)
    return key


@lru_cache(maxsize=1)
def directions(size: int) -> np.ndarray:
    """One fixed pseudo-random vector per token id."""
    return np.random.default_rng(1024).standard_normal((size, DIMENSIONS)).astype(np.float32)


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(doc_id, n, ids, x0, x1, ...): ids as little-endian 16- or 32-bit numbers, and the document vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.byte_encoder(vocabulary)
        table = directions(encoder.n_vocab)
        kind = "<u2" if encoder.n_vocab <= 1 << 16 else "<u4"
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                every = []
                for text in batch.column("text").to_pylist():
                    if vocab.END_OF_TEXT in text:
                        ids = encoder.encode(text, allowed_special="all")
                    else:
                        ids = encoder.encode_ordinary(text)
                    ids.append(END_ID)
                    every.append(np.array(ids, kind))
                sizes = np.array(list(map(len, every)), np.int64)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                sums = np.add.reduceat(table[np.concatenate(every)], starts, axis=0, dtype=np.float64)
                middle = sums / sizes[:, None]
                arrays = [batch.column("doc_id"), pa.array(sizes), pa.array([i.tobytes() for i in every], pa.binary())]
                arrays += [pa.array(middle[:, d]) for d in range(DIMENSIONS)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "ids", *(f"x{d}" for d in range(DIMENSIONS))])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    coordinates = ", ".join(f"x{d} double" for d in range(DIMENSIONS))
    return chosen.mapInArrow(run, f"doc_id long, n long, ids binary, {coordinates}")


def curve_order(rows: DataFrame) -> DataFrame:
    """(rid, key, n) for rows (rid, n, x0, x1, ...): the Hilbert key of the standardised coordinates."""
    names = [f"x{d}" for d in range(DIMENSIONS)]
    # A few numbers, whatever the size of the table.
    stats = rows.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    centre = np.array([s or 0.0 for s in stats[:DIMENSIONS]])
    spread = np.array([s or 1.0 for s in stats[DIMENSIONS:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
                unit = 1 / (1 + np.exp(-1.702 * np.clip((x - centre) / spread, -9, 9)))  # close to the normal distribution
                cells = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                arrays = [batch.column("rid"), pa.array(hilbert_keys(cells, BITS)), batch.column("n")]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "key", "n"])

    return rows.select("rid", "n", *names).mapInArrow(run, "rid long, key long, n long")


def stream_offsets(order: DataFrame) -> DataFrame:
    """(rid, at): how many tokens come before each row in (key, rid) order."""
    parts = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = before + np.cumsum(batch.column("n").to_numpy())
            if len(ends):
                starts = np.concatenate(([before], ends[:-1]))
                before = int(ends[-1])
                arrays = [batch.column("rid"), pa.array(np.full(len(ends), part, np.int32)), pa.array(starts), batch.column("n")]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "part", "within", "n"])

    sorted_rows = order.repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid")
    local = materialise(sorted_rows.mapInArrow(run, "rid long, part int, within long, n long"), "order")
    totals = local.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))  # a row per partition
    return local.join(F.broadcast(totals), "part").select("rid", (F.col("base") + F.col("within")).alias("at"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    file = vocabulary or vocab.path("byte_bpe_50k.tiktoken")
    rows = encoded(docs, id_col, text_col, file).withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(rows, "encoded")
    places = stream_offsets(curve_order(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids", 1 << 23):
                out: list[tuple] = []
                columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")]
                for doc_id, n, data, at in zip(*columns):
                    ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, SEQUENCE)
                        length = min(n - start, SEQUENCE - offset)
                        out.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), n, sequence, offset))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    joined = rows.select("rid", "doc_id", "n", "ids").join(places, "rid").select("doc_id", "n", "ids", "at")
    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
