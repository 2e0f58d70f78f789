"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are cut into two halves, and each half is quantised with its own k-means codebook, trained in numpy
on a bounded sample of SAMPLE vectors. A vector lies in the cell (first code, second code). For a query the
inner products of its halves with both codebooks add up to a cell's score, so the best cells come in order
from a heap over two sorted lists. A query visits cells until they hold a share of all vectors that the
sample showed to be enough for TARGET recall (and FIRST vectors at least); this budget grows with the table
and caps no cell. All vectors are indexed.

Cells in the order of their codes are packed into blocks of about as many vectors each; a large cell is split by
a hash. The block is the key of the join, so the number of keys grows with the table, and a block is read by
one task with chunks of the queries that visit it; a query's vector travels once for each block it visits, with
one bit per cell. A block passes on only what reaches the query's floor, k entries per query at most. The first floor is
the k-th best of the guides, a part of the sample, that lie in cells which the query visits; they only set the floor, and
what is found comes from the blocks. Where guides are few for the table, the best cells are probed first and each round
visits WIDER times as many vectors as the one before, whose k-th best is the next floor. So about WIDER * k entries per
query and round are passed on, whatever the number of blocks. Floors are scores with ids, so copies do not pass by ties.
Scores are summed in double precision from the original vectors.

What a query visits is a share of the table, so the scores computed grow with queries times vectors. On vectors
without structure the share that TARGET needs lies above one half, whatever the index; on clustered ones it is small.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
nor do rows without an id. Of several vectors with one id the least counts. Ties go to the smaller id. With
fewer than k other vectors all are returned. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.llm.common import materialise, read

SAMPLE = 20_000
SAMPLE_QUERIES = 200
TARGET = 0.94
FIRST = 200
#: A round visits so many times the vectors that set its floor; guides are one vector in so many, and of this size in bytes at most.
WIDER, GUIDE_BYTES = 8, 1 << 23
#: Vectors of a block: a part of the table between these bounds.
BLOCK, LARGE_BLOCK, BLOCKS = 1024, 8192, 256
#: Queries that are held against a block at a time, and of these against all its vectors at once.
CHUNK, STEP = 256, 32
ROUNDS = 12
#: Vectors per cell aimed at, and the largest codebook, which the sample must be able to fill; the driver holds a number per cell.
PER_CELL = 16
MOST_CODES = 1024
#: Stands for no id where a floor has none.
LAST = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, one per id; single precision stays as it is stored."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.coalesce(F.forall(F.col("v"), lambda x: x.isNotNull()), F.lit(False))
    )
    rows = rows.where(
        F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows
    rows = rows.where(F.size("v") == sizes.n)
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from k spread-out points; an empty cluster keeps its centre."""
    points = points.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        sizes = np.bincount(of, minlength=k)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(axis=1) / 2
    return np.concatenate(
        [np.argmax(points[a : a + 4096] @ centres.T - norms, axis=1) for a in range(0, max(1, len(points)), 4096)]
    )


def cells_in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """All (i, j) by falling first[i] + second[j]: a heap over the two lists in falling order."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[one], second[two]
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


@dataclass
class Codebooks:
    """Both codebooks, the share of vectors to visit, how many vectors each cell holds, and the blocks of cells.

    Cells are numbered row by row. Cell c lies in the blocks block[c] to block[c] + splits[c] - 1, and `low` is the first
    cell of each block.
    """

    first: np.ndarray
    second: np.ndarray
    share: float
    sizes: np.ndarray | None = None
    block: np.ndarray | None = None
    splits: np.ndarray | None = None
    low: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.half], self.first) * len(self.second) + nearest(vectors[:, self.half :], self.second)

    def order(self, query: np.ndarray) -> Iterator[int]:
        n = len(self.second)
        return (i * n + j for i, j in cells_in_order(self.first @ query[: self.half], self.second @ query[self.half :]))

    def lay_out(self, sizes: np.ndarray) -> None:
        """Blocks of whole cells up to about the block size; a larger cell fills blocks of its own."""
        most = int(np.clip(sizes.sum() // BLOCKS, BLOCK, LARGE_BLOCK))
        self.sizes, self.splits = sizes, np.maximum(1, -(-sizes // most))
        self.block, self.low = np.zeros(len(sizes), np.int64), []
        held = most + 1  # so that the first cell opens a block
        for cell, (size, splits) in enumerate(zip(sizes.tolist(), self.splits.tolist())):
            if held + size > most:
                self.block[cell] = len(self.low)
                self.low += [cell] * splits
                held = most + 1 if splits > 1 else size
            else:
                self.block[cell] = len(self.low) - 1
                held += size
        self.low = np.array(self.low, np.int64)


def train(sample: np.ndarray, total: int, k: int, target: float = TARGET) -> Codebooks:
    """Codebooks from the sample, and the share of it that queries drawn from it must visit."""
    codes = int(np.clip(np.sqrt(total / PER_CELL), 2, min(MOST_CODES, max(2, len(sample) // PER_CELL))))
    codes = min(codes, len(sample))
    half = sample.shape[1] // 2
    books = Codebooks(k_means(sample[:, :half], codes), k_means(sample[:, half:], codes), 1.0)
    cells = books.cells(sample)
    sizes = np.bincount(cells, minlength=codes * codes).tolist()
    needed = []
    for q in range(min(SAMPLE_QUERIES, len(sample))):
        score = sample @ sample[q]
        score[q] = -np.inf
        best = np.argsort(-score)[: min(k, len(sample) - 1)]
        place = np.empty(codes * codes, np.int64)
        seen = 0
        for cell in books.order(sample[q]):
            seen += sizes[cell]
            place[cell] = seen
        needed += (place[cells[best]] / len(sample)).tolist()
    books.share = float(min(1.0, 1.1 * np.quantile(needed, target))) if needed else 1.0
    return books


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sampled(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about SAMPLE rows in the order of a hash of their ids; few more than these leave the executors."""
    among = 1 << 20
    below = min(among, int(1.3 * SAMPLE / max(1, total) * among) + 1)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(among)) < below) if total > 2 * SAMPLE else rows
    table = drawn.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((1, 2))
    return table.column("id").to_numpy(), _vectors(table.column("v").combine_chunks())


def _slack(score: np.ndarray) -> np.ndarray:
    """What a product of matrices may differ by from the exact sum."""
    return 1e-9 * (1 + np.abs(np.where(np.isfinite(score), score, 0)))


def _exact(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (q * e).sum(axis=1)  # the same order of sums for equal vectors anywhere


@dataclass
class Guides:
    """Vectors of the table with their ids and cells, by which a query knows a floor of its k-th best before it visits a block."""

    ids: np.ndarray
    vectors: np.ndarray
    cells: np.ndarray

    def floor(self, query_id: int, query: np.ndarray, visited: np.ndarray, k: int) -> tuple[float, int]:
        """Score and id of the k-th best guide in the visited cells (a flag per cell)."""
        at = np.flatnonzero(visited[self.cells] & (self.ids != query_id))
        if len(at) < k:
            return -np.inf, LAST
        score = self.vectors[at] @ query
        least = np.partition(score, len(at) - k)[len(at) - k]
        at = at[score >= least - _slack(least)]
        exact = _exact(np.broadcast_to(query, (len(at), len(query))), self.vectors[at])
        kth = np.lexsort((self.ids[at], -exact))[k - 1]
        return float(exact[kth]), int(self.ids[at[kth]])


def reaches(guides: int, total: int, most: int) -> list[int]:
    """How many vectors a query has visited at the end of each round."""
    out, reach = [], max(FIRST, WIDER * guides * most // max(1, total))
    while reach < most:
        out.append(reach)
        reach *= WIDER
    return [*out, most]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; is_query is a condition on the column id."""
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["v"].dataType.simpleString()
    total = rows.count()
    sample_ids, sample = _sampled(rows, total)
    books = train(sample, total, k, target)
    codes = len(books.first)
    few = min(len(sample_ids), -(-total // WIDER), GUIDE_BYTES // (8 * sample.shape[1]))
    guides = Guides(sample_ids[:few], sample[:few], books.cells(sample[:few]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pa.array(books.cells(_vectors(batch.column("v"))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), cells], names=["id", "v", "cell"])

    placed = materialise(rows.mapInArrow(place, f"id long, v {kind}, cell int"), "placed")
    counts = placed.groupBy("cell").count().collect()  # codes squared rows at most
    sizes = np.zeros(codes * codes, np.int64)
    for r in counts:
        sizes[r.cell] = r["count"]
    books.lay_out(sizes)
    shared = placed.sparkSession.sparkContext.broadcast(books)
    guiding = placed.sparkSession.sparkContext.broadcast(guides)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the block of each vector."""
        own = shared.value
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = own.block[cell] + (mixed % own.splits[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["id", "v", "cell", "block"])

    dealt = placed.mapInArrow(deal, f"id long, v {kind}, cell int, block long")
    blocks = materialise(dealt.groupBy("block").agg(F.collect_list(F.struct("id", "cell", "v")).alias("entries")), "blocks")

    queries = placed.where(is_query).select("id", "v")
    chunks = max(1, -(-queries.count() // CHUNK))
    most = max(FIRST, int(np.ceil(books.share * total)))
    ends = reaches(few, total, most)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and block the cells to visit as bits, apart for each round, with the floor that the guides set."""
        own, guide = shared.value, guiding.value
        each = own.sizes.tolist()
        visited = np.zeros(len(each), bool)
        for batch in batches:
            out: list[tuple] = []
            floors: list[tuple[float, int]] = []
            for row, (query_id, query) in enumerate(zip(batch.column("id").to_pylist(), _vectors(batch.column("v")))):
                seen, cells, before = 0, [], []
                for cell in own.order(query):
                    if seen >= most:
                        break
                    if each[cell]:
                        cells.append(cell)
                        before.append(seen)
                        seen += each[cell]
                visited[cells] = True
                floors.append(guide.floor(query_id, query, visited, k))
                visited[cells] = False
                rounds = np.searchsorted(ends, before, side="right")
                for probe in range(len(ends)):
                    part = np.sort(np.array(cells, np.int64)[rounds == probe])
                    starts = np.flatnonzero(np.diff(own.block[part], prepend=-1))
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                        cell = part[a]
                        block, low = int(own.block[cell]), int(own.low[own.block[cell]])
                        bits = np.zeros(int(part[b - 1]) - low + 1, bool)
                        bits[part[a:b] - low] = True
                        packed = np.packbits(bits).tobytes()
                        out += [(row, probe, block + s, packed) for s in range(int(own.splits[cell]))]
            if out:
                at, probe, block, bits = zip(*out)
                at = pa.array(at)
                arrays = [batch.column("id").take(at), batch.column("v").take(at), pa.array(probe, pa.int32())]
                arrays += [pa.array(block, pa.int64()), pa.array(bits, pa.binary())]
                score, least = zip(*floors)
                arrays += [pa.array(score, pa.float64()).take(at), pa.array(least, pa.int64()).take(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "q", "probe", "block", "bits", "floor", "floor_id"])

    # Queries are few for their work, so they are dealt out over all tasks.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = f"query_id long, q {kind}, probe int, block long, bits binary, floor double, floor_id long"
    visits = queries.repartition(tasks).mapInArrow(visit, kinds)
    visits = materialise(visits, "visits")
    names = ["query_id", "vec_id", "score"]

    def best_of(own: np.ndarray, q: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, visited: np.ndarray, ids: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        """The k best entries of each query, ties by id; an entry must reach the query's floor."""
        score = np.where(visited, q @ e.T, -np.inf)
        least = floor
        if score.shape[1] > k:
            least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(visited & (score >= (least - _slack(least))[:, None]))
        exact = _exact(q[row], e[col])
        behind = (exact == floor[row]) & (ids[col] > floor_id[row])
        row, col, exact = row[~behind], col[~behind], exact[~behind]
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, exact = row[nth < k], col[nth < k], exact[nth < k]
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[col]), pa.array(exact)], names=names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = shared.value.low
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                low = lows[batch.column("block")[0].as_py()]
                entries, asked = batch.column("entries").flatten(), batch.column("asked").flatten()
                ids, e = entries.field("id").to_numpy(), _vectors(entries.field("v"))
                cell = entries.field("cell").to_numpy() - low
                own, q = asked.field("query_id").to_numpy(), _vectors(asked.field("q"))
                floor, bits = asked.field("floor").to_numpy(), asked.field("bits").to_pylist()
                floor_id = asked.field("floor_id").to_numpy()
                width = int(cell.max()) // 8 + 1
                for a in range(0, len(own), STEP):
                    part = slice(a, a + STEP)
                    flat = np.frombuffer(b"".join([b[:width].ljust(width, b"\0") for b in bits[part]]), np.uint8)
                    visited = np.unpackbits(flat.reshape(-1, width), axis=1)[:, cell].astype(bool)
                    others = visited & (own[part, None] != ids[None, :])
                    yield best_of(own[part], q[part], floor[part], floor_id[part], others, ids, e)

    def probed(asked: DataFrame) -> DataFrame:
        """The best of each asked row's cells; rows: query_id, q, block, bits, floor, floor_id."""
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
        packed = asked.groupBy("block", chunk.alias("chunk")).agg(
            F.collect_list(F.struct("query_id", "q", "bits", "floor", "floor_id")).alias("asked")
        )
        joined = blocks.join(packed, "block").select("block", "entries", "asked")
        return joined.mapInArrow(probe, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = top(probed(visits.where("probe = 0")))
    for probe_round in range(1, len(ends)):
        found = materialise(found, f"found_{probe_round}")
        floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("at_least"), F.col("vec_id").alias("at_id"))
        asked = visits.where(F.col("probe") == probe_round).join(floors, "query_id", "left")
        better = F.expr("coalesce(at_least > floor or at_least = floor and at_id < floor_id, false)")
        for name, other in (("floor_id", "at_id"), ("floor", "at_least")):
            asked = asked.withColumn(f"new_{name}", F.when(better, F.col(other)).otherwise(F.col(name)))
        asked = asked.select("query_id", "q", "block", "bits", F.col("new_floor").alias("floor"), F.col("new_floor_id").alias("floor_id"))
        found = top(found.select(*names).unionByName(probed(asked)))
    return found.select("query_id", "rank", "vec_id", "score")


def op2_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
