"""Removal of repeated passages by common-prefix intervals over an enhanced suffix array.

A byte is removed when a string of LENGTH bytes that covers it also starts earlier in the corpus. The
suffix array is sampled: of each run of LENGTH - ANCHOR + 1 consecutive ANCHOR-byte strings the one with the
least hash is an anchor (ties: all of them), so equal strings of LENGTH bytes hold an anchor at the same
place. Suffixes that start with the same anchor form one stretch of the suffix array, and stretches are
independent, so they are dealt out by the anchor's hash:

1. One row (hash, hash of the surroundings, document, position) per anchor. Under each hash, occurrences
   with equal surroundings (all windows that hold the anchor) differ only in order: every one but the first
   is covered whole. Only the first of each kind, and only under hashes with several kinds, goes on.
2. Those few get their surrounding bytes. Within a stretch the suffixes are sorted, common prefixes of
   neighbours computed, and a stack scan gives the intervals of suffixes that share a prefix, each with all
   its members. Members are then told apart by what stands to their left: a repeat is as long as the
   interval's prefix plus the left extension that members share, and where the extension stops, members
   differ on the left, so the group is maximal. Every member but the earliest of its group is covered.
3. Stretches with more than MOST_SUFFIXES suffixes are never dealt to one task; their windows are hashed one by
   one and compared by a shuffle, which gives the same bytes. Only the least place of each window is gathered,
   by partial minima, so a window that stands very often is no heavy key.

Matches never cross documents. Documents are ordered by doc_id (null first; rows with the same doc_id by
their text, and of equal rows one counts as the first). Null text counts as empty. An empty table gives no
rows. Other columns are ignored by `removals` and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.llm.common import look_up, materialise, read, slices

LENGTH = 100
ANCHOR = 32
#: Offsets that an anchor can have in a window, less one: bytes to its left that matter.
LEFT = LENGTH - ANCHOR
#: Suffixes of one stretch that the stack scan takes.
MOST_SUFFIXES = 20_000
#: Suffixes that one round of the scan holds, unless one stretch is larger.
ROUND = 50_000
#: Bytes of text hashed at a time.
PIECE = 1 << 21
NULL_ID = -(1 << 63)

ODD = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for k in range(1, 8)]
NONE = np.uint64((1 << 64) - 1)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in `data` (uint8); document i is data[bounds[i]:bounds[i + 1]]."""
    n = len(data) - ANCHOR + 1
    if n < LEFT + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = words[:n] * ODD[0] + words[8 : n + 8] * ODD[1]
    h ^= h >> np.uint64(29)
    h = h * ODD[2] + words[16 : n + 16] * ODD[3]
    h ^= h >> np.uint64(32)
    h = h * ODD[4] + words[24 : n + 24] * ODD[5]
    h ^= h >> np.uint64(30)
    h *= ODD[6]
    whole = np.zeros(len(data) + 1, np.int32)  # 1 where an anchor may start
    long = np.diff(bounds) >= LENGTH
    np.add.at(whole, bounds[:-1][long], 1)
    np.add.at(whole, bounds[1:][long] - ANCHOR + 1, -1)
    valid = np.cumsum(whole)[:n] > 0
    h = np.where(valid, h, NONE)
    least = _sliding(h, LEFT + 1, np.minimum)
    edge = np.zeros(LEFT, np.uint64)
    reach = _sliding(np.concatenate((edge, least, edge)), LEFT + 1, np.maximum)
    at = np.flatnonzero(valid & (reach == h))
    return at, h[at]


def _document_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, position, hash) arrays for some documents at a time; a very long text is cut with overlap."""
    group: list[int] = []
    held = 0

    def together(members: list[int]):
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in members])))
        at, h = anchors(np.frombuffer(b"".join([texts[i] for i in members]), np.uint8), bounds)
        of = np.searchsorted(bounds, at, side="right") - 1
        return np.asarray(members)[of], at - bounds[of], h

    for i, text in enumerate(texts):
        if len(text) > 2 * PIECE:
            found = {}
            for start in range(0, len(text), PIECE):
                part = text[start : start + PIECE + LENGTH - 1]
                at, h = anchors(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
                found.update(zip((at + start).tolist(), h.tolist()))
            at = np.array(sorted(found), np.int64)
            yield np.full(len(at), i), at, np.array([found[x] for x in at.tolist()], np.uint64)
            continue
        if group and held + len(text) > PIECE:
            yield together(group)
            group, held = [], 0
        group.append(i)
        held += len(text)
    if group:
        yield together(group)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns did, ord, text and row (all input columns); (did, ord) names one row and orders the corpus."""
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    if df.groupBy("did").count().where("count > 1").isEmpty():
        return df.withColumn("ord", F.lit(0))
    order = Window.partitionBy("did").orderBy(F.col(f"row.`{id_col}`").asc_nulls_first(), F.md5("text"), "text")
    return df.withColumn("ord", F.row_number().over(order))


def _settled(h: np.ndarray, c: np.ndarray, did: np.ndarray, ord_: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True for occurrences with an equal one (hash and surroundings) before them in the same batch."""
    order = np.lexsort((pos, ord_, did, c, h))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    return again


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, c, did, ord, pos, sure): every anchor with its hash and the hash of its surroundings.

    Repeats within a batch are settled before the shuffle (sure) and dealt out at random, so a line or a
    document that is copied very often does not gather in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = [t.encode("utf-8") for t in batch.column("text").to_pylist()]
            dids, ords = batch.column("did").to_numpy(), batch.column("ord").to_numpy()
            parts = []
            for of, at, h in _document_anchors(texts):
                around = (
                    digest(texts[i][max(0, p - LEFT) : p + LENGTH], seed=min(p, LEFT)) for i, p in zip(of.tolist(), at.tolist())
                )
                parts.append((h, np.fromiter(around, np.uint64, len(at)), dids[of], ords[of], at.astype(np.int32)))
            if not parts:
                continue
            h, c, did, ord_, pos = (np.concatenate(column) for column in zip(*parts))
            sure = _settled(h, c, did, ord_, pos)
            spread = (did.view(np.uint64) * ODD[0] + pos.astype(np.uint64)) * ODD[1]
            h = np.where(sure, spread ^ (spread >> np.uint64(31)), h)
            for start in range(0, len(h), 50_000):
                part = slice(start, start + 50_000)
                arrays = [h[part].view(np.int64), c[part].view(np.int64), did[part], ord_[part], pos[part], sure[part]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["h", "c", "did", "ord", "pos", "sure"])

    return docs.select("did", "ord", "text").mapInArrow(run, "h long, c long, did long, ord int, pos int, sure boolean")


def _marked(rows: DataFrame) -> DataFrame:
    """(h, did, ord, pos): covered whole where h is null, else in need of the scan."""
    order = Window.partitionBy("h", "sure").orderBy("c", "did", "ord", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = rows.select(
        "h",
        "c",
        "did",
        "ord",
        "pos",
        "sure",
        F.lag("c").over(order).alias("before"),
        F.first("c").over(whole).alias("first"),
        F.last("c").over(whole).alias("last"),
    )
    return df.where("sure or c = before or first <> last").select(
        F.when(~F.col("sure") & ~F.col("c").eqNullSafe(F.col("before")), F.col("h")).alias("h"), "did", "ord", "pos"
    )


def _surroundings(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(h, did, ord, pos, around): the bytes from LEFT before the anchor to LENGTH after its start."""
    wanted = marked.where("h is not null").groupBy("did", "ord").agg(F.collect_list(F.struct("pos", "h")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 * PIECE):
                texts = batch.column("text").to_pylist()
                lists = batch.column("at")
                inner = lists.flatten()
                pos, h = inner.field("pos").to_numpy(), inner.field("h").to_numpy()
                of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                encoded = [t.encode("utf-8") for t in texts]
                around = [encoded[i][max(0, p - LEFT) : p + LENGTH] for i, p in zip(of.tolist(), pos.tolist())]
                arrays = [h, batch.column("did").to_numpy()[of], batch.column("ord").to_numpy()[of], pos]
                arrays = [*map(pa.array, arrays), pa.array(around, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "did", "ord", "pos", "around"])

    joined = docs.select("did", "ord", "text").join(wanted, ["did", "ord"])
    return joined.mapInArrow(run, "h long, did long, ord int, pos int, around binary")


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of `width` bytes, zeros at the end, and their lengths."""
    flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)
    return flat, np.fromiter(map(len, parts), np.int64, len(parts))


def _common(matrix: np.ndarray, lengths: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows one[i] and other[i]."""
    differ = matrix[one] != matrix[other]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return np.minimum(first, np.minimum(lengths[one], lengths[other]))


def _sorted(matrix: np.ndarray, lengths: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The rows `among` in the order of their strings."""
    by_length = among[np.argsort(lengths[among], kind="stable")]
    text = np.ascontiguousarray(matrix[by_length]).view(f"S{matrix.shape[1]}").ravel()
    return by_length[np.argsort(text, kind="stable")]


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every common-prefix interval of depth `least` or more.

    lcp[i] is the common prefix of sorted suffixes i - 1 and i. The stack holds the open intervals; one
    closes when a shorter common prefix follows, and is given with all its members.
    """
    stack: list[tuple[int, int]] = []  # (first member, depth)
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, closed = stack.pop()
            if closed >= least:
                yield first, i - 1, closed
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def left_extensions(order: list[int], common: list[int]) -> list[int]:
    """For members sorted by what precedes them: the longest left extension each shares with an earlier one.

    order[i] is member i's place in the corpus, common[i] the shared extension of members i - 1 and i. A
    member earlier than all others gets -1. The nearest earlier member on either side shares most.
    """
    found = [-1] * len(order)
    for step in (1, -1):
        stack: list[tuple[int, int]] = []  # (place, extension shared with what came before it on the stack)
        places = range(len(order)) if step == 1 else range(len(order) - 1, -1, -1)
        gap = LEFT
        for i in places:
            if stack:
                gap = common[i] if step == 1 else common[i + 1]
            while stack and stack[-1][0] > order[i]:
                gap = min(gap, stack.pop()[1])
            if stack:
                found[i] = max(found[i], gap)
            stack.append((order[i], gap))
    return found


def scan(hashes: np.ndarray, rank: np.ndarray, around: list[bytes], before: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, left, right): the bytes around row's anchor that an earlier occurrence also has.

    Rows are grouped by hash; rank orders them in the corpus; before[i] is the anchor's offset in around[i].
    """
    right, right_len = _matrix([a[b:] for a, b in zip(around, before.tolist())], LENGTH)
    left, left_len = _matrix([a[:b][::-1] for a, b in zip(around, before.tolist())], LEFT)
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
    # All that is covered around one anchor holds the anchor, so the union reaches as far as the farthest on each side.
    before_it, after_it = [-1] * len(around), [-1] * len(around)
    pair = starts[:-1][np.diff(starts) == 2]
    if len(pair):
        d, e = _common(right, right_len, pair, pair + 1), _common(left, left_len, pair, pair + 1)
        later = np.where(rank[pair] < rank[pair + 1], pair + 1, pair)
        hit = (d + e >= LENGTH) & (d >= ANCHOR)
        for row, extension, depth in zip(later[hit].tolist(), e[hit].tolist(), d[hit].tolist()):
            before_it[row], after_it[row] = extension, depth
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a < 3:
            continue
        suffixes = _sorted(right, right_len, np.arange(a, b))
        lcp = [0, *_common(right, right_len, suffixes[:-1], suffixes[1:]).tolist()]
        for first, last, depth in intervals(lcp, ANCHOR):
            members = _sorted(left, left_len, suffixes[first : last + 1])
            shared = [0, *_common(left, left_len, members[:-1], members[1:]).tolist()]
            for row, extension in zip(members.tolist(), left_extensions(rank[members].tolist(), shared)):
                if extension + depth >= LENGTH:
                    before_it[row] = max(before_it[row], extension)
                    after_it[row] = max(after_it[row], depth)
    return [(row, e, d) for row, (e, d) in enumerate(zip(before_it, after_it)) if d >= 0]


def _scanned(rows: DataFrame) -> DataFrame:
    """(did, ord, start, stop): covered bytes; rows: suffixes of stretches that one task can hold."""

    def tell(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table.column(c).to_numpy() for c in ("h", "did", "ord", "pos")]
        h, did, ord_, pos = columns
        place = np.lexsort((pos, ord_, did))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        found = scan(h, rank, table.column("around").to_pylist(), np.minimum(pos, LEFT).astype(np.int64))
        if found:
            row, left, right = (np.array(x, np.int64) for x in zip(*found))
            arrays = [did[row], ord_[row], (pos[row] - left).astype(np.int32), (pos[row] + right).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["did", "ord", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows >= ROUND:
                h = held.column("h").to_numpy()
                last = len(h) - int(np.argmax(h[::-1] != h[-1])) if (h != h[-1]).any() else 0  # the last stretch may go on
                if last:
                    yield from tell(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from tell(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "h").sortWithinPartitions("h", "did", "ord", "pos")
    return dealt.select("h", "did", "ord", "pos", "around").mapInArrow(run, "did long, ord int, start int, stop int")


def _windows(rows: DataFrame) -> DataFrame:
    """(did, ord, start, stop) of windows that also start earlier, for suffixes of large stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                did, ord_, pos = (batch.column(c).to_numpy() for c in ("did", "ord", "pos"))
                first = np.maximum(pos - LEFT, 0)
                keys, of, at = [], [], []
                for i, around in enumerate(batch.column("around").to_pylist()):
                    for offset in range(len(around) - LENGTH + 1):
                        keys.append(xxhash.xxh3_128_digest(around[offset : offset + LENGTH]))
                        of.append(i)
                        at.append(int(first[i]) + offset)
                arrays = [pa.array(keys, pa.binary()), pa.array(did[of]), pa.array(ord_[of]), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["window", "did", "ord", "start"])

    each = rows.select("did", "ord", "pos", "around").mapInArrow(run, "window binary, did long, ord int, start int")
    each = materialise(each.distinct(), "windows")
    first = each.groupBy("window").agg(F.min(F.struct("did", "ord", "start")).alias("x")).select("window", "x.*")
    again = each.join(first, ["window", "did", "ord", "start"], "left_anti")  # one row per place: no key is heavy
    return again.select("did", "ord", "start", (F.col("start") + LENGTH).alias("stop"))


def covered(docs: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """(did, ord, spans): the bytes to remove of each keyed document that has any, spans unsorted."""
    marked = materialise(_marked(_anchor_rows(docs)), "marked")
    spans = marked.where("h is null").select(
        "did", "ord", F.greatest(F.col("pos") - LEFT, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("stop")
    )
    sizes = marked.where("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > most).select("h", F.lit(True).alias("large")), "large")
    around = _surroundings(docs, marked)
    if large.isEmpty():
        spans = spans.unionByName(materialise(_scanned(around), "scanned"))
    else:
        around = materialise(around, "around")
        around = materialise(look_up(around, large, "h", "left"), "dealt")
        spans = spans.unionByName(materialise(_scanned(around.where("large is null")), "scanned"))
        spans = spans.unionByName(_windows(around.where("large")))
    return spans.groupBy("did", "ord").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The union of (start, stop) rows within 0..n as maximal runs."""
    out: list[list[int]] = []
    for start, stop in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        stop = min(stop, n)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left without the runs."""
    at, parts = 0, []
    for start, stop in runs:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def _each(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    return keyed.join(covered(keyed, most), ["did", "ord"], "left")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    lists = batch.column("spans")
    flat = lists.flatten()
    pairs = np.stack([flat.field("start").to_numpy(), flat.field("stop").to_numpy()], axis=1) if len(flat) else np.zeros((0, 2), int)
    sizes = [0 if n is None else n for n in pc.list_value_length(lists).to_pylist()]
    at = 0
    for text, size in zip(batch.column("text").to_pylist(), sizes):
        data = text.encode("utf-8")
        yield data, merged(pairs[at : at + size], len(data)) if size else []
        at += size


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SUFFIXES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 * PIECE):
                sizes, gone, runs_of, hashes = [], [], [], []
                for data, runs in _runs(batch):
                    sizes.append(len(data))
                    gone.append(sum([b - a for a, b in runs]))
                    runs_of.append(len(runs))
                    hashes.append(hashlib.sha256(kept_bytes(data, runs)).hexdigest())
                arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs_of)), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    chosen = _each(docs.select(id_col, text_col), id_col, text_col, most)
    chosen = chosen.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "text", "spans")
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_SUFFIXES) -> DataFrame:
    """The documents with repeated passages cut from the text; halves of characters at a cut are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 * PIECE):
                left = [kept_bytes(data, runs).decode("utf-8", "ignore") for data, runs in _runs(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "left"])

    each = _each(docs, id_col, text_col, most)
    untouched = each.where("spans is null").select("row.*")
    cut = each.where("spans is not null").select(F.col("row").dropFields(f"`{text_col}`").alias("row"), "text", "spans")
    cut = cut.mapInArrow(run, f"row {cut.schema['row'].dataType.simpleString()}, left string")
    columns = [F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return untouched.unionByName(cut.select(*columns))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents"))
