"""Groups of texts by the Jaccard similarity of their sets of word shingles, exactly and at any size of a group.

The set of a text holds 64-bit hashes of its shingles. Equal sets are one set. Two sets link where
q |A and B| >= p |A or B|; groups are the closure of all links. Keys under which linked sets must meet come from two sides:

* small sets (up to a boundary): every subset of the size that a partner must share, for each size of partner. They are
  enumerated by leaving elements out, a few of each set;
* larger sets: an inverted index of prefixes. Elements are ordered with common ones last, and two linked sets share
  one of the first n - ceil(p n / q) + 1 elements, or k of the first n - ceil(p n / q) + k. Small sets that
  have a partner beyond the boundary are indexed too.

The boundary is the one with the least cost: rows of subsets against rows and scanned entries of the lists.

No list is joined with itself while its members belong together: members first meet their neighbours in a few orders,
dealt out by ranges of (key, order), so a key of any weight is many tasks. What is alike is verified on the whole sets and
contracted. A member goes on only if it shares as many keys with other groups as a partner must share, and under
each key that still has several groups the members outside its largest group meet the others, in salted parts, with all
that rules a pair out as part of the join. No key is capped and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import discard, free_shuffles, look_up, materialise, text_or_empty
from lengthlab.llm.components import connected_components

SEED = 42
#: One text in so many is read for the shingles that are common; they come last in the prefix order.
SAMPLE = 32
COMMON = 3
MOST_COMMON = 100_000
#: Rows of narrow tables (numbers, digests) that may be broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: One in so many elements, at least one, that two linked sets must share in their prefixes.
COMMON_PART = 10
#: Longs of parities that go into the join of a key's members; pairs are held against all of them afterwards.
FOLDED = 8
#: Sets up to this size may be enumerated.
MOST_SMALL = 40
#: Members of a key that one part of the last join holds.
PART = 1000


@dataclass(frozen=True)
class Likeness:
    """Sets of shingles of so many words link at a Jaccard similarity of p / q."""

    words: int
    p: int
    q: int

    def required(self, n: int, m: int) -> int:
        """What linked sets of n and m elements share at least."""
        return -(-self.p * (n + m) // (self.p + self.q))

    def least_partner(self, n: int) -> int:
        return -(-self.p * n // self.q)

    def partners(self, n: int, most: int) -> list[int]:
        """Sizes up to `most` of sets that can link with a different set of n elements."""
        sizes = range(self.least_partner(n), min(most, self.q * n // self.p) + 1)
        return [m for m in sizes if self.required(n, m) <= min(n, m) and not (n == m == self.required(n, m))]

    def shared(self, n: int, most: int) -> list[int]:
        """The sizes of subsets that a set of n elements has to give for partners of up to `most`."""
        return sorted({self.required(n, m) for m in self.partners(n, most)})


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return code


def shingle_set(text: str, words: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The hashes (uint64, in order) of the set of shingles of `words` words; fewer words make one, none gives none.

    Words stand between ASCII white space, A-Z in lower case. `known` keeps hashes of words from text to text.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], np.uint64)
    known = _Hashes() if known is None else known
    each = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    mixed = np.zeros(len(parts) - words + 1, np.uint64)
    for j in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[j : j + len(mixed)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ mixed >> np.uint64(29))


def _sets_of(texts: list[str | None], words: int, known: _Hashes) -> Iterator[np.ndarray]:
    for text in texts:
        if len(known) > 1_000_000:
            known.clear()
        yield shingle_set(text or "", words, known)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, as longs: whether an odd number of the hashes falls into each of about as many bins as there are hashes.

    The bins of half the width are the exclusive or of both halves. Two sets differ in as many hashes, at least, as
    their parities differ in bits.
    """
    bins = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differ(x: str, y: str) -> str:
    """SQL for the bits in which two parities differ, after the wider one is folded to the width of the other."""
    half = f"least(size({x}), size({y}))"
    narrow = "if(size({0}) = {1}, {0}, zip_with(slice({0}, 1, {1}), slice({0}, {1} + 1, {1}), (p, q) -> p ^ q))"
    return f"aggregate(zip_with({narrow.format(x, half)}, {narrow.format(y, half)}, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The `most` rows of the materialised (key, n) with the largest n at most, cut where n is equal for too many.

    The least n comes from a histogram, so no task and not the driver gets more than what is returned.
    """
    sizes = sorted(counts.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect(), key=lambda r: -r.n)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row.n
    return counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= least)


def common_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles and how common they are, from a sample; they set an order only, which any choice keeps right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for own in _sets_of(batch.column(0).to_pylist(), words, known):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["key"])

    texts = docs.select(text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(run, "key long")
    counts = materialise(sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "common")
    found = most_frequent(counts, MOST_COMMON).toArrow()
    discard(counts)
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def text_digest(text_col: str) -> Column:
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(text_or_empty(F.col(f"`{text_col}`"))))


def sketched(docs: DataFrame, id_col: str, text_col: str, like: Likeness, extra=None) -> DataFrame:
    """(id, text_id, size, digest, extra, prefix, bits, whole) for each row: what the join needs of its set, but not the text.

    digest names the set, whole is the set itself if it is small, extra a long that `extra` makes of it.
    """
    common, weight = common_shingles(docs, text_col, like.words)
    kinds = [("id", pa.int64()), ("text_id", pa.binary()), ("size", pa.int32()), ("digest", pa.binary()), ("extra", pa.int64())]
    schema = pa.schema(kinds + [(name, pa.list_(pa.int64())) for name in ("prefix", "bits", "whole")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sizes, digests, extras, prefixes, bits, whole = [], [], [], [], [], []
            for own in _sets_of(batch.column("text").to_pylist(), like.words, known):
                n = len(own)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                extras.append(extra(own) if extra else None)
                bits.append(parities(own))
                whole.append(own.view(np.int64) if n <= MOST_SMALL else None)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, weight[at], 0), kind="stable")]
                prefixes.append(own[: n - like.least_partner(n) + max(1, n // COMMON_PART)].view(np.int64))
            columns = [batch.column("id"), batch.column("text_id"), sizes, digests, extras, prefixes, bits, whole]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    chosen = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        text_digest(text_col).alias("text_id"),
        text_or_empty(F.col(f"`{text_col}`")).alias("text"),
    )
    lists = ", ".join(f"{name} array<long>" for name in ("prefix", "bits", "whole"))
    return chosen.mapInArrow(run, f"id long, text_id binary, size int, digest binary, extra long, {lists}")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """Materialised (rid, digest, id, text_id, size, extra, prefix, bits, whole): one row per set, with its least id."""
    other = [F.first(c).alias(c) for c in ("text_id", "size", "extra", "prefix", "bits", "whole")]
    sets = rows.groupBy("digest").agg(F.min("id").alias("id"), *other)
    return materialise(sets.withColumn("rid", F.monotonically_increasing_id()), "sets")


def hinted(table: DataFrame) -> DataFrame:
    """A materialised narrow table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def boundary(sets: DataFrame, like: Likeness) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, from all sets of MOST_SMALL elements or fewer.

    Costs are rows: a set of n elements up to the boundary gives its subsets, one beyond it its prefix and the entries
    that stand in the same lists, among sets of such sizes.
    """
    small = sets.where(F.col("size") <= MOST_SMALL).select("rid", "size", F.explode("prefix").alias("key"))
    lists = small.groupBy("key").agg(F.count("*").alias("entries"))
    scanned = small.join(lists, "key").groupBy("size").agg(F.sum("entries").alias("entries"))
    held = sets.where(F.col("size") <= MOST_SMALL).groupBy("size").agg(F.count("*").alias("n"))
    found = {r.size: (r.n, r.entries or 0) for r in held.join(scanned, "size", "left").select("size", "n", "entries").collect()}

    def cost(limit: int) -> int:
        rows = 0
        for n, (count, entries) in found.items():
            if n <= limit:
                rows += count * sum(comb(n, c) for c in like.shared(n, limit))
            if n > limit or n >= like.least_partner(limit + 1):
                rows += count * (n - like.least_partner(n) + max(1, n // COMMON_PART)) + entries
        return rows

    return min(range(MOST_SMALL + 1), key=lambda limit: (cost(limit), limit))


def _subset_keys(sets: DataFrame, like: Likeness, limit: int) -> DataFrame:
    """(key, rid, size, pos) for every subset that a set of up to `limit` elements must share with a partner up to `limit`."""
    step = np.uint64(0x9FB21C651E98DF25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, own in zip(batch.column("rid").to_pylist(), batch.column("whole").to_pylist()):
                own = np.array(own, np.int64).view(np.uint64) * step
                own ^= own >> np.uint64(31)
                n = len(own)
                for c in like.shared(n, limit):
                    out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                    keys = (own.sum(dtype=np.uint64) - own[out].sum(axis=1, dtype=np.uint64)) * step + np.uint64(c)
                    m = len(keys)
                    arrays = [keys.view(np.int64), np.full(m, rid), np.full(m, n, np.int32), np.zeros(m, np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["key", "rid", "size", "pos"])

    small = sets.where(F.col("size").between(1, limit)).select("rid", "whole")
    return small.mapInArrow(run, "key long, rid long, size int, pos int")


def _keys(sets: DataFrame, like: Likeness, limit: int) -> DataFrame:
    """(key, rid, size, pos): all keys under which linked sets must meet."""
    indexed = sets.where(F.col("size") >= like.least_partner(limit + 1))
    lists = indexed.select("rid", "size", F.posexplode("prefix").alias("pos", "key")).select("key", "rid", "size", "pos")
    return lists.unionByName(_subset_keys(sets, like, limit)) if limit else lists


def _neighbours(members: DataFrame, order: list, like: Likeness) -> DataFrame:
    """(key, rid, size, pos, before): members with the row before them in the order under their key, if both can link.

    Rows are dealt out by ranges of key and order, so a heavy key is many tasks. A member that is alone under its key
    goes, unless a range or batch ends with it, since others may stand beyond. members may have a component.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("key"), *order]
    with_component = "component" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rid = batch.column("key").to_numpy(), batch.column("rid").to_numpy()
            size, pos = batch.column("size").to_numpy().astype(np.int64), batch.column("pos").to_numpy()
            same = key[1:] == key[:-1]
            least, left = np.minimum(size[1:], size[:-1]), np.minimum((size - pos)[1:], (size - pos)[:-1])
            total = size[1:] + size[:-1]
            fits = same & (like.q * least >= like.p * (total - least)) & ((like.p + like.q) * left >= like.p * total)
            if with_component:
                component = batch.column("component").to_numpy()
                fits &= component[1:] != component[:-1]
            before = pa.array(np.concatenate(([0], rid[:-1])), mask=np.concatenate(([True], ~fits)))
            stays = np.concatenate(([True], same)) | np.concatenate((same, [True]))
            arrays = [batch.column(c) for c in ("key", "rid", "size", "pos")]
            out = pa.RecordBatch.from_arrays([*arrays, before], names=["key", "rid", "size", "pos", "before"])
            yield out.filter(pa.array(stays))

    chosen = members.select("key", "rid", "size", "pos", *["component"] * with_component)
    dealt = chosen.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "key long, rid long, size int, pos int, before long")


def _not_apart(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (a, b: rid) whose sizes and parities leave room for the similarity; none that link are lost.

    Linked sets differ in (q - p) / (q + p) of the sum of their sizes at most.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side, x in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("rid").alias(side), F.struct("size", "bits").alias(x)), side)
    close = pairs.where(f"{like.q} * least(x.size, y.size) >= {like.p} * greatest(x.size, y.size)")
    close = close.withColumn("apart", F.expr(differ("x.bits", "y.bits")))
    return materialise(close.where(f"{like.p + like.q} * apart <= {like.q - like.p} * (x.size + y.size)").select("a", "b", "apart"), "pairs")


def whole_sets(docs: DataFrame, text_col: str, sets: DataFrame, rids: DataFrame, like: Likeness) -> DataFrame:
    """Materialised (rid, hashes) of the sets named in rids (rid), read from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [own.view(np.int64) for own in _sets_of(part.column("text").to_pylist(), like.words, known)]
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(found, pa.list_(pa.int64()))], names=["rid", "hashes"])

    wanted = materialise(sets.select("rid", "text_id").join(rids, "rid", "left_semi"), "wanted")
    texts = docs.select(text_digest(text_col).alias("text_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    found = texts.join(hinted(wanted), "text_id").groupBy("rid").agg(F.first("text").alias("text"))
    return materialise(found.select("rid", "text").mapInArrow(run, "rid long, hashes array<long>"), "whole")


def _verified(pairs: DataFrame, whole: DataFrame, like: Likeness) -> DataFrame:
    """Materialised (a, b): those of the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            x, y = one.values.to_numpy(), two.values.to_numpy()
            i, j = one.offsets.to_numpy(), two.offsets.to_numpy()
            near = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                own, other = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
                shared = len(np.intersect1d(own, other, assume_unique=True))
                near[k] = (like.p + like.q) * shared >= like.p * (len(own) + len(other))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    both = pairs.select("a", "b").join(whole.select(F.col("rid").alias("a"), F.col("hashes").alias("one")), "a")
    both = both.join(whole.select(F.col("rid").alias("b"), F.col("hashes").alias("two")), "b")
    return materialise(both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long"), "links")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(rid, component) for all vertices that have left their own component, after the links (a, b: rid).

    labels (rid, component) holds those that had left it before; a vertex outside it is its own component.
    """
    if labels is None:
        found = connected_components(links).select(F.col("vertex").alias("rid"), "component")
        return materialise(found.where("rid <> component"), "labels")
    for side in ("a", "b"):
        named = labels.select(F.col("rid").alias(side), F.col("component").alias(f"c{side}"))
        links = links.join(named, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    found = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    found = materialise(found.select(F.col("vertex").alias("component"), F.col("component").alias("merged")), "merged")
    old = look_up(labels, found, "component", "left").select("rid", F.coalesce("merged", "component").alias("component"))
    new = found.select(F.col("component").alias("rid"), F.col("merged").alias("component")).join(labels, "rid", "left_anti")
    return materialise(old.unionByName(new).where("rid <> component"), "labels")


def _linked(docs: DataFrame, text_col: str, sets: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """Materialised (a, b): those of the pairs (a, b: rid) that link."""
    pairs = _not_apart(pairs, sets, like)
    whole = whole_sets(docs, text_col, sets, pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), like)
    links = _verified(pairs, whole, like)
    discard(pairs, whole)
    return links


def link_neighbours(docs: DataFrame, text_col: str, sets: DataFrame, members: DataFrame, like: Likeness) -> DataFrame | None:
    """Labels (rid, component) from the links of members (key, rid, size, pos) with the next in size under their key."""
    met = _neighbours(members, [F.col("size"), F.col("rid")], like).where("before is not null")
    links = _linked(docs, text_col, sets, met.select(F.col("before").alias("a"), F.col("rid").alias("b")), like)
    return None if links.isEmpty() else merged(None, links)


def components_of_sets(
    docs: DataFrame, text_col: str, sets: DataFrame, like: Likeness, labels: DataFrame | None = None, limit: int | None = None
) -> DataFrame | None:
    """(rid, component) of the sets that are not their component's own name: the closure of all links; None: no set is.

    labels: what is known to be linked before. limit: the boundary between small and large sets, else the cheapest.
    """
    spark = docs.sparkSession
    limit = boundary(sets, like) if limit is None else limit

    def labelled(members: DataFrame) -> DataFrame:
        if labels is None:
            return members.withColumn("component", F.col("rid"))
        return members.join(hinted(labels), "rid", "left").withColumn("component", F.coalesce("component", "rid"))

    def contested(members: DataFrame) -> DataFrame:
        """Members of keys with two components or more that share as many such keys as a partner of theirs must share."""
        named = labelled(members)
        several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        open_ = materialise(named.join(several.select("key"), "key", "left_semi"), "open")
        shared = f"greatest(1, (({like.p} * size + {like.q - 1}) div {like.q}) div {COMMON_PART})"
        counts = open_.groupBy("rid", "size").agg(F.count("*").alias("n")).where(f"n >= {shared} or size <= {limit}")
        out = materialise(open_.join(counts.select("rid"), "rid", "left_semi"), "contested")
        discard(open_)
        return out

    def linked(pairs: DataFrame) -> bool:
        nonlocal labels
        links = _linked(docs, text_col, sets, pairs, like)
        some = not links.isEmpty()
        if some:
            labels = merged(labels, links)
        discard(links)
        free_shuffles(spark)
        return some

    met = materialise(_neighbours(labelled(_keys(sets, like, limit)), [F.col("size"), F.col("rid")], like), "met")
    linked(met.where("before is not null").select(F.col("before").alias("a"), F.col("rid").alias("b")))
    members = contested(met.select("key", "rid", "size", "pos"))
    discard(met)
    for order in ([F.xxhash64("rid")], [F.xxhash64("key", "rid")]):
        if members.isEmpty():
            return labels
        met = _neighbours(members, order, like).where("before is not null")
        linked(met.select(F.col("before").alias("a"), F.col("rid").alias("b")))
        left = contested(members.drop("component"))
        discard(members)
        members = left

    # Where one key in common is sure: all members outside a key's largest component meet the others.
    sure = members.where(f"pos <= size - (({like.p} * size + {like.q - 1}) div {like.q})")
    own = f"filter(bits, (v, i) -> i % {FOLDED} = j)"
    folded = f"transform(sequence(0, least({FOLDED}, size(bits)) - 1), j -> aggregate({own}, 0L, (a, v) -> a ^ v))"
    rest = sure.join(sets.select("rid", F.expr(folded).alias("bits")), "rid")
    rest = materialise(rest.select("key", F.struct("rid", "size", "pos", "bits").alias("x"), "component"), "rest")
    sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"))
    keys = materialise(keys.select("key", "largest", F.expr(f"cast(n div {PART} as int)").alias("parts")), "keys")
    named = look_up(rest, keys, "key")
    part = F.array(F.expr("cast(pmod(xxhash64(x.rid), parts + 1) as int)"))
    minor = named.where("component <> largest").select("key", "x", "component", F.explode(F.expr("sequence(0, parts)")).alias("part"))
    other = named.select("key", F.col("x").alias("y"), F.col("component").alias("cy"), F.explode(part).alias("part"))
    near = minor.join(other, ["key", "part"]).where("component <> cy")
    near = near.where(f"{like.q} * least(x.size, y.size) >= {like.p} * greatest(x.size, y.size)")
    near = near.where(f"{like.p + like.q} * least(x.size - x.pos, y.size - y.pos) >= {like.p} * (x.size + y.size)")
    near = near.where(f"{like.p + like.q} * {differ('x.bits', 'y.bits')} <= {like.q - like.p} * (x.size + y.size)")
    linked(near.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")))
    discard(members, rest, keys)
    return labels
