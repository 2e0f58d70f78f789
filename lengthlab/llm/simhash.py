"""SimHash near-duplicates by Golay-code fuzzy hashing.

Every whole text gets a 64-bit SimHash of its word shingles. Fingerprints that differ in at most 4 bits
link. To find the links, a fingerprint is cut into five segments (13, 13, 13, 13 and 12 bits). A segment can be
read as a word of the (23, 12, 7) Golay code and decoded: an even word gives the one codeword within 3 bits, an
odd word all codewords within 4 bits (1 or 6 of them). Two words one bit apart have different parity, and the
even word's codeword lies within 4 bits of the odd one, so they always share a codeword. The keys follow from
where 4 or fewer differing bits can fall:

* two segments at most are touched: three agree (10 keys of three segments);
* three are touched: two agree, and of the other three at least two differ by one bit, so one of any two of
  them does (10 pairs of agreeing segments, each with the codewords of two others in turn);
* four are touched, by one bit each: the fifth agrees, and two of the others share a codeword each (5 cases).

A key holds 37 to 39 bits, so unrelated fingerprints seldom share one, even among 10^10.

Joining on keys gives candidates; all are verified on the whole fingerprints. So that a large group never
emits all its pairs, a first pass links each fingerprint only to its neighbour and to the first one under
the same key and contracts the components; a second pass compares, under each key that still holds two or
more components, every member with the members outside the key's largest component. No link between
different components is lost, and no bucket is capped.

Null text counts as empty. A text without words has fingerprint zero, linked like any other. Repeated rows
and exact copies have equal fingerprints and share a component. A null doc_id never names a component
unless all of its component's ids are null (then the component is null). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lengthlab.llm.common import discard, free_shuffles, look_up, materialise, read, text_or_empty
from lengthlab.llm.components import connected_components
from lengthlab.llm.set_join import Likeness, components_of_sets, distinct_sets, hinted, link_neighbours, sketched, text_digest

SEED = 42
MOST_BITS = 4
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Generator polynomial of the (23, 12, 7) Golay code.
GENERATOR = 0xC75


def fingerprint(text: str, words: int = 4, seed: int = SEED, distinct: bool = False) -> int:
    """The SimHash of the shingles of `words` words; fewer words make one shingle, none gives 0.

    Repeated shingles count each time, or once if `distinct`.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    if words == 1:
        shingles: Collection[bytes] = parts
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, stops)]
    if distinct:
        shingles = set(shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), ">u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, words) for text in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """For each 13-bit word (the top bits of a 23-bit word) its codeword indices, -1 where there are fewer than 6."""
    errors = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)])
    by_syndrome: dict[int, list[int]] = {}
    for error, of in zip(errors.tolist(), _syndrome(errors).tolist()):
        by_syndrome.setdefault(of, []).append(error)
    table = np.full((1 << 13, 6), -1, np.int64)
    words = np.arange(1 << 13, dtype=np.int64) << 10
    for word, syndrome in enumerate(_syndrome(words).tolist()):
        near = by_syndrome[syndrome][: 1 if word.bit_count() % 2 == 0 else None]
        table[word, : len(near)] = [(word << 10 ^ error) >> 11 for error in near]
    return table


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (uint64): the row of each key's fingerprint, and the key."""
    segment = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for kind, (i, j, k) in enumerate(combinations(range(5), 3)):
        rows.append(np.arange(len(fps)))
        keys.append(np.int64(kind) << 40 | segment[i] << 26 | segment[j] << 13 | segment[k])
    table = codewords()
    coded = [table[s] for s in segment]
    kind = 10
    for i, j in combinations(range(5), 2):
        for other in [k for k in range(5) if k not in (i, j)][:2]:
            there = coded[other] >= 0
            key = (segment[i] << 25 | segment[j] << 12)[:, None] | coded[other]
            rows.append(np.nonzero(there)[0])
            keys.append(np.int64(kind) << 40 | key[there])
            kind += 1
    for i in range(5):
        one, two = coded[(i + 1) % 5], coded[(i + 2) % 5]
        key = (segment[i] << 24)[:, None, None] | one[:, :, None] << 12 | two[:, None, :]
        there = (one >= 0)[:, :, None] & (two >= 0)[:, None, :]
        rows.append(np.nonzero(there)[0])
        keys.append(np.int64(kind + i) << 40 | key[there])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, component) for rows (fp, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                rows, keys = keys_of(part.column(0).to_numpy().view(np.uint64))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column(0).take(at), part.column(1).take(at)], names=["key", "fp", "component"]
                )

    return fps.select("fp", "component").mapInArrow(run, "key long, fp long, component long")


def _apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def first_groups(fps: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fingerprint, linked to its neighbour and the first one under each key."""
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes over a hundred
    keyed = _keyed(distinct.repartition(parts).withColumn("component", F.col("fp")))
    order = Window.partitionBy("key").orderBy("fp")
    near = keyed.select("fp", F.lag("fp").over(order).alias("before"), F.first("fp").over(order).alias("first"))
    near = near.where("before is not null").select("fp", F.explode(F.array("before", "first")).alias("other"))
    near = near.where(_apart("fp", "other") <= MOST_BITS).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    groups = connected_components(near).withColumnRenamed("vertex", "fp")
    first = materialise(
        distinct.join(groups, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "first"
    )
    discard(distinct)
    return first


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fingerprint in `fps`; component is a fingerprint of its group."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = first_groups(fps)

    # One exchange by key serves both the test for open keys and the comparison under them.
    under = Window.partitionBy("key")
    keyed = _keyed(first.repartition(parts)).select(
        "key", "fp", "component", F.min("component").over(under).alias("least"), F.max("component").over(under).alias("most")
    )
    members = materialise(keyed.where("least <> most").select("key", "fp", "component"), "members")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    minor = members.join(largest, "key").where("component <> largest")
    minor = minor.select("key", F.col("fp").alias("fp_a"), F.col("component").alias("a"))
    other = members.select("key", F.col("fp").alias("fp_b"), F.col("component").alias("b"))
    links = minor.join(other, "key").where((F.col("a") != F.col("b")) & (_apart("fp_a", "fp_b") <= MOST_BITS))
    merged = connected_components(links.select("a", "b"))
    merged = merged.select(F.col("vertex").alias("component"), F.col("component").alias("merged"))
    out = look_up(first, materialise(merged, "merged"), "component", "left")
    return materialise(out.select("fp", F.coalesce("merged", "component").alias("component")), "groups")


def near_duplicates(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`; other columns are not read."""
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    groups = fingerprint_components(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(groups.join(least, "fp"), "named")
    names = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    by_print = materialise(look_up(named, names, "component").select("fp", "component_id"), "by_print")
    return look_up(prints, by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Near copies share 4 of 5 of all their five-word shingles.
NEAR = Likeness(words=5, p=4, q=5)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes as a signed number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _similar(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Materialised rows (id, text_id, digest) and groups (digest, group_id), for five-word similarity of 0.8 or more.

    First this operator's keys link SimHashes of the sets within 4 bits; members of such a group that stand next to each
    other by size are verified on the whole sets. The set join completes the links from its own keys and loses none.
    """
    rows = materialise(sketched(docs, id_col, text_col, NEAR, extra=majority), "sketched")
    sets = distinct_sets(rows)
    rows = rows.select("id", "text_id", "digest")
    own = materialise(sets.select("rid", "size", F.col("extra").alias("fp")), "own")
    prints = first_groups(own.select("fp"))
    named = materialise(look_up(own, prints, "fp").select(F.col("component").alias("key"), "rid", "size", F.lit(0).alias("pos")), "named")
    labels = link_neighbours(docs, text_col, sets, named, NEAR)
    discard(own, prints, named)
    free_shuffles(docs.sparkSession)
    labels = components_of_sets(docs, text_col, sets, NEAR, labels)
    groups = sets.select("digest", "rid")
    if labels is not None:
        groups = groups.join(labels, "rid", "left").withColumn("rid", F.coalesce("component", "rid"))
    groups = materialise(groups.select("digest", F.col("rid").alias("group_id")), "groups")
    discard(sets)
    return rows, groups


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_id, group_id) of every row: the groups of five-word similarity of 0.8 or more.

    Texts link where their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are the closure
    of these links, verified on the whole sets, so there is no error either way but for equal 64-bit hashes. Texts
    without words are alike.
    """
    rows, groups = _similar(docs, id_col, text_col)
    return look_up(rows, groups, "digest").select("id", "text_id", "group_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each similar group stays: the one with the smallest id (null last), then the least text digest.

    Null text counts as empty, and texts without words are alike. Repeated rows are copies, of which one stays. Texts are
    taken whole, however long. An empty table gives no rows. The documents are read again to pick what stays, so no text is
    stored; where few go, none is moved.
    """
    rows, groups = _similar(docs, id_col, text_col)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "text_id")
    # The best row of each set, then of each group: both are sums over partial minima, whatever the size of a group.
    best = rows.groupBy("digest").agg(F.min(key).alias("key")).join(groups, "digest")
    kept = materialise(best.groupBy("group_id").agg(F.min("key").alias("key")).select("key.id", "key.text_id"), "kept")
    same = lambda x, y: F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.text_id") == F.col(f"{y}.text_id"))
    counts = rows.groupBy("id", "text_id").agg(F.count("*").alias("n")).alias("r")
    gone = materialise(counts.join(kept.alias("k"), same("r", "k"), "left_anti").select("id", "text_id"), "gone")
    again = materialise(counts.where("n > 1").join(kept.alias("k"), same("r", "k"), "left_semi").select("id", "text_id"), "again")
    whole = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        text_digest(text_col).alias("text_id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    left = whole.alias("w").join(hinted(gone).alias("g"), same("w", "g"), "left_anti")
    if not again.isEmpty():
        twice = left.alias("w").join(hinted(again).alias("a"), same("w", "a"), "left_semi").dropDuplicates(["id", "text_id"])
        left = left.alias("w").join(hinted(again).alias("a"), same("w", "a"), "left_anti").unionByName(twice)
    return left.select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
