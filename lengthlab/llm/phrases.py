"""Collocations by the SON partitioning scheme: mine every shard, unite, count all candidates exactly.

Texts are cut into pieces and words. Per language a phrase of 2 to 5 words that stands SUPPORT times or more in the
corpus must, in some shard, stand at least SUPPORT times the shard's part of the language's words. So:

1. One pass writes the words as 64-bit hashes, with 0 between pieces, and the number of each word. Input partitions
   form SHARDS shards, whose number does not grow with the corpus, so the local support stays about SUPPORT / SHARDS.
2. Each shard is mined at its local support, level by level: a phrase is counted only where its first and its last
   words form phrases that are frequent in the shard. A shard is no task: its counts are shuffled by ranges of hashes,
   those of one task and range packed in one row. Where a range meets, all shards do, so what cannot reach SUPPORT in
   the corpus goes at once: it stands at most the local support less one times where it is not frequent.
   Most pairs of frequent words stand a few times only, so where a level may be long, its phrases are first counted in
   buckets of their hashes, two bytes and a small count each, as many as grow with the corpus; a phrase whose bucket
   stays below the local support, or cannot reach SUPPORT over all shards, is never shuffled by itself.
3. A phrase frequent in some shards has its exact numbers there, and stands at most the local support less one times in
   each other shard. Where that can reach SUPPORT it is counted in those other shards, and goes if it stays below. With
   its number a phrase keeps one stored row that holds it, and only that row spells it out.

What is frequent reaches the tasks as a Bloom filter of at most FILTER_BITS bits, whatever the corpus: where it errs, a
phrase is counted in vain and goes by its exact number. Phrases are told apart by 64-bit hashes of words and of phrases.

Every cut of a phrase in two gives l and r, the numbers of its parts, and the score floor(1000 a n / (l r)); the lowest
counts, of equal ones the first cut. A phrase goes if a longer candidate of up to 5 words holds it and stands as
often; with one word more is enough to look at, since numbers can only fall with each word.

Null text is empty, null language `und`. Repeated rows count each time. Texts of any length are taken whole; a row
of hashes ends between pieces, so one row may hold a whole piece. An empty table gives no rows. Ties in the result are
settled by the number, then by the phrase in UTF-8 order. Only the two columns named are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lengthlab.llm.common import discard, free_shuffles, look_up, materialise, read, text_or_empty

LONGEST = 5
SUPPORT = 100
TOP = 2000
SHARDS = 4
#: Bits of a filter at most; it takes 16 per entry up to there.
FILTER_BITS = 1 << 27
PROBES = 3
#: Words whose phrases are counted together in a task, and words of a stored row, unless one piece is longer.
TOGETHER = 1 << 21
ROW = 1 << 16
#: Buckets of a shard for each of its local support of words, and the bits of a bucket's number that a row of counts spans.
ROOM, SPAN = 8, 16
#: Phrases in a range of hashes, about, and the bits of a range's number at least.
RANGE, LEAST_RANGES = 1 << 12, 4
#: Counts that a task holds before it passes them on, and distinct words.
HELD, VOCABULARY = 1 << 20, 1 << 19
#: A level is counted in buckets first if it may hold more than one in so many of all words.
LONG_LEVEL = 8

#: All marks between pieces become one.
MARK = b"."
MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", MARK * 9)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
PROBE = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9FB21C651E98DF25)]


class _Hashes(dict):
    """Hashes of words, never 0, and the words by their hashes; the mark between pieces is 0."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[MARK] = 0
        self.words: dict[int, bytes] = {}

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, 42) or 1
        self.words[code] = word
        return code


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in lower case (A-Z), with a mark between pieces and texts."""
    return MARK.join(texts).lower().translate(MARKS).replace(MARK, b" . ").replace(b"\t", b" ").split(b" ")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def _seed(text: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8"), 7))


def phrase_keys(ids: np.ndarray, lang: str, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """For k = 1, 2, ...: keys[i] is the hash of the k words from place i on in this language; 0 where a mark stands among them."""
    keys = np.where(ids == 0, np.uint64(0), _mixed(ids ^ _seed(lang)) | np.uint64(1))
    yield keys
    for k in range(2, longest + 1):
        n = max(0, len(ids) - k + 1)
        whole = (keys[:n] != 0) & (ids[k - 1 : k - 1 + n] != 0)
        keys = np.where(whole, _mixed(keys[:n] * STEP + ids[k - 1 : k - 1 + n]) | np.uint64(1), np.uint64(0))
        yield keys


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _in_shard(keys: np.ndarray, shard: int | np.ndarray) -> np.ndarray:
    return keys ^ _mixed(np.atleast_1d(np.asarray(shard, np.uint64)) * STEP + SPREAD)


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - (bits - 1).bit_length())
    for factor in PROBE:
        x = keys * factor
        yield (x ^ (x >> np.uint64(31))) * STEP >> shift


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each key; now and then true for a key that was never put in."""
    found = np.ones(len(keys), bool)
    for place in _probes(keys, 64 * len(table)):
        found &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _filter(entries: DataFrame, most: int):
    """A broadcast Bloom filter of the materialised entries (key, and shard or rid if the key counts in one shard or row only)."""
    spark = entries.sparkSession
    bits = min(most, 1 << max(10, (16 * entries.count()).bit_length()))
    within = [c for c in ("shard", "rid") if c in entries.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            keys = _in_shard(keys, batch.column(1).to_numpy()) if within else keys
            for place in _probes(keys, bits):
                np.bitwise_or.at(table, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(table)
        for start in range(0, len(at), 100_000):
            part = at[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].view(np.int64))], names=["at", "word"])

    rows = entries.select("key", *within).mapInArrow(run, "at long, word long")
    found = rows.groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toArrow()  # at most `most` / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _encoded(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """Materialised (shard, lang, ids, rid) rows of hashed words, and (shard, lang, word, n) rows of numbers of words."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("rid", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def rows(shard: int, lang: str, ids: np.ndarray, rid: int) -> pa.RecordBatch:
        marks = np.flatnonzero(ids == 0)
        cuts = marks[np.minimum(np.searchsorted(marks, np.arange(ROW, len(ids), ROW)), len(marks) - 1)] if len(marks) else []
        offsets = np.unique(np.concatenate(([0], cuts, [len(ids)]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int64)))
        n = len(lists)
        arrays = [pa.array([shard] * n, pa.int32()), pa.array([lang] * n), lists, pa.array(np.arange(rid, rid + n))]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=schema)

    def numbers(shard: int, lang: str, ids: np.ndarray, n: np.ndarray, words: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(ids), 50_000):
            own, m = ids[start : start + 50_000], n[start : start + 50_000]
            texts = pa.array([words[i] for i in own.tolist()], pa.binary()).cast(pa.string())
            arrays = [pa.array(np.full(len(own), shard, np.int32)), pa.array([lang] * len(own)), pa.nulls(len(own), schema.field(2).type)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(own), pa.int64()), texts, pa.array(m)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, summed, size, shard, made = _Hashes(), defaultdict(list), {}, 0, 0, 0

        def add() -> None:
            for lang, ids in held.items():
                ids, n = np.unique(np.concatenate(ids), return_counts=True)
                before = summed.get(lang, (ids[:0], n[:0]))
                summed[lang] = _summed(np.concatenate([before[0], ids[ids != 0]]), np.concatenate([before[1], n[ids != 0]]))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            shard = part % shards
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts[lang].append(text.encode("utf-8"))
            for lang, own in texts.items():
                ids = np.fromiter(map(known.__getitem__, filter(None, tokens(own))), np.uint64)
                stored = rows(shard, lang, ids, (part << 32) + made)
                made += stored.num_rows
                yield stored
                held[lang].append(ids)
                size += len(ids)
            if size >= TOGETHER or len(known) >= VOCABULARY:
                add()
                size = 0
            if len(known) >= VOCABULARY:
                for lang, (ids, n) in summed.items():
                    yield from numbers(shard, lang, ids, n, known.words)
                known.clear()
                summed.clear()
        add()
        for lang, (ids, n) in summed.items():
            yield from numbers(shard, lang, ids, n, known.words)

    chosen = docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        text_or_empty(F.col(f"`{text_col}`")).alias("text"),
    )
    return materialise(chosen.mapInArrow(run, "shard int, lang string, ids array<long>, rid long, word string, n long"), "encoded")


def _word_keys(words: DataFrame) -> DataFrame:
    """(key, lang, a, each) of words (id, lang, a, each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column("id").to_numpy().view(np.uint64), np.array(batch.column("lang").to_pylist(), object)
            keys = np.zeros(len(ids), np.uint64)
            for lang in set(langs.tolist()):
                keys[langs == lang] = next(phrase_keys(ids[langs == lang], lang))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns[1:]], names=["key", "lang", "a", "each"])

    return words.select("id", "lang", "a", "each").mapInArrow(run, "key long, lang string, a long, each array<long>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((values of the columns before rid and ids), hashed words of many rows with a mark behind each, (rid, size) per row)."""
    held, of, size = defaultdict(list), defaultdict(list), 0
    mark = np.zeros(1, np.uint64)
    for batch in batches:
        names = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 2)))
        rids = batch.column(batch.num_columns - 2).to_pylist()
        lists = batch.column(batch.num_columns - 1)
        flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for name, rid, a, b in zip(names, rids, offsets[:-1].tolist(), offsets[1:].tolist()):
            held[name] += [flat[a:b].copy(), mark]
            of[name].append((rid, b - a + 1))
            size += b - a
        if size >= TOGETHER:
            yield from ((name, np.concatenate(parts), np.array(of[name])) for name, parts in held.items())
            held, of, size = defaultdict(list), defaultdict(list), 0
    yield from ((name, np.concatenate(parts), np.array(of[name])) for name, parts in held.items())


def _possible(ids: np.ndarray, shard: int, lang: str, shorter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of k words, and the places whose first and last k - 1 words are in the filter."""
    below, keys = islice(phrase_keys(ids, lang, k), k - 2, k)
    frequent = _holds(shorter, _in_shard(below, shard))
    return keys, np.flatnonzero((keys != 0) & frequent[:-1] & frequent[1:])


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def _bucket_keys(buckets: np.ndarray, lang: str) -> np.ndarray:
    return _mixed(buckets ^ _seed(lang)) | np.uint64(1)


def _cut(found: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """One binary array per column: its values in rows, a row where `found` goes on with the same number.

    The first bytes of all values of a row come first, then the second: those that are mostly alike compress well.
    """
    starts = np.append(np.flatnonzero(np.diff(found, prepend=-1)), len(found))
    out = []
    for x in columns:
        parts = [x[i:j].view(np.uint8).reshape(j - i, -1).T.tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
        out.append(pa.array(parts, pa.binary()))
    return out


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The values of all rows that _cut() made."""
    width = np.dtype(dtype).itemsize
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1).T for x in column]
    return np.ascontiguousarray(np.concatenate(parts)).view(dtype).ravel()


def _crowded(stored: DataFrame, shorter, k: int, support: int) -> DataFrame:
    """(key, shard): buckets that hold the local support of possible phrases of k words, summed over the tasks of a shard.

    Only those that can hold the support over all shards: where a phrase is not possible it is not in the sum, but stands
    at most the local support less one times.
    """
    small = np.uint8 if support < 256 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shorter.value
        for (shard, lang, least, loose, bits), ids, _ in _gathered(batches):
            keys, at = _possible(ids, shard, lang, table, k)
            found, n = np.unique(_buckets(keys[at], bits), return_counts=True)
            if not len(found):
                continue
            part = (found >> np.uint64(SPAN)).astype(np.int64)
            low = (found & np.uint64((1 << SPAN) - 1)).astype(np.uint16)
            packed = _cut(part, low, np.minimum(n, support).astype(small))
            same = [pa.array([v] * len(packed[0]), t) for v, t in ((shard, pa.int32()), (lang, pa.string()), (least, pa.int64()), (loose, pa.int64()))]
            names = ["shard", "lang", "least", "loose", "part", "low", "n"]
            yield pa.RecordBatch.from_arrays([*same, pa.array(part[np.flatnonzero(np.diff(part, prepend=-1))]), *packed], names=names)

    def add(rows: pa.Table) -> pa.Table:
        lang, loose, part = (rows.column(c)[0].as_py() for c in ("lang", "loose", "part"))
        least = dict(zip(rows.column("shard").to_pylist(), rows.column("least").to_pylist()))
        sums = {shard: np.zeros(1 << SPAN, np.int64) for shard in least}
        for shard, low, n in zip(rows.column("shard").to_pylist(), rows.column("low"), rows.column("n")):
            sums[shard][_joined([low], np.uint16)] += _joined([n], small)
        enough = loose + sum(np.maximum(own - least[shard] + 1, 0) for shard, own in sums.items()) >= support
        keys, shards = [], []
        for shard, own in sums.items():
            full = (np.flatnonzero(enough & (own >= least[shard])) + (part << SPAN)).astype(np.uint64)
            keys.append(_bucket_keys(full, lang).view(np.int64))
            shards.append(np.full(len(full), shard, np.int32))
        return pa.table({"key": pa.array(np.concatenate(keys)), "shard": pa.array(np.concatenate(shards))})

    kind = "shard int, lang string, least long, loose long, part long, low binary, n binary"
    counts = stored.select("shard", "lang", "least", "loose", "bits", "rid", "ids").mapInArrow(run, kind)
    return counts.groupBy("lang", "part").applyInArrow(add, "key long, shard int")


def _range_bits(entries: int) -> int:
    """So many bits of a hash name its range, of about RANGE of the entries."""
    return min(32, max(LEAST_RANGES, (entries // RANGE).bit_length()))


def _packed(counts: Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Sums counts ((shard, lang, least, loose), keys, n, rids) and packs those of a range in a row, with a row that holds each phrase."""

    def rows(name: tuple, keys: np.ndarray, n: np.ndarray, rids: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        packed = _cut(part, keys, n, rids)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        arrays = [*(pa.array([v] * len(starts), t) for v, t in zip(name, kinds)), pa.array(part[starts]), *packed]
        yield pa.RecordBatch.from_arrays(arrays, names=["shard", "lang", "least", "loose", "part", "keys", "n", "rids"])

    held: dict[tuple, list] = {}
    for name, *own in counts:
        if name in held:
            own = [np.concatenate(pair) for pair in zip(held[name], own)]
            rid = own[2][np.unique(own[0], return_index=True)[1]]
            own = [*_summed(*own[:2]), rid]
        held[name] = own
        if sum(len(x[0]) for x in held.values()) >= HELD:
            for name, own in held.items():
                yield from rows(name, *own)
            held = {}
    for name, own in held.items():
        yield from rows(name, *own)


PACKED = "shard int, lang string, least long, loose long, part long, keys binary, n binary, rids binary"


def _phrases_in(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys at these places, their numbers, and a row that holds each."""
    found, first, n = np.unique(keys[at], return_index=True, return_counts=True)
    return found, n, rows[np.searchsorted(np.cumsum(rows[:, 1]), at[first], side="right"), 0]


def _mined(stored: DataFrame, shorter, k: int, ranges: int, crowded=None) -> DataFrame:
    """Packed phrases of k words in each task, if the phrases of k - 1 words in them are in the filter.

    With `crowded` only those whose bucket is in that filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, full = shorter.value, crowded.value if crowded else None

        def counts() -> Iterator[tuple]:
            for (shard, lang, least, loose, bits), ids, rows in _gathered(batches):
                keys, at = _possible(ids, shard, lang, table, k)
                if crowded:
                    at = at[_holds(full, _in_shard(_bucket_keys(_buckets(keys[at], bits), lang), shard))]
                yield (shard, lang, least, loose), *_phrases_in(ids, keys, at, rows)

        yield from _packed(counts(), ranges)

    return stored.select("shard", "lang", "least", "loose", "bits", "rid", "ids").mapInArrow(run, PACKED)


def _summed_up(packed: DataFrame, support: int, name: str) -> DataFrame:
    """(key, shard, least, loose, n, rid): phrases that reach the local support, if over all shards they can reach the support."""

    def add(rows: pa.Table) -> pa.Table:
        of = np.array(rows.column("shard").to_pylist())
        found = []
        for shard in np.unique(of).tolist():
            own = rows.filter(pa.array(of == shard))
            keys, n, rids = (_joined(own.column(c), t) for c, t in (("keys", np.uint64), ("n", np.int64), ("rids", np.int64)))
            rids = rids[np.unique(keys, return_index=True)[1]]
            keys, n = _summed(keys, n)
            least = own.column("least")[0].as_py()
            at = n >= least
            found.append([keys[at], np.full(at.sum(), shard, np.int32), np.full(at.sum(), least), n[at], rids[at]])
        keys, shards, least, n, rids = map(np.concatenate, zip(*found))
        loose = rows.column("loose")[0].as_py()
        single, over = _summed(keys, n - least + 1)
        at = (over + loose >= support)[np.searchsorted(single, keys)]
        arrays = [keys.view(np.int64), shards, least, np.full(len(keys), loose), n, rids]
        return pa.table(dict(zip(("key", "shard", "least", "loose", "n", "rid"), (pa.array(x[at]) for x in arrays))))

    summed = packed.groupBy("lang", "part").applyInArrow(add, "key long, shard int, least long, loose long, n long, rid long")
    out = materialise(summed, name)
    free_shuffles(out.sparkSession)
    return out


def _counted(stored: DataFrame, wanted, longest: int, ranges: int) -> DataFrame:
    """(key, shard, n, rid) of all phrases in the filter of keys and shards, rid being a row that holds the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value

        def counts() -> Iterator[tuple]:
            for (shard, lang), ids, rows in _gathered(batches):
                for keys in islice(phrase_keys(ids, lang, longest), 1, None):
                    at = np.flatnonzero(keys)
                    yield (shard, lang, 0, 0), *_phrases_in(ids, keys, at[_holds(table, _in_shard(keys[at], shard))], rows)

        yield from _packed(counts(), ranges)

    def add(rows: pa.Table) -> pa.Table:
        keys, n, rids = (_joined(rows.column(c), t) for c, t in (("keys", np.uint64), ("n", np.int64), ("rids", np.int64)))
        rids = rids[np.unique(keys, return_index=True)[1]]
        keys, n = _summed(keys, n)
        shard = pa.array(np.full(len(keys), rows.column("shard")[0].as_py(), np.int32))
        return pa.table({"key": pa.array(keys.view(np.int64)), "shard": shard, "n": pa.array(n), "rid": pa.array(rids)})

    packed = stored.select("shard", "lang", "rid", "ids").mapInArrow(run, PACKED)
    return packed.groupBy("shard", "lang", "part").applyInArrow(add, "key long, shard int, n long, rid long")


def _spelling(stored: DataFrame, wanted, longest: int) -> DataFrame:
    """(key, lang, words) of the phrases whose key and row are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for (lang,), ids, rows in _gathered(batches):
            rids = np.repeat(rows[:, 0], rows[:, 1])
            for k, keys in enumerate(islice(phrase_keys(ids, lang, longest), 1, None), 2):
                at = np.flatnonzero(keys)
                at = at[_holds(table, _in_shard(keys[at], rids[at]))]
                found, first = np.unique(keys[at], return_index=True)
                for start in range(0, len(found), 100_000):
                    own, places = found[start : start + 100_000], at[first[start : start + 100_000]]
                    flat = ids[places[:, None] + np.arange(k)].ravel().view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, np.int32)), pa.array(flat))
                    arrays = [pa.array(own.view(np.int64)), pa.array([lang] * len(own)), lists]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "lang", "words"])

    return stored.select("lang", "rid", "ids").mapInArrow(run, "key long, lang string, words array<long>")


def _cuts(phrases: DataFrame) -> DataFrame:
    """(key, lang, a, size, cut, lkey, rkey): every way to cut a phrase in two, with the keys of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            size = np.diff(words.offsets.to_numpy())
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                for k in set(size.tolist()):
                    at = np.flatnonzero((langs == lang) & (size == k))
                    if not len(at):
                        continue
                    matrix = words.values.to_numpy().view(np.uint64)[words.offsets.to_numpy()[at][:, None] + np.arange(k)]
                    lines = np.concatenate([matrix, np.zeros((len(at), 1), np.uint64)], axis=1).ravel()  # a mark behind each
                    keys = list(phrase_keys(lines, lang, k))
                    row = np.arange(len(at)) * (k + 1)
                    for cut in range(1, k):
                        left, right = keys[cut - 1][row], keys[k - cut - 1][row + cut]
                        same = [batch.column(c).take(pa.array(at)) for c in ("key", "lang", "a")]
                        arrays = [*same, pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), cut, np.int32))]
                        arrays += [pa.array(left.view(np.int64)), pa.array(right.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["key", "lang", "a", "size", "cut", "lkey", "rkey"])

    kind = "key long, lang string, a long, size int, cut int, lkey long, rkey long"
    return phrases.select("key", "lang", "a", "words").mapInArrow(run, kind)


def _spelled(chosen: DataFrame, numbers: DataFrame) -> DataFrame:
    """chosen (lang, key, words, ...) with the phrase spelled out, words joined by a space."""
    each = chosen.select("key", F.posexplode("words").alias("pos", "id"))
    names = numbers.join(each.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("word").alias("word"))
    spelled = each.join(names, "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("parts"))
    return chosen.join(spelled.select("key", F.array_join("parts.word", " ").alias("phrase")), "key")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    top: int = TOP,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    encoded = _encoded(docs, text_col, lang_col, shards)
    code = F.xxhash64("word")  # with seed 42, as _Hashes
    numbers = encoded.where("word is not null").select("shard", "lang", "word", "n", F.when(code == 0, 1).otherwise(code).alias("id"))
    texts = encoded.where("ids is not null")
    parts = materialise(numbers.groupBy("shard", "lang").agg(F.sum("n").alias("part")), "parts")
    totals = materialise(parts.groupBy("lang").agg(F.sum("part").alias("n")), "totals")
    least = parts.join(totals, "lang").withColumn("least", F.expr(f"({support} * part + n - 1) div n"))
    loose = least.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("loose"))  # the most that stands below the support of every shard
    bits = F.greatest(F.lit(8), F.least(F.lit(40), F.ceil(F.log2(F.lit(ROOM / support) * F.col("n"))).cast("int"))).alias("bits")
    least = materialise(least.join(loose, "lang").select("shard", "lang", "least", "loose", bits), "least")
    stored = texts.select("shard", "lang", "rid", "ids").join(F.broadcast(least) if least.count() <= 10_000 else least, ["shard", "lang"])

    each = F.array(*(F.sum(F.when(F.col("shard") == i, F.col("n"))) for i in range(shards))).alias("each")
    words = numbers.groupBy("lang", "id").agg(F.sum("n").alias("a"), each).where(F.col("a") >= support)
    words = materialise(_word_keys(words), "words")
    free_shuffles(docs.sparkSession)
    inside = words.select("key", "lang", F.posexplode("each").alias("shard", "n")).join(least.select("shard", "lang", "least"), ["shard", "lang"])
    level = materialise(inside.where("n >= least").select("key", "shard", "n"), "frequent_1")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    found = []
    for k in range(2, longest + 1):
        shorter, crowded, entries = _filter(level.select("key", "shard"), filter_bits), None, level.count()
        if LONG_LEVEL * (level.agg(F.sum("n")).first()[0] or 0) > all_words:  # no more phrases of k words than of k - 1
            buckets = materialise(_crowded(stored, shorter, k, support), f"crowded_{k}")
            crowded, entries = _filter(buckets, filter_bits), buckets.count()
            discard(buckets)
        level = _summed_up(_mined(stored, shorter, k, _range_bits(entries), crowded), support, f"frequent_{k}")
        shorter.unpersist()
        if crowded:
            crowded.unpersist()
        found.append(level)
    known = found[0]
    for level in found[1:]:
        known = known.union(level)
    over = [F.sum(F.expr("n - least + 1")).alias("over"), F.min("loose").alias("loose"), F.collect_set("shard").alias("inside")]
    others = F.explode(F.array_except(F.array(*map(F.lit, range(shards))), "inside")).alias("shard")
    missing = materialise(known.groupBy("key").agg(*over).where(f"over + loose >= {support}").select("key", others), "missing")
    wanted = _filter(missing, filter_bits)
    counts = _counted(texts, wanted, longest, _range_bits(missing.count())).select("key", "shard", "n", F.lit(None).cast("long").alias("whole"), "rid")
    counts = counts.union(known.select("key", "shard", F.lit(None).cast("long"), "n", "rid")).repartition("key")
    # What the filter let through in vain has a whole number in its shard, or stands too seldom.
    counts = counts.groupBy("key", "shard").agg(F.coalesce(F.max("whole"), F.sum("n")).alias("n"), F.min("rid").alias("rid"))
    counts = counts.groupBy("key").agg(F.sum("n").alias("a"), F.min("rid").alias("rid"))
    counts = materialise(counts.where(F.col("a") >= support), "counts")
    wanted.unpersist()
    wanted = _filter(counts, filter_bits)
    spelled = _spelling(texts, wanted, longest).groupBy("key", "lang").agg(F.first("words").alias("words"))
    phrases = materialise(spelled.join(counts.drop("rid"), "key"), "phrases")
    wanted.unpersist()
    discard(*found, missing)
    free_shuffles(docs.sparkSession)

    known = materialise(words.select("key", "a").union(counts.drop("rid")), "known")
    cuts = materialise(_cuts(phrases), "cuts")
    both = look_up(cuts, known.select(F.col("key").alias("lkey"), F.col("a").alias("l")), "lkey")
    both = look_up(materialise(both, "left"), known.select(F.col("key").alias("rkey"), F.col("a").alias("r")), "rkey")
    exact = "cast((cast(1000 * a as decimal(20, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0))) as long)"
    scored = both.join(totals, "lang").withColumn("score", F.expr(exact))
    best = scored.groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("best"))
    ends = cuts.where("size > 2 and cut = size - 1").select(F.col("lkey").alias("key"), "a")
    ends = ends.union(cuts.where("size > 2 and cut = 1").select("rkey", "a"))
    longer = ends.groupBy("key").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "key", "left").where("longer is null or longer < a").join(best, "key")
    kept = kept.select("key", "lang", "words", "a", "best.l", "best.r", "best.n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialise(kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= top), "first")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _spelled(first, numbers).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
