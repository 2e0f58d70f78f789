"""Runs of periodically repeated words by branching tandem repeats over an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and length >= max(24, 3 q) that no neighbouring word
extends with that period. The documents of a batch share one suffix array over words in which a word of one
document never equals a word of another, so every repeat lies within a document:

1. Prefix doubling ranks the blocks of 1, 2, 4, ... words; only suffixes that are not yet unique are sorted again. The
   ranks of all rounds are kept: two equal ranks mean equal blocks, so common prefixes and common extensions to the left
   are found by descending through the rounds.
2. The common prefix of neighbours (LCP) splits the array. At a place of the LCP with depth d, the suffixes before it and
   behind it that share d words form two children of an interval of depth d. For each suffix i of the smaller child the
   inverse suffix array tells whether i + d or i - d lies in the other child. If so, a square of period d stands there
   that the next word does not continue: a branching tandem repeat. No tree is built, and since the smaller child is
   taken the tests are at most n log n.
3. Every run ends in exactly one branching square of its period. The square is rotated to the left as far as the words
   allow, which gives the whole run; of several periods of one stretch the smallest counts.

A word is dropped if any run holds it behind that run's first q words. Words stand between ASCII white space (space and
the controls 9 to 13). Null and empty texts have no words and no run. Ties: of runs with the same exponent the one with
the smallest start, then the smallest period, comes first. Each row is judged for itself, so repeated rows and ids do
not matter; a null id stays null. A text is taken whole, however long: a task holds about 4 bytes per word and
doubling round (log2 of the longest repeat) of one batch. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import read, slices, text_or_empty

#: A run has this many words at least, and this many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Bytes of text that share a suffix array, unless one text is longer.
PIECE = 2 << 20

Prepare = Callable[["int | None", list[bytes]], list[bytes]]


class _Codes(dict):
    """Numbers words from 1 on as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) + 1
        return code


def symbols_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, one end mark behind each text, and each text's first place (with the total).

    Numbers are equal for equal words of one text only; an end mark equals nothing.
    """
    code = _Codes()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.zeros(bounds[-1], np.int64)
    for words, at in zip(texts, bounds[:-1].tolist()):
        flat[at : at + len(words)] = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    return flat + np.repeat(np.arange(len(texts)), sizes) * (len(code) + 1), bounds


def block_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: how many places start a lesser block of 2^k words than place i does; all differ in the last round."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order[1:]] != symbols[order[:-1]]))
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int32)
    rank[order] = first[group]
    ranks = [rank]
    alone = np.diff(np.append(first, n)) == 1
    open_ = order[~alone[group]]  # places whose block stands elsewhere too, in the order of their ranks
    width = 1
    while len(open_):
        old = rank[open_].astype(np.int64)
        key = old * n + rank[open_ + width]
        order = np.argsort(key, kind="stable")
        key, old, open_ = key[order], old[order], open_[order]
        at = np.arange(len(key))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        outer = np.concatenate(([True], old[1:] != old[:-1]))
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        ranks.append(rank)
        first = np.flatnonzero(new)
        alone = np.diff(np.append(first, len(key))) == 1
        open_ = open_[~alone[np.cumsum(new) - 1]]
        width *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """lcp[j] for the suffixes order[j - 1] and order[j]; 0 at both ends."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int32)
    at = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    a, b = order[at - 1], order[at]
    length = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        length[ranks[k][a + length] == ranks[k][b + length]] += 1 << k
    lcp[at] = length
    return lcp


def extensions(ranks: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words before the places `one` and `other` are equal, counted to the left."""
    length = np.zeros(len(one), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        a, b = one - length - (1 << k), other - length - (1 << k)
        equal = (a >= 0) & (b >= 0)
        equal[equal] = ranks[k][a[equal]] == ranks[k][b[equal]]
        length[equal] += 1 << k
    return length


def _children(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place j in `at`: the nearest place before it with lcp <= lcp[j], the nearest behind it with lcp < lcp[j].

    Between a place and the one it points to, all values are larger (or as large), so pointers are followed by jumps.
    """
    before, behind = np.arange(len(lcp)) - 1, np.arange(len(lcp)) + 1
    open_ = at[lcp[before[at]] > lcp[at]]
    while len(open_):
        before[open_] = before[before[open_]]
        open_ = open_[lcp[before[open_]] > lcp[open_]]
    open_ = at[lcp[behind[at]] >= lcp[at]]
    while len(open_):
        behind[open_] = behind[behind[open_]]
        open_ = open_[lcp[behind[open_]] >= lcp[open_]]
    return before[at], behind[at]


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) for every two equal stretches of d words at i and i + d which the next words do not continue."""
    at = np.flatnonzero(lcp)
    low, high = _children(lcp, at)
    left_smaller = at - low <= high - at
    start = np.where(left_smaller, low, at)
    sizes = np.where(left_smaller, at - low, high - at)
    there_low, there_high = np.where(left_smaller, at, low), np.where(left_smaller, high, at)
    found_i, found_d = [], []
    ends = np.cumsum(sizes)
    step = 1 << 22  # tests at a time, unless one interval has more
    for a, b in _portions(ends, step):
        of = np.repeat(np.arange(a, b), sizes[a:b])
        offset = np.arange(len(of)) - np.repeat(ends[a:b] - sizes[a:b] - (ends[a - 1] if a else 0), sizes[a:b])
        i, d = order[start[of] + offset], lcp[at[of]].astype(np.int64)
        for first, second in ((i, i + d), (i - d, i - d)):
            ok = second >= 0
            place = inverse[second[ok]]
            hit = (place >= there_low[of[ok]]) & (place < there_high[of[ok]])
            found_i.append(first[ok][hit])
            found_d.append(d[ok][hit])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_d)


def _portions(ends: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
        yield a, b
        a = b


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text (a list of words) its runs (start, length, period), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    symbols, bounds = symbols_of(texts)
    if not len(symbols):
        return found
    ranks = block_ranks(symbols)
    inverse = ranks[-1]
    order = np.empty(len(inverse), np.int64)
    order[inverse] = np.arange(len(inverse))
    square, period = branching_squares(order, inverse, common_prefixes(ranks, order))
    left = extensions(ranks, square, square + period)
    start, length = square - left, left + 2 * period
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(by), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of = np.searchsorted(bounds, start, side="right") - 1
    for k, s, n, q in zip(of[first].tolist(), (start - bounds[of])[first].tolist(), length[first].tolist(), period[first].tolist()):
        found[k].append((s, n, q))
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties to the smallest start, then period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [word for word, held in zip(words, np.cumsum(change[:-1]).tolist()) if not held]


def _examined(batch: pa.RecordBatch, prepare: Prepare | None) -> Iterator[tuple[pa.Array, list, list]]:
    """(ids, words, runs) for some texts at a time."""
    for part in slices(batch, "text", PIECE):
        ids, texts = part.column("doc_id"), part.column("text").to_pylist()
        words = [text.encode("utf-8").split() for text in texts]
        if prepare:
            words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words)]
        yield ids, words, find_runs(words)


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))


def runs_and_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Prepare | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: its runs and its text without what they repeat, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            for ids, words, runs in _examined(batch, prepare):
                lists = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
                rest = [b" ".join(kept_words(w, r)).decode("utf-8") for w, r in zip(words, runs)]
                arrays = [ids, pa.array(lists, kind), pa.array(rest, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return _chosen(docs, id_col, text_col).mapInArrow(run, schema)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Prepare | None = None) -> DataFrame:
    """The strongest run of every document and digests of all its runs and of the collapsed text.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).
    """
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    names = ["doc_id", *longs, "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, runs in _examined(batch, prepare):
                figures, listed, rest = [], [], []
                for own, each in zip(words, runs):
                    best = strongest(each)
                    figures.append((len(each), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
                    lines = "".join([f"{s},{n},{q}\n" for s, n, q in each])
                    listed.append(hashlib.sha256(lines.encode()).hexdigest())
                    rest.append(hashlib.sha256(b" ".join(kept_words(own, each))).hexdigest())
                arrays = [ids, *(pa.array(column, pa.int64()) for column in zip(*figures)), pa.array(listed), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id long, {', '.join(f'{name} long' for name in longs)}, runs_sha256 string, collapsed_sha256 string"
    return _chosen(docs, id_col, text_col).mapInArrow(run, schema)


def periodic_tenth(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which those of every tenth document (by the checksum of its id) are made periodic from some word on."""
    if doc_id is None or not words:
        return words
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10:
        return words
    g, n = checksum // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    again = words[start : start + period]
    whole, rest = divmod(n - start, len(again))
    return words[:start] + again * whole + again[:rest]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"), prepare=periodic_tenth)
