"""BPE encoding and decoding by batched merge rounds in numpy.

A batch's texts are normalised and cut into words; each word not seen before goes, as byte symbols, into
one flat array. In each round the pairs of neighbouring symbols of all words are looked up at once, by
binary search over the sorted pair keys; in every word the lowest-ranked pair is merged wherever it stands
(left to right, without overlap), until no word holds a known pair. Words of more than LONG bytes, whose
rounds would each read the whole word again, share a flat array of their own: a round takes the lowest rank
that stands anywhere in it and looks only at the neighbours of what was merged. Results per word are kept in a bounded
dictionary per Python worker, which only saves time.

The vocabulary file is of the "word" kind: texts are composed (NFC), white space becomes one space, letters
lower case; words are cut by a fixed pattern; the last symbol of a word carries an end mark. The strings of
special tokens in a text become their ids, as the public library does by default. Decoding joins the token
strings with single spaces, as a file without a decoder asks.

A very long text, or one very long word, takes time in proportion to its length. Ranks are distinct, so the
only ties are between places of one pair, which go from the left. Null texts count as empty (no ids; hashes of the empty string); repeated rows are encoded alike; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lengthlab.llm import vocab
from lengthlab.llm.common import read, slices, text_or_empty

#: Words whose ids a worker remembers at most; the dictionary is emptied beyond it.
REMEMBERED = 1 << 19
#: Bytes of a word from which on its rounds look only at what has changed.
LONG = 256
#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 22


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown, spare = [], 256
    for byte in range(256):
        if byte in printable:
            shown.append(chr(byte))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


class WordBpe:
    """The encoder over one vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.first = np.array([ids[s] for s in byte_symbols()], np.int64)
        self.last = np.array([ids[s + end] for s in byte_symbols()], np.int64)
        self.size = max(self.tokens) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.made_by_rank = made
        self.known: dict[str | tuple[str], tuple[int, str, str]] = {}
        from tokenizers import Tokenizer

        self.normalise_any = Tokenizer.from_file(file).normalizer.normalize_str

    def normalise(self, text: str) -> str:
        """Lower case and NFC; white space may stay as it is, for words never hold it."""
        if text.isascii():
            return text.lower()
        if max(text) < "ƀ" and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.normalise_any(text)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (none empty) in one array, and where each word's ids begin and the last ends."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        ids = self.first[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        settled: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            pairs = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            found = (self.keys[at] == pairs) & (word[:-1] == word[1:])
            rank = np.where(found, self.ranks[at], len(self.keys))
            lowest = np.full(len(words), len(self.keys), np.int64)
            np.minimum.at(lowest, word[:-1], rank)
            open_ = lowest[word] < len(self.keys)
            if not open_.all():  # words without a known pair are finished
                settled.append((word[~open_], ids[~open_]))
                rank, made = rank[open_[:-1]], self.made[at][open_[:-1]]
                ids, word = ids[open_], word[open_]
                if len(rank) == len(ids):
                    rank, made = rank[:-1], made[:-1]
                if not len(ids):
                    break
            else:
                made = self.made[at]
            hit = np.flatnonzero(rank == lowest[word[:-1]])
            # In a run of overlapping hits (a a a) every second one, from the left, is merged.
            begins = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = made[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        all_words = np.concatenate([w for w, _ in settled]) if settled else np.zeros(0, np.int64)
        all_ids = np.concatenate([i for _, i in settled]) if settled else np.zeros(0, np.int64)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.searchsorted(all_words[order], np.arange(len(words) + 1))

    def merged_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as merged(), in time that grows with the length of the words and not with its square.

        Places of pairs wait in a list for each rank. A place whose pair has changed since is known by its present
        rank and passed over, so lists are never searched.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        n, none = len(flat), len(self.keys)
        ids = np.append(self.first[flat], 0)
        ids[ends - 1] = self.last[flat[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n is beyond the end of every word
        after[ends - 1] = after[n] = n
        before[ends - sizes] = before[n] = n
        rank = np.full(n + 1, none, np.int64)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            """Looks up the pairs that begin at these places and lets them wait under their ranks."""
            pairs = ids[places] * self.size + ids[after[places]]
            at = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            found = np.where((self.keys[at] == pairs) & (after[places] < n), self.ranks[at], none)
            rank[places] = found
            known = found < none
            found, places = found[known], places[known]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, group in zip(found[np.append(0, cuts)].tolist() if len(found) else (), np.split(places, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(group)

        look(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            hit = np.unique(np.concatenate(waiting.pop(lowest)))
            hit = hit[rank[hit] == lowest]
            if not len(hit):
                continue
            # In a run of overlapping hits (a a a) every second one, from the left, is merged.
            begins = np.concatenate(([True], after[hit[:-1]] != hit[1:]))
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            gone = after[hit]
            ids[hit] = self.made_by_rank[lowest]
            alive[gone] = False
            rank[gone] = none
            after[hit] = after[gone]
            before[after[hit]] = hit
            changed = np.unique(np.concatenate((hit, before[hit])))
            look(changed[changed < n])
        return ids[:-1][alive], np.append(0, np.cumsum(alive)[ends - 1])

    def learn(self, words: set[str]) -> None:
        """Encodes the words and remembers (number of ids, ids joined, tokens joined)."""
        coded = {w: w.encode("utf-8") for w in words}
        for merge, listed in ((self.merged, [w for w in words if len(coded[w]) <= LONG]), (self.merged_long, [w for w in words if len(coded[w]) > LONG])):
            if not listed:
                continue
            ids, bounds = merge([coded[w] for w in listed])
            shown = list(map(str, ids.tolist()))
            tokens = list(map(self.tokens.__getitem__, ids.tolist()))
            bounds = bounds.tolist()
            for word, a, b in zip(listed, bounds, bounds[1:]):
                self.known[word] = (b - a, " ".join(shown[a:b]), " ".join(tokens[a:b]))

    def pieces(self, text: str) -> list[str | tuple[str]]:
        """The words of a text in order; a special token is a piece of its own, a tuple that holds its string."""
        if self.special_cut is None or "<|" not in text:
            return self.words.findall(self.normalise(text))
        out: list[str | tuple[str]] = []
        for part in self.special_cut.split(text):
            if part in self.special:
                out.append((part,))
            else:
                out += self.words.findall(self.normalise(part))
        return out

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """Per text, one (number of ids, ids joined, tokens joined) for each of its pieces."""
        cut = [self.pieces(t) for t in texts]
        wanted = set().union(*cut) if cut else set()
        new = {w for w in wanted if w not in self.known and isinstance(w, str)}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for w in wanted if isinstance(w, str)}
        self.learn(new)
        known = self.known
        for name, i in self.special.items():
            known[(name,)] = (1, str(i), name)
        return [[known[w] for w in words] for words in cut]


@lru_cache(maxsize=1)
def encoder(file: str) -> WordBpe:
    return WordBpe(file)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and what they decode to."""
    file = vocabulary or vocab.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                found = own.encode_all(batch.column("text").to_pylist())
                ids = [[int(i) for _, joined, _ in words for i in joined.split(" ")] for words in found]
                text = [" ".join([t for _, _, t in words]) for words in found]
                arrays = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, without moving the ids."""
    file = vocabulary or vocab.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts, ids, texts = [], [], []
                for words in own.encode_all(batch.column("text").to_pylist()):
                    counts.append(sum([n for n, _, _ in words]))
                    ids.append(hashlib.sha256(" ".join([i for _, i, _ in words]).encode()).hexdigest())
                    texts.append(hashlib.sha256(" ".join([t for _, _, t in words]).encode("utf-8")).hexdigest())
                arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
