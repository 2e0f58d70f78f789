"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

A license is scanned for by its short notices and by every paragraph of its whole text (license_texts/*.txt). Both
are cut into words; their runs of GRAM words, winnowed, form an inverted index from hash to (paragraph, place). A
document's words are mapped to the templates' vocabulary; runs without an unknown word are hashed and winnowed the
same way, so any WINDOW + GRAM - 1 words in common share a selected run. A notice of fewer than SHORT words may have
no such run left; it is indexed by single words instead, the rarest of its own in all templates, one more of them than
it may lack, so one is always there. Hits of one paragraph on nearby diagonals make a candidate region; where it has as
many hits as a paragraph must keep of which a fifth of the words are changed, left out or put in, a local alignment within a
band around the diagonals (match 2, mismatch or gap -1) finds the best common stretch, with its matched words and span.
Rows are reported where the matched share of the paragraph reaches MIN_COVERAGE; `license_coverage` is the share of the
whole license that a document holds.

The index holds the templates only (a parameter, some hundreds of paragraphs), so each task has it whole;
documents never move, and work per document grows with its own length. Of regions with equal scores the one that
ends first is reported; a paragraph that several licenses have is reported for each. Null text counts as empty, very
long texts are scanned whole; repeated rows are each scanned; an empty table or no match gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import read, slices, text_or_empty

GRAM = 3
WINDOW = 2
#: Widest band; a short template has a narrower one, so that two copies in a row stay apart.
BAND = 8
MIN_COVERAGE = 0.8

#: Templates with fewer words are indexed by words.
SHORT = 20
#: Words that a paragraph of a whole text has at least; shorter ones are joined to the next.
PARAGRAPH = 20

# Wording of public license notices; whole texts are in license_texts.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
    "version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
    "http://www.boost.org/LICENSE_1_0.txt)",
}

WORD = re.compile(r"\w+")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def default_templates() -> dict[str, list[str]]:
    """Notices and whole texts, each as its paragraphs."""
    found: dict[str, list[str]] = {name: [text] for name, text in TEMPLATES.items()}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        paragraphs, held = [], ""
        for part in re.split(r"\n\s*\n", path.read_text(encoding="utf-8")):
            held = f"{held} {part}"
            if len(WORD.findall(held)) >= PARAGRAPH:
                paragraphs.append(held)
                held = ""
        if held.strip():
            paragraphs[-1:] = [f"{paragraphs[-1]} {held}"] if paragraphs else [held]
        found[path.stem] = paragraphs
    return found


class Index:
    """Winnowed fingerprints of the templates' paragraphs; equal paragraphs are held once."""

    def __init__(self, templates: dict[str, str | list[str]]):
        self.owners: list[list[tuple[str, int]]] = []
        self.total: dict[str, int] = {}
        unit_of: dict[tuple[str, ...], int] = {}
        for name, text in templates.items():
            listed = [WORD.findall(t.lower()) for t in ([text] if isinstance(text, str) else text)]
            self.total[name] = sum(map(len, listed))
            for part, words in enumerate(listed):
                unit = unit_of.setdefault(tuple(words), len(unit_of))
                self.owners[unit:] = self.owners[unit:] or [[]]
                self.owners[unit].append((name, part))
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in unit_of for w in words))}
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for words in unit_of]
        often = Counter(i for ids in self.words for i in set(ids.tolist()))
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        single: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            if len(ids) < SHORT:
                rare = sorted(set(ids.tolist()), key=lambda i: (often[i], i))
                lacking = len(ids) - int(np.ceil(MIN_COVERAGE * len(ids)))  # occurrences that may be missing
                counted, held = 0, set()
                for i in rare:
                    held.add(i)
                    counted += int((ids == i).sum())
                    if counted > lacking:
                        break
                for at, i in enumerate(ids.tolist()):
                    if i in held:
                        single[i].append((t, at))
            else:
                for at, key in zip(*(x.tolist() for x in self.selected(ids))):
                    places[key].append((t, at))
        self.places, self.single = dict(places), dict(single)
        self.keys = np.array(sorted(self.places), np.uint64)
        self.alone = np.zeros(len(self.vocabulary) + 1, bool)  # the last place is that of unknown words
        self.alone[list(self.single)] = True
        self.bands = [max(1, min(BAND, len(ids) - 1)) for ids in self.words]
        # Of the runs of GRAM + WINDOW - 1 words each change spoils as many; a selected run stands for WINDOW of the rest.
        span = GRAM + WINDOW - 1
        self.least = [1 if len(ids) < SHORT else max(1, int(((1 - 0.2 * span) * len(ids) - span + 1) / WINDOW)) for ids in self.words]

    def selected(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the winnowed runs of GRAM known words (-1: unknown)."""
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = np.ones(n, bool)
        key = np.zeros(n, np.uint64)
        for k in range(GRAM):
            part = ids[k : k + n]
            known &= part >= 0
            key = _mixed(key * np.uint64(1_000_003) + part.astype(np.uint64) + np.uint64(1))
        key = np.where(known, key, np.uint64(2**64 - 1))
        chosen = np.zeros(n, bool)
        width = min(WINDOW, n)
        windows = np.lib.stride_tricks.sliding_window_view(key, width)
        chosen[np.arange(len(windows)) + width - 1 - np.argmin(windows[:, ::-1], axis=1)] = True
        # Runs with an unknown word hash to the maximum, so a window that holds a known run selects a known one.
        chosen &= known
        return np.flatnonzero(chosen), key[chosen]

    def regions(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of groups of hits; a diagonal is document place - template place."""
        at, keys = self.selected(ids)
        hit = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys if len(self.keys) else keys < 0
        diagonals: dict[int, Counter[int]] = defaultdict(Counter)
        for place, key in zip(at[hit].tolist(), keys[hit].tolist()):
            for t, own in self.places[key]:
                diagonals[t][place - own] += 1
        for place in np.flatnonzero(self.alone[ids]).tolist():
            for t, own in self.single[int(ids[place])]:
                diagonals[t][place - own] += 1
        for t, found in diagonals.items():
            low = high = None
            hits = 0
            for d in sorted(found):
                if low is not None and d - high > self.bands[t]:
                    if hits >= self.least[t]:
                        yield t, low, high
                    low, hits = None, 0
                low, high, hits = d if low is None else low, d, hits + found[d]
            if hits >= self.least[t]:
                yield t, low, high

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first and last matched document word), best per region."""
        found = []
        for t, low, high in self.regions(ids):
            window = ids[max(0, low - self.bands[t]) : len(self.words[t]) + high + self.bands[t] + 1]
            there = np.zeros(len(self.vocabulary) + 1, bool)
            there[window] = True  # unknown words (-1) mark the last place, which is no word
            if there[self.words[t]].sum() < MIN_COVERAGE * len(self.words[t]):
                continue  # no alignment can match enough of the words
            best = align(self.words[t].tolist(), ids, low - self.bands[t], high + self.bands[t])
            if best and best[0] >= MIN_COVERAGE * len(self.words[t]):
                found.append((t, *best))
        return sorted(set(found))


def align(template: list[int], ids: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """Best local alignment with low <= document place - template place <= high.

    Gives (matched words, first and last matched document word); None if nothing matches. Ties: the
    alignment that ends first.
    """
    n, width = len(ids), high - low + 1
    # By diagonal, with one cell of margin on either side: (score, matched words, first matched place).
    state = [(0, 0, 0)] * (width + 2)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row = [(0, 0, 0)] * (width + 2)
        for d in range(width):
            j = i + low + d
            if j < 0 or j >= n:
                continue
            same = ids[j] == word
            s, m, first = state[d + 1]
            cell = (s + 2, m + 1, first if m else j) if same else (s - 1, m, first)
            for s, m, first in (state[d + 2], row[d]):  # a template word or a document word left out
                if s - 1 > cell[0]:
                    cell = (s - 1, m, first)
            if cell[0] <= 0:
                cell = (0, 0, 0)
            row[d + 1] = cell
            if same and cell[0] > best[0]:
                best = (*cell, j)
        state = row
    return (best[1], best[2], best[3]) if best[1] else None


def scan(
    docs: DataFrame, templates: dict[str, str | list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per paragraph found: license, number of the paragraph, coverage of both, matched words and offsets in code points."""
    chosen_templates = dict(templates) if templates else default_templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen_templates)
        known = index.vocabulary.get
        for whole in batches:
            for batch in slices(whole, "text", 1 << 23):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([known(w, -1) for w in WORD.findall(text.lower())], np.int64)
                    found = index.matches(ids)
                    if not found:
                        continue
                    spans = [m.span() for m in WORD.finditer(text)]
                    if len(spans) != len(ids):  # lower-casing changed the words' number: cut the text as lowered
                        spans = [m.span() for m in WORD.finditer(text.lower())]
                    most: dict[int, int] = {}
                    for t, matched, _, _ in found:
                        most[t] = max(matched, most.get(t, 0))
                    held: Counter[str] = Counter()
                    for t, matched in most.items():
                        for name, _ in index.owners[t]:
                            held[name] += matched
                    for t, matched, first, last in found:
                        total = len(index.words[t])
                        for name, part in index.owners[t]:
                            share = held[name] / index.total[name]
                            out.append((doc_id, name, part, matched / total, share, matched, total, spans[first][0], spans[last][1]))
                columns = list(zip(*out)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    kinds = {
        "doc_id": pa.int64(), "license": pa.string(), "part": pa.int32(), "coverage": pa.float64(), "license_coverage": pa.float64(),
        "matched_words": pa.int32(), "template_words": pa.int32(), "start": pa.int64(), "stop": pa.int64(),
    }
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return columns.mapInArrow(
        run,
        "doc_id long, license string, part int, coverage double, license_coverage double, matched_words int, "
        "template_words int, start long, stop long",
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
