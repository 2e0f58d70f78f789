"""Token lengths by a tokenizer file, as an iterator UDF that loads the file once per Python worker."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


#: Characters of the texts that are encoded together; an encoding takes some hundred bytes a token.
PIECE = 1 << 18


@lru_cache(maxsize=2)
def _load(file: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(file)
    found.no_truncation()
    found.no_padding()
    return found


def pieces(texts: pd.Series, most: int = PIECE) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of at most `most` characters; a longer text is a list by itself."""
    held, chars = [], 0
    for text in texts.fillna(""):
        if held and chars + len(text) > most:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_token_length(file: str | None = None):
    """A column function text -> number of tokens, without truncation; null for null.

    Its attribute `ids` gives the tokens' ids for a text, and `inside(text, spans)` the number of tokens that lie wholly
    within one of the spans (start, stop: characters, in order and apart); the first token never counts.
    """
    path = file or default_file()

    def encoded(texts: pd.Series) -> Iterator:
        """One encoding per text; those of one piece are held at a time, whatever the size of Spark's batch."""
        for piece in pieces(texts):
            yield from _load(path).encode_batch(piece, add_special_tokens=False)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            lengths = pd.Series([len(e.ids) for e in encoded(texts)], dtype="Int64")
            yield lengths.where(texts.notna().to_numpy(), other=pd.NA)

    @F.pandas_udf("array<long>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([e.ids if there else None for e, there in zip(encoded(texts), texts.notna())])

    @F.pandas_udf("long")
    def inside(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([tokens_inside(e.offsets, own) if own is not None else None for e, own in zip(encoded(texts), spans)], dtype="Int64")

    run.ids, run.inside, run.fingerprint = ids, inside, f"file-{os.path.basename(path)}"
    return run


def tokens_inside(offsets: list[tuple[int, int]], spans) -> int:
    """How many tokens but the first lie wholly within a span; offsets and spans are in order."""
    places = np.array(offsets[1:], np.int64).reshape(-1, 2)
    starts, stops = np.maximum.accumulate(places[:, 0]) if len(places) else places[:, 0], places[:, 1]
    total = 0
    for span in spans:
        first, last = np.searchsorted(starts, span["start"], "left"), np.searchsorted(stops, span["stop"], "right")
        total += max(0, int(last - first))
    return total
