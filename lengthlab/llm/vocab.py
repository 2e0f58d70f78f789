"""Encoders over public vocabulary files; the file is a parameter and each Python worker loads it once."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers

END_OF_TEXT = "<|endoftext|>"


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_encoder(file: str):
    """A byte-level encoder; the merges are the ranks of the file, the end-of-text id follows them."""
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)}
    )
