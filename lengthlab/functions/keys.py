"""Digests and layered keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(columns: dict[str, Column]) -> Column:
    """sha256 of the record as JSON with sorted fields; null fields stay in it."""
    record = F.struct(*[columns[name].alias(name) for name in sorted(columns)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def token_digest(sequences: dict[str, Column]) -> Column:
    """sha256 over "name:id,id,...\\n" of each token array, in name order."""
    lines = [F.concat(F.lit(f"{name}:"), F.array_join(sequences[name], ","), F.lit("\n")) for name in sorted(sequences)]
    return F.sha2(F.concat(*lines), 256)


def stable_key(prefix: str, *parts: Column) -> Column:
    """A prefixed sha256 of the parts; a part that is another key makes the keys a chain."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(joined, 256))
