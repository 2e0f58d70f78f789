"""Lengths of texts: SQL tokens, bytes, characters; size checks of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII words, and every other character that is not white space. The same in Java and RE2.
TOKENS = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]"


def token_length(text: Column | str, by: str | Callable[[Column], Column] = "tokens") -> Column:
    """The untruncated length of a text by the SQL tokenizer, in bytes or in characters; null for null.

    `by` may be any function from a text column to a count, such as tokenizer.file_token_length().
    """
    text = F.col(text) if isinstance(text, str) else text
    if callable(by):
        return by(text).cast("long")
    if by == "tokens":
        return F.regexp_count(text, F.lit(TOKENS)).cast("long")
    return {"bytes": F.octet_length, "chars": F.length}[by](text).cast("long")


def tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def token_ids(text: Column | str, by: str | Callable[[Column], Column] = "tokens") -> Column:
    """What the text is to the tokenizer, as strings: ids of a tokenizer file, else each token's bytes in hexadecimal.

    A counting function tells its ids by an attribute `ids`; without it they are unknown, so null.
    """
    text = F.col(text) if isinstance(text, str) else text
    if callable(by):
        return by.ids(text).cast("array<string>") if hasattr(by, "ids") else F.lit(None).cast("array<string>")
    if by == "bytes":
        return F.regexp_extract_all(F.hex(text), F.lit(".."), F.lit(0))
    each = tokens(text) if by == "tokens" else F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.transform(each, lambda t: F.hex(t))


def _chars(column: Column, kind: T.DataType) -> Column:
    """Characters in all strings nested in a value."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x: _chars(x, kind.elementType))
        return F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_chars(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return _chars(F.map_keys(column), T.ArrayType(kind.keyType)) + _chars(F.map_values(column), T.ArrayType(kind.valueType))
    return F.lit(0).cast("long")


def row_chars(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Characters over all nested strings of a row."""
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    return sum((_chars(F.col(f"`{f.name}`"), f.dataType) for f in chosen), F.lit(0).cast("long"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's top-level string and binary columns."""
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in chosen), F.lit(0).cast("long"))


def safe_shard_id(shard: Column | str) -> Column:
    """An absolute path is reduced to its base name."""
    shard = F.col(shard) if isinstance(shard, str) else shard
    absolute = shard.rlike(r"^(/|[A-Za-z]:[\\/])")
    return F.when(absolute, F.regexp_extract(shard, r"([^/\\]*)[/\\]*$", 1)).otherwise(shard)
