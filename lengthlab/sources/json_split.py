"""Elements of JSON documents of any size: a file is scanned by many tasks although it has no record boundaries.

Spark's text reader splits a file at any mark, here the comma, so each task gets a run of pieces of a block and its first
byte follows a comma. What stands there is not known: the block may begin inside a string and at any depth. A
quote is real unless an odd run of backslashes stands before it, and no backslash stands before a comma that starts a
block, so there are two start states:

1. Each block is read under both: the state at its end, how deep it leads, and its structural commas by depth relative to
   its start. The result is a few numbers per block.
2. The numbers of a file's blocks are composed in order, which gives every block its true state, depth and the number of
   the element in which it begins.
3. Each block is read again and cut at the commas of the wanted depth. Elements that cross a block's edge come out as
   fragments and are joined; all others never leave their task before they are parsed.

An element that lacks its end, because the file is cut, stays unfinished and is told apart from the whole ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (blocks or files) of a table that may be broadcast; a block of 128 MB has one row.
MAX_BROADCAST = 1_000_000
QUOTE, SLASH, COMMA = b'"\\,'
STEP = np.zeros(256, np.int8)
STEP[list(b"[{")] = 1
STEP[list(b"]}")] = -1
BLANK = b" \t\r\n"

SUMMARY = "path string, block long, opening string, inside array<boolean>, deeper array<long>, depths array<array<long>>, commas array<array<long>>, last array<array<long>>"


def _pieces(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, block, piece): what stands between commas, in the order of the file within a task."""
    rows = spark.read.option("lineSep", ",").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], dict, bytes]]:
    """((path, block), the other columns of its first row, bytes) for stretches of a block that lie in one batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch.column("path").to_pylist(), batch.column("block").to_pylist()
        names = list(zip(paths, blocks))
        starts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for a, b in zip(starts[:-1], starts[1:]):
            pieces = batch.column("piece").slice(a, b - a).to_pylist()
            other = {n: batch.column(n)[a].as_py() for n in batch.schema.names if n not in ("path", "block", "piece")}
            yield names[a], other, b",".join(pieces) + b","


def _structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """The change of depth at each byte, the structural commas, and whether the end lies in a string."""
    place = np.arange(len(data))
    quotes = np.flatnonzero(data == QUOTE)
    plain = np.maximum.accumulate(np.where(data != SLASH, place, -1))
    before = np.where(quotes > 0, plain[quotes - 1], -1)
    real = quotes[(quotes - 1 - before) % 2 == 0]
    toggles = np.zeros(len(data), np.uint8)
    toggles[real] = 1
    within = (np.cumsum(toggles, dtype=np.int64) + inside) % 2 == 1
    return np.where(within, 0, STEP[data]), (data == COMMA) & ~within, bool(within[-1])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: the state and depth at its end and its commas by depth, for a start outside and inside a string."""
    kinds = [pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int64()))] * 3]

    def row(name: tuple[str, int], opening: str, state: list) -> pa.RecordBatch:
        depths = [sorted(set(s["all"]) | set(s["last"])) for s in state]
        columns = [[s["inside"] for s in state], [s["depth"] for s in state], depths]
        columns += [[[s[k][d] for d in own] for s, own in zip(state, depths)] for k in ("all", "last")]
        arrays = [pa.array([name[0]]), pa.array([name[1]], pa.int64()), pa.array([opening])]
        arrays += [pa.array([c], kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["path", "block", "opening", "inside", "deeper", "depths", "commas", "last"])

    now, opening, state = None, "", []
    for name, _, text in _runs(batches):
        if name != now:
            if now:
                yield row(now, opening, state)
            now, opening = name, ""
            state = [{"inside": bool(k), "depth": 0, "all": Counter(), "last": Counter()} for k in (0, 1)]
        opening = opening or text.removeprefix(b"\xef\xbb\xbf").lstrip(BLANK)[:1].decode("ascii", "replace")
        data = np.frombuffer(text, np.uint8)
        for s in state:
            step, commas, s["inside"] = _structure(data, s["inside"])
            depth = s["depth"] + np.cumsum(step, dtype=np.int64)
            s["depth"] = int(depth[-1])
            at = depth[commas]
            for d in np.unique(at).tolist():
                s["all"][d] += int((at == d).sum())
            for d in np.unique(np.concatenate((at, at - 1))).tolist():  # commas one deeper since the last at this depth
                here = np.flatnonzero(at == d)
                since = int((at[here[-1] + 1 if len(here) else 0 :] == d + 1).sum())
                s["last"][d] = since if len(here) else s["last"][d] + since
    if now:
        yield row(now, opening, state)


def _starts(level: int):
    """For the rows of a file's blocks: the true state, depth, section and element at the start of each."""
    import pandas as pd

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", ignore_index=True)
        inside, depth, section, element, out = False, 0, 0, 0, []
        for row in blocks.itertuples():
            out.append((row.path, row.block, blocks.opening[0], inside, depth, section, element))
            k = int(inside)
            count = dict(zip(map(int, row.depths[k]), map(int, row.commas[k])))
            last = dict(zip(map(int, row.depths[k]), map(int, row.last[k])))
            if level == 2 and count.get(1 - depth):
                section, element = section + count[1 - depth], last.get(1 - depth, 0)
            elif level == 2:
                element += count.get(2 - depth, 0)
            else:
                element += count.get(1 - depth, 0)
            inside, depth = bool(row.inside[k]), depth + int(row.deeper[k])
        return pd.DataFrame(out, columns=["path", "block", "opening", "inside", "depth", "section", "element"])

    return run


def _cut(level: int, headers: bool):
    """A function over batches of pieces with their block's start, which gives elements or what stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, held, body, depth, inside, section, element, first = None, b"", False, 0, False, 0, 0, False

        def give(last: bool, text: bytes) -> None:
            if body != headers:
                rows.append((now[0], now[1], section, element if body else 0, first, last, text))

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                kinds = [pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.binary()]
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                rows.clear()
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "block", "section", "element", "first", "last", "text"])

        for name, start, text in _runs(batches):
            if name != now:
                if now:
                    give(False, held)
                now, held, first = name, b"", start["block_first"]
                inside, depth, section, element = (start[k] for k in ("inside", "depth", "section", "element"))
                body = depth >= level
            data = np.frombuffer(text, np.uint8)
            step, commas, inside = _structure(data, inside)
            deep = depth + np.cumsum(step, dtype=np.int64)
            depth = int(deep[-1])
            opens, closes = (step == 1) & (deep == level), (step == -1) & (deep == level - 1)
            cuts = commas & ((deep == level) | ((deep == 1) if level == 2 else False))
            at = 0
            for p in np.flatnonzero(opens | closes | cuts).tolist():
                if opens[p]:
                    give(True, held + text[at : p + 1])
                    body, first = True, True
                elif closes[p]:
                    own = held + text[at:p]
                    if element or own.strip(BLANK) or not first:
                        give(True, own)
                    body, first = False, True
                elif deep[p] == level:
                    give(True, held + text[at:p])
                    element, first = element + 1, True
                else:
                    give(True, held + text[at:p])
                    section, element, first = section + 1, 0, True
                held, at = b"", p + 1
            held += text[at:]
            yield from flushed(5000)
        if now:
            give(False, held)
        yield from flushed(1)

    return run


def _joined(rows: DataFrame, table: DataFrame, on: list[str], order: list[str] = []) -> DataFrame:
    """rows with a narrow table of blocks or files: broadcast if it is small, else shuffled and put in order again."""
    if table.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(table), on)
    joined = rows.join(table, on)
    return joined.sortWithinPartitions(*order) if order else joined


def split_elements(spark: SparkSession, paths: list[str] | str, level: int, store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, headers, files): level 1 cuts the array that a file holds, level 2 those below the keys of an object.

    elements (path, section, element, text, whole): text is binary, whole is false where the file ends within the element.
    headers (path, section, text): what stands before the elements of a section. files (path, opening): its first
    character that is no white space. store(df, name) writes a small table and reads it again.
    """
    pieces = _pieces(spark, paths)
    summary = store(pieces.mapInArrow(_summary, SUMMARY), "blocks")
    schema = "path string, block long, opening string, inside boolean, depth long, section long, element long"
    starts = store(summary.groupBy("path").applyInPandas(_starts(level), schema), "starts")
    first = F.expr("block = 0").alias("block_first")
    placed = pieces.withColumn("rid", F.monotonically_increasing_id())
    placed = _joined(placed, starts.select("*", first), ["path", "block"], ["path", "block", "rid"]).drop("rid")
    columns = placed.select("path", "block", "piece", "block_first", "inside", "depth", "section", "element")
    cut = "path string, block long, section long, element long, first boolean, last boolean, text binary"
    out = []
    for headers in (False, True):
        rows = columns.mapInArrow(_cut(level, headers), cut)
        parts = rows.where("not (first and last)").groupBy("path", "section", "element").agg(
            F.array_sort(F.collect_list(F.struct("block", "first", "text"))).alias("x"), F.max("last").alias("whole")
        )
        text = F.aggregate("x.text", F.lit(b""), lambda a, b: F.concat(a, b)).alias("text")
        done = rows.where("first and last").select("path", "section", "element", "text", F.lit(True).alias("whole"))
        out.append(done.unionByName(parts.select("path", "section", "element", text, "whole")))
    return out[0], out[1].select("path", "section", "text"), starts.where("block = 0").select("path", "opening")
