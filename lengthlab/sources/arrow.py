"""Data sources over files that executors can open by path: Arrow files by record batch, text files by byte range.

For stores that only Spark reads, `scan_arrow` and `scan_compressed_text` get whole files through Spark's own access.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lengthlab.sources import members

#: Bytes of a text file that one task reads.
SPLIT = 64 << 20
#: Lines of a batch.
BATCH = 5000


def _opened(path: str):
    """An open file and its size, on any file system that Arrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(path)


class _Part(InputPartition):
    """A file, or the record batches or bytes start..stop of it."""

    def __init__(self, path: str, start: int | None = None, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


class _ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self) -> list[_Part]:
        """A part per record batch of the file form, whose footer tells how many there are; a stream is one part."""
        parts = []
        for path in self.paths:
            with _opened(path) as source:
                if source.read(6) != b"ARROW1":
                    parts.append(_Part(path))
                    continue
                batches = pa.ipc.open_file(source).num_record_batches
                parts += [_Part(path, i, i + 1) for i in range(batches)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as source:
            if partition.start is None:
                for batch in pa.ipc.open_stream(source):
                    yield batch.select(self.columns)
                return
            names = pa.ipc.open_file(source).schema.names
            chosen = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns])
            reader = pa.ipc.open_file(source, options=chosen)  # reads the buffers of these columns only
            for i in range(partition.start, partition.stop):
                yield reader.get_batch(i).select(self.columns)


class _TextReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[_Part]:
        parts = []
        for path in self.paths:
            with _opened(path) as source:
                size = source.size()
            parts += [_Part(path, start, min(size, start + self.split)) for start in range(0, size, self.split)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as source:
            found = members.lines(source, source.size(), partition.start, partition.stop)
            for at, values in _batched(found):
                n = len(values)
                arrays = [pa.array([partition.path] * n), pa.array([partition.start] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "start", "at", "raw"])


def _batched(found: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of its first line, lines) for some lines at a time."""
    held: list[bytes] = []
    at, size = 0, 0
    for line in found:
        held.append(line)
        size += len(line)
        if len(held) == BATCH or size > members.CHUNK:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def arrow_batches(source) -> Iterator[pa.RecordBatch]:
    """Record batches of the stream form, else of the file form."""
    head = source.read(6)
    source.seek(0)
    if head == b"ARROW1":
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)
    else:
        yield from pa.ipc.open_stream(source)


class ArrowFiles(DataSource):
    """spark.read.format("arrow_files").schema(...).option("paths", "a\\nb").load()"""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def reader(self, schema) -> _ArrowReader:
        return _ArrowReader(self.options["paths"].split("\n"), schema.fieldNames())


class TextFiles(DataSource):
    """spark.read.format("text_ranges").option("paths", "a\\nb").option("split", bytes).load()"""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return "path string, start long, at long, raw binary"

    def reader(self, schema) -> _TextReader:
        return _TextReader(self.options["paths"].split("\n"), int(self.options.get("split", SPLIT)))


def scan_arrow_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Arrow files that every executor can open by path: one task per record batch, only the columns of the schema."""
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").schema(schema).option("paths", "\n".join(paths)).load()


def _as_text(rows: DataFrame) -> DataFrame:
    """(path, line, value, error_code) from raw lines; bytes that are no UTF-8 are a failed row without a value."""
    text = F.col("raw").cast("string")
    good = F.is_valid_utf8(text)
    return rows.select("path", "line", F.when(good, text).alias("value"), F.when(~good, "invalid_utf8").alias("error_code"))


def scan_text_files(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(path, line, value, error_code) of plain or compressed text files that every executor can open by path.

    A file is read by byte ranges, see `members`. Lines are numbered by the counts of the ranges before.
    """
    spark.dataSource.register(TextFiles)
    rows = spark.read.format("text_ranges").option("paths", "\n".join(paths)).option("split", split).load()
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, ["path", "start"])  # a row per range: broadcast only if Spark finds it small
    return _as_text(joined.withColumn("line", F.col("offset") + F.col("at") + 1))


def scan_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow files through Spark's own file access, for any store; a file is held whole by its task."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from arrow_batches(pa.BufferReader(content.as_buffer()))

    return rows.mapInArrow(run, schema)


def scan_compressed_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value, error_code) of text files in any of the compressed forms, through Spark's own file access.

    The compressed file is held by its task, what it holds is decoded in chunks.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for at, values in _batched(members.lines(io.BytesIO(data), len(data))):
                    numbers = pa.array(range(at + 1, at + 1 + len(values)), pa.int64())
                    arrays = [pa.array([name] * len(values)), numbers, pa.array(values, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "line", "raw"])

    return _as_text(rows.mapInArrow(run, "path string, line long, raw binary"))
