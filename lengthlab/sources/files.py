"""Files of a dataset: listing, formats by content, splits, row indexes, manifests, quotas."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 20_000_000
PREVIEW_ROWS, PREVIEW_FILES = 100, 4


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size) from the listing alone; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"))
    )


#: Stores whose files Arrow can open by path on the executors, so that a few bytes are read instead of the file.
RANGED = ("file", "hdfs", "s3", "gs")
HEAD, TAIL = 64, 4
PIECE = 8 << 20


def _ends(spark: SparkSession, path: str) -> DataFrame:
    """(path, head, tail): the first and last bytes of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = rows.select("path").first()
    scheme = first.path.split(":", 1)[0] if first else "file"
    if scheme not in RANGED:  # through Spark, which can only read files whole
        return rows.select("path", F.substring("content", 1, HEAD).alias("head"), F.expr(f"right(hex(content), {2 * TAIL})").alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            heads, tails = [], []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    heads.append(file.read_at(min(size, HEAD), 0))
                    tails.append(file.read_at(min(size, TAIL), max(0, size - TAIL)).hex().upper())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary()), pa.array(tails)], names=["path", "head", "tail"])

    return rows.select("path", "length").mapInArrow(run, "path string, head binary, tail string")


def sniff_format(spark: SparkSession, path: str) -> DataFrame:
    """(path, format): the content decides, not the name: parquet, arrow, json_array, json_lines or text."""
    rows = _ends(spark, path)
    first = F.substring(F.ltrim(F.decode("head", "ISO-8859-1"), F.lit(" \t\r\n")), 1, 1)
    magic = F.hex("head")
    kind = (
        F.when(magic.startswith("50415231") & (F.col("tail") == "50415231"), "parquet")
        .when(magic.startswith("4152524F5731") | magic.startswith("FFFFFFFF"), "arrow")
        .when(first == "[", "json_array")
        .when(first == "{", "json_lines")
        .otherwise("text")
    )
    return rows.select("path", kind.alias("format"))


def layout(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(split, file_ord, path, size): the first matching pattern names a file's split; files are ordered by path."""
    split = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(name)) for name, p in patterns.items()])
    named = files.withColumn("split", split).where("split is not null")
    order = Window.partitionBy("split").orderBy("path")
    return named.select("split", (F.row_number().over(order) - 1).alias("file_ord"), "path", "size")


def load_split(spark: SparkSession, files: DataFrame, split: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of one split; files of other splits are never opened. The first file fixes the schema."""
    paths = [r.path for r in files.where(F.col("split") == split).orderBy("file_ord").collect()]  # a listing
    return scan_parquet(spark, paths, schema)


def scan_parquet(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet with the split's locked schema and only the chosen columns."""
    locked = schema or spark.read.parquet(paths[0]).schema
    df = spark.read.schema(locked).parquet(*paths)
    return df.select(*columns) if columns else df


def with_row_index(spark: SparkSession, df: DataFrame, files: DataFrame, split: str) -> DataFrame:
    """Adds row_index (0-based over the split, in file order) and row_id to a Parquet scan.

    The scan knows each row's place in its file; files' row counts come from their footers, and a prefix sum
    over the files, not over rows, gives the offsets.
    """
    own = files.where(F.col("split") == split)
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    counts = df.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count("*").alias("n"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    ordered = own.select(plain("path").alias("_key"), "file_ord").join(counts.withColumn("_key", plain("_path")), "_key")
    offsets = file_offsets(ordered.select("_path", "file_ord", "n"))
    joined = placed.join(offsets, "_path")  # a row per file: broadcast only if Spark finds it small
    indexed = joined.withColumn("row_index", F.col("offset") + F.col("_at"))
    return indexed.withColumn("row_id", F.concat(F.lit(f"{split}:"), F.col("row_index").cast("string"))).drop("_path", "_at", "offset")


def file_offsets(counts: DataFrame) -> DataFrame:
    """(_path, offset) from (_path, file_ord, n): the prefix sum of the files' row counts."""
    before = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def build_manifest(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, size, sha256) per file of any size: a task reads a file piece by piece.

    Through stores that only Spark reads a file is one value, of 2 GB at most. Spark's listing leaves out files without
    a byte and those whose names begin with a dot or an underscore, so they are in no manifest.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    first = rows.select("path").first()
    if first and first.path.split(":", 1)[0] not in RANGED:
        return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with system.open_input_stream(place, compression=None) as file:
                    while part := file.read(piece):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests)], names=["path", "size", "sha256"])

    return rows.select("path", "length").mapInArrow(run, "path string, size long, sha256 string")


def content_identity(manifest: DataFrame) -> DataFrame:
    """(identity, files): one sha256 over all entries, which does not depend on the order of files.

    A tree, so that no row holds all entries: an entry is path, size and sha256 with tabs between; a leaf is the sha256
    of the sorted entries, a line each, whose own sha256 begin with the same four hexadecimal digits; a branch that of
    the leaves with the same first two digits, in order, as lines `digits<tab>leaf`; the identity that of the branches.
    """
    entry = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    lines = manifest.select(F.substring(F.sha2(entry, 256), 1, 4).alias("at"), entry.alias("line"), F.lit(1).cast("long").alias("n"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
    for digits in (4, 2):
        level = lines.groupBy(F.substring("at", 1, digits).alias("at")).agg(digest.alias("digest"), F.sum("n").alias("n"))
        lines = level.select("at", F.concat_ws("\t", "at", "digest").alias("line"), "n")
    return lines.agg(digest.alias("identity"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def verify_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, problem) for every file that is not as the manifest says."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    problem = (
        F.when(F.col("a.path").isNull(), "not_in_manifest")
        .when(F.col("b.path").isNull(), "missing")
        .when(F.col("a.size") != F.col("b.size"), "size_mismatch")
        .when(F.col("a.sha256") != F.col("b.sha256"), "sha256_mismatch")
    )
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).where("problem is not null")


def declared_row_check(counts: DataFrame, declared: DataFrame) -> DataFrame:
    """(split, expected, found, complete): declared rows, else what the footers say, against the rows found."""
    out = counts.join(declared, "split", "left").withColumn("expected", F.coalesce("declared", "footer"))
    return out.select("split", "expected", "found", (F.col("expected") == F.col("found")).alias("complete"))


def preview(spark: SparkSession, files: DataFrame, split: str, rows: int = PREVIEW_ROWS, most_files: int = PREVIEW_FILES) -> tuple[DataFrame, Column]:
    """The first rows of the first files, and whether that was all."""
    chosen = [r.path for r in files.where(F.col("split") == split).orderBy("file_ord").limit(most_files + 1).collect()]
    df = scan_parquet(spark, chosen[:most_files]).limit(rows)
    return df, F.lit(len(chosen) <= most_files) & (F.count("*") < rows)


def sample_scan(indexed: DataFrame, rows: int) -> DataFrame:
    """The first rows of an indexed split."""
    return indexed.where(F.col("row_index") < rows)


def read_quota(indexed: DataFrame, most: int = MAX_ROWS) -> tuple[DataFrame, Column]:
    """Rows within the quota, and the flag that there were more; exactly `most` rows are complete."""
    return indexed.where(F.col("row_index") < most), F.max("row_index") + 1 > most
