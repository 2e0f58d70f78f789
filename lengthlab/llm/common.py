"""What several corpus operators share: scratch tables, text defaults and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and the ASCII controls 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Rows and bytes of an Arrow batch that goes to a Python worker; long texts need smaller batches than the default.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")
BATCH_SIZE = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time; a session that has set its own bounds keeps them."""
    for key, default, value in (BATCH_ROWS, BATCH_SIZE):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a folder of this machine serves a local master; on a cluster the executors would not see it.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or _local_folder(context.applicationId)


#: Folders of the tables that this process has materialised and not yet deleted.
_made: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared scratch folder and reads them back.

    A lost executor then costs a re-read, not a recomputation, and generated keys stay the same.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for discard()
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more, so that scratch does not pile up over many rounds."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)


def made() -> list[str]:
    """The scratch folders that there are now."""
    return list(_made)


def sweep(docs: DataFrame, folders: list[str]) -> None:
    """Deletes these scratch folders, but not that of `docs`, and frees the shuffles of plans that nobody holds any more."""
    for folder in folders:
        if folder in _made and folder != getattr(docs, "_scratch", None):
            _delete(docs.sparkSession, folder)
    free_shuffles(docs.sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them, which a driver with memory to spare seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is heavy where it holds one in so many rows or more, so there are at most as many heavy keys.
HEAVY = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins materialised `rows` with a narrow materialised `table` of one row per key, whatever the skew of the rows.

    The entries of heavy keys, at most HEAVY, are broadcast; what is left of the rows is joined by a shuffle in which
    no key holds more than one in HEAVY rows. `how` is inner or left; null keys match nothing.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull())
    heavy = materialise(counts.where(F.col("_n") * HEAVY >= rows.count()).select(key), "heavy")
    if heavy.isEmpty():
        return rows.join(table, key, how)
    few = F.broadcast(heavy)
    by_broadcast = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return by_broadcast.unionByName(rows.join(few, key, "left_anti").join(table, key, how))


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the named text column holds about most_bytes in each part, one row at least."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
