"""First rows by digest of an unbounded stream: what was seen is a table on files, not state in the executors' memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lengthlab.sources import versions

#: Bits of a block are fixed by bitmap_construct_agg. With 2,048 digests of four bits each about one in 400 strangers passes.
BLOCK_BITS, PER_BLOCK, MARKS = 32_768, 2_048, 4


def _block(digest: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(digest), blocks)


def _marks(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(MARKS)]


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def bloom(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, bits): a Bloom filter in blocks of 4 KB, each of the digests that fall into it."""
    marked = rows.select(_block(F.col(column), F.lit(blocks)).alias("block"), F.explode(F.array(*_marks(F.col(column)))).alias("mark"))
    return marked.groupBy("block").agg(F.bitmap_construct_agg("mark").alias("bits"))


def _known(spark: SparkSession, root: str, runs: list[dict], digests: DataFrame, column: str) -> DataFrame:
    """The digests that a run holds. A run is asked only for those that its filter lets through."""
    places = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r["blocks"]).cast("long").alias("blocks")) for i, r in enumerate(runs)])
    asked = digests.select(column, F.explode(places).alias("p")).select(column, "p.run", _block(F.col(column), F.col("p.blocks")).alias("block"))

    def each(key: str, schema) -> DataFrame:
        parts = [spark.read.schema(schema).parquet(f"{root}/{r[key]}").withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    passed = asked.join(each("filter", "block long, bits binary"), ["run", "block"])
    for mark in _marks(F.col(column)):
        passed = passed.where(_is_set(F.col("bits"), mark))
    held = each("folder", digests.schema)
    return held.join(passed.select("run", column), ["run", column], "left_semi").select(column)


def add_batch(root: str, source: str, number: int, batch: DataFrame, column: str, order: str, fan: int = versions.FAN) -> int:
    """Adds the batch's rows with digests not seen before, one per digest, the first by `order`; null digests are left out."""
    spark, schema = batch.sparkSession, batch.schema

    def make(runs: list[dict]) -> DataFrame:
        rows = batch.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_digest"))
        first = rows.agg(F.min_by(F.struct(*schema.names), order).alias("r")).select("r.*")
        live = [r for r in runs if r["blocks"]]
        return first.join(_known(spark, root, live, first.select(column), column), column, "left_anti").select(*schema.names) if live else first

    def describe(folder: str) -> dict:
        rows = spark.read.schema(schema).parquet(f"{root}/{folder}")
        blocks = -(-rows.count() // PER_BLOCK)
        if not blocks:
            return {"blocks": 0}
        bloom(rows, column, blocks).write.parquet(f"{root}/{folder}-filter")
        return {"blocks": blocks, "filter": f"{folder}-filter"}

    return versions.add_run(spark, root, source, number, make, lambda rows: rows.repartitionByRange(column), describe, fan)


def stream_dedup(records: DataFrame, out: str, log: str, column: str = "content_digest", order: str = "row_id") -> DataFrame:
    """Streaming: the first row of each digest, of all batches so far.

    Digests of former batches lie in runs (see `versions.add_run`) with a Bloom filter beside each. A batch is reduced
    to one row per digest, probes the filters by a join on (run, block), and only what passes is joined with the runs,
    so nothing is held in memory between batches. A batch that is played again after a crash changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        add_batch(out, log, number, batch, column, order)

    query = records.writeStream.foreachBatch(add).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.read_runs(records.sparkSession, out, records.schema)
