"""The corpus pipeline: quality rules, near-dedup, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. The driver of a
run writes each stage's result as Parquet and reads it back; `run` does the same in the shared scratch folder. So a
stage begins by deleting the scratch tables of those before it, and its own result must be written before another
stage starts.

In every stage null text counts as empty, rows without an id are rows like others, repeated rows are copies, an empty
table gives no rows, very long texts are taken whole and columns beyond the five below are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lengthlab.llm import packing, pii, quality, simhash, suffix_dedup
from lengthlab.llm.common import made, materialise, small_batches, sweep

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Scratch folders that stages other than the last have left; what they returned has been written when a later stage starts.
_left: list[str] = []


def _tidy(stage: Callable[..., DataFrame], first: bool = False, last: bool = False) -> Callable[..., DataFrame]:
    """The stage, which begins by deleting what earlier ones have left."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            sweep(docs, _left)
            _left.clear()
        before = set(made())
        out = stage(spark, docs, sf_dir)
        if not last:
            _left.extend(x for x in made() if x not in before)
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.selectExpr(*[f"cast(length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules or diverge from their language go, so null and empty texts do too."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id, null last, then the first row."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also stand earlier (null doc_id first) are cut out; null text stays null."""
    small_batches(spark)
    return _measured(suffix_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms are replaced by their kind; null text stays null."""
    return _measured(pii.sanitised(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; an empty text is one piece with the closing id alone."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", _tidy(quality_rules, first=True)),
    ("near-dedup", _tidy(near_dedup)),
    ("repeated passages", _tidy(repeated_passages)),
    ("personal data", _tidy(personal_data)),
    ("packing", _tidy(pack, last=True)),
]

#: The stages hash, sort suffixes and encode; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "_"))
    return docs
