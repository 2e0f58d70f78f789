"""Folders for files that jobs share: the session's spark.checkpoint.dir, or a local one where it is unset."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, below the shared folder.

    Without spark.checkpoint.dir a folder of this machine serves a local master; executors elsewhere would not see it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or _local_folder(context.applicationId)
    return f"{root}/{context.applicationId}-{uuid.uuid4().hex[:12]}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back, for questions that scan them more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
