"""Tables on plain files that change by published versions: Parquet folders and one small manifest per version.

A manifest names the folders that make up its version and is a file that can be made only once. A writer prepares its
folders, then publishes the next number; where another writer was faster it looks at the new version and tries again.
Readers take the folders of one manifest, so they see one version, whatever is written meanwhile. Folders are never
changed after they are written, and a crash before publishing leaves folders that no manifest names (`sweep`).
Manifests are kept for good: a number that is free again could be taken by a writer that was left behind.

The store must be a local or shared folder, or one whose rename refuses an existing target, as HDFS does.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.scratch import stored

TRIES = 100
FAN = 8  # runs of one level that are merged into one of the next


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in seconds) of what lies in a folder; nothing where there is none."""
    system, place = _path(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in system.listStatus(place)] if system.exists(place) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name[:-5]) for name, _ in _names(spark, f"{root}/versions") if name.endswith(".json") and name[0] != ".")


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:09d}.json", wholetext=True).first()[0])


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last version and its manifest; (0, {}) before the first."""
    numbers = _numbers(spark, root)
    return (numbers[-1], manifest(spark, root, numbers[-1])) if numbers else (0, {})


def publish(spark: SparkSession, root: str, version: int, content: dict) -> bool:
    """Makes the manifest of a version, whole or not at all; False where that version is there already."""
    system, folder = _path(spark, f"{root}/versions")
    system.mkdirs(folder)
    own, target = f".{uuid.uuid4().hex}", f"{version:09d}.json"
    text = json.dumps(content, sort_keys=True).encode()
    if system.getUri().getScheme() == "file":  # a local rename would replace the other writer's file, a link does not
        place = folder.toUri().getPath()
        with open(f"{place}/{own}", "wb") as file:
            file.write(text)
        try:
            os.link(f"{place}/{own}", f"{place}/{target}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{place}/{own}")
        return True
    _, own = _path(spark, f"{root}/versions/{own}")
    _, target = _path(spark, f"{root}/versions/{target}")
    out = system.create(own, False)
    out.write(bytearray(text))
    out.close()
    if not system.exists(target) and system.rename(own, target):
        return True
    system.delete(own, False)
    return False


def update(spark: SparkSession, root: str, change: Callable[[dict], dict | None]) -> int:
    """Publishes change(manifest) as the next version; asks again on the newest one while others are faster. None: no change."""
    for _ in range(TRIES):
        version, old = latest(spark, root)
        new = change(old)
        if new is None:
            return version
        if publish(spark, root, version + 1, new):
            return version + 1
    raise RuntimeError(f"{root}: {TRIES} tries to publish a version were overtaken by other writers")


def _new_folder() -> str:
    return f"data/{uuid.uuid4().hex}"


def _read(spark: SparkSession, root: str, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def named(content: dict) -> set[str]:
    """The folders below data/ that a manifest needs."""
    folders = [*content.get("parts", {}).values(), *[f for run in content.get("runs", []) for f in (run["folder"], run.get("filter")) if f]]
    return {f.split("/")[1] for f in folders}


def sweep(spark: SparkSession, root: str, keep: int = 2, older_s: float = 86_400) -> int:
    """Deletes data that none of the last `keep` versions names; younger folders may belong to a writer at work and stay."""
    used = set().union(*[named(manifest(spark, root, v)) for v in _numbers(spark, root)[-keep:]])
    gone = [name for name, at in _names(spark, f"{root}/data") if name not in used and at <= time.time() - older_s]
    for name in gone:
        system, place = _path(spark, f"{root}/data/{name}")
        system.delete(place, True)
    return len(gone)


def upsert(root: str, new: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> int:
    """Replaces the rows of the keys in `new` by merge(current rows, new rows), and returns the version that holds them.

    Rows lie in buckets by the hash of their keys; only buckets that `new` touches are read and written again. A writer
    that was overtaken merges again only if the other one changed a bucket of its own. Null keys are keys like others.
    The number of buckets and the columns are those of the first version.
    """
    spark, schema = new.sparkSession, new.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    incoming = stored(new, "incoming")
    touched = [str(r[0]) for r in incoming.select(bucket).distinct().collect()]  # `buckets` rows at most
    made: dict = {}

    def change(old: dict) -> dict | None:
        if not touched:
            return None
        if old and (old["buckets"], old["keys"]) != (buckets, keys):
            raise ValueError(f"{root} has {old['buckets']} buckets by {old['keys']}")
        parts = old.get("parts", {})
        base = {b: parts[b] for b in touched if b in parts}
        if made.get("base") != base:
            folder = _new_folder()
            rows = merge(_read(spark, root, sorted(base.values()), schema), incoming).select(*schema.names)
            rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
            there = {name.split("=")[1] for name, _ in _names(spark, f"{root}/{folder}") if "=" in name}
            made.update(base=base, parts={b: f"{folder}/_bucket={b}" for b in there})
        kept = {b: f for b, f in parts.items() if b not in touched}
        return {"buckets": buckets, "keys": keys, "schema": schema.json(), "parts": kept | made["parts"]}

    return update(spark, root, change)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of one version of an upserted table, the last one if none is named."""
    content = manifest(spark, root, version) if version else latest(spark, root)[1]
    return _read(spark, root, sorted(content["parts"].values()), T.StructType.fromJson(json.loads(content["schema"])))


def add_run(
    spark: SparkSession,
    root: str,
    source: str,
    batch: int,
    make: Callable[[list[dict]], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    describe: Callable[[str], dict] = lambda folder: {},
    fan: int = FAN,
) -> int:
    """Adds a batch as a run of level 0; `fan` runs of a level become one of the next in the same version.

    make(runs) gives the batch's rows, merge the rows of several runs as one, describe what a manifest should say of a
    new run, which lies in the folder it is given. After n batches there are fewer than fan * (1 + log n / log fan) runs,
    and a row has been rewritten once per level. A batch of a source that is in the table already changes nothing.
    """

    def run(level: int, rows: DataFrame) -> dict:
        folder = _new_folder()
        rows.write.parquet(f"{root}/{folder}")
        return {"level": level, "folder": folder} | describe(folder)

    def change(old: dict) -> dict | None:
        last, runs = old.get("last", {}), old.get("runs", [])
        if last.get(source, -1) >= batch:
            return None
        rows = make(runs)
        runs, level = [*runs, run(0, rows)], 0
        while len(full := [r for r in runs if r["level"] == level]) >= fan:
            merged = merge(_read(spark, root, [r["folder"] for r in full], rows.schema))
            runs, level = [*[r for r in runs if r["level"] != level], run(level + 1, merged)], level + 1
        return {"last": last | {source: batch}, "runs": runs, "schema": rows.schema.json()}

    return update(spark, root, change)


def read_runs(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all runs of the last version; `schema` is needed only before the first."""
    content = latest(spark, root)[1]
    schema = T.StructType.fromJson(json.loads(content["schema"])) if content else schema
    return _read(spark, root, [r["folder"] for r in content.get("runs", [])], schema)
