"""Published versions: writers at the same time, crashes before a commit, replayed batches, few runs after many batches."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lengthlab.operators import jobs as J
from lengthlab.sources import versions
from lengthlab.streaming import scan, seen

CACHE = "entry_id long, owner_id long, key long, used_at long, complete boolean, summary string"


def cache(spark, rows):
    return spark.createDataFrame([(i, o, k, i, c, f"s{i}") for i, o, k, c in rows], CACHE)


def put(spark, root, rows, **more):
    return versions.upsert(root, cache(spark, rows), ["owner_id", "key"], J.cache_upsert, **more)


def entries(df):
    return sorted(tuple(r) for r in df.select("entry_id", "owner_id", "key", "summary").collect())


def test_a_version_is_published_once(spark, tmp_path):
    root, won = str(tmp_path), []
    writers = [threading.Thread(target=lambda i=i: won.append(i) if versions.publish(spark, root, 1, {"by": i}) else None) for i in range(8)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert len(won) == 1
    assert versions.latest(spark, root) == (1, {"by": won[0]})
    assert [p.name for p in (tmp_path / "versions").iterdir()] == ["000000001.json"]


def test_upsert_replaces_and_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path)
    first = put(spark, root, [(1, 1, 1, True), (2, 1, 2, False), (3, None, None, True)], buckets=4)
    before = versions.read_table(spark, root)
    put(spark, root, [(4, 1, 1, False), (5, None, None, True), (6, 7, 7, True)], buckets=4)
    assert entries(before) == entries(versions.read_table(spark, root, first))
    assert sorted(entries(before.where("owner_id = 1"))) == [(1, 1, 1, "s1"), (2, 1, 2, None)]
    assert sorted(r.entry_id for r in versions.read_table(spark, root).collect()) == [2, 4, 5, 6]
    assert put(spark, root, [], buckets=4) == 2  # nothing new, no version
    with pytest.raises(ValueError, match="buckets"):
        put(spark, root, [(9, 1, 1, True)], buckets=5)


def test_writers_at_once_all_survive(spark, tmp_path):
    """Every writer is overtaken at least in its own bucket or another's; the result is that of any order."""
    root, failed = str(tmp_path), []

    def write(i):
        try:
            put(spark, root, [(10 * i, i, i, True), (10 * i + 1, 99, 1, True)], buckets=3)
        except Exception as e:  # told by the assertion below
            failed.append(e)

    writers = [threading.Thread(target=write, args=(i,)) for i in range(1, 5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed
    assert versions.latest(spark, root)[0] == 4
    assert entries(versions.read_table(spark, root)) == [(10 * i, i, i, f"s{10 * i}") for i in range(1, 5)] + [(41, 99, 1, "s41")]


def test_an_overtaken_writer_merges_again_only_for_its_own_buckets(spark, tmp_path, monkeypatch):
    root, merged, real, overtake = str(tmp_path), [], versions.publish, []

    def merge(current, new):
        merged.append(current.count())
        return J.cache_upsert(current, new)

    def slow(session, where, version, content):
        if overtake:
            overtake.pop()()
        return real(session, where, version, content)

    monkeypatch.setattr(versions, "publish", slow)
    bucket = {k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(1).cast("long"), F.lit(k).cast("long")), F.lit(8))).first()[0] for k in range(9)}
    same = next((a, b) for a in bucket for b in bucket if a < b and bucket[a] == bucket[b])
    other = next(k for k in bucket if bucket[k] != bucket[same[0]])
    for fast, merges in ((other, [0]), (same[1], [0, 1])):
        root, merged[:] = f"{tmp_path}/{fast}", []
        overtake.append(lambda fast=fast: put(spark, root, [(2, 1, fast, True)], buckets=8))
        versions.upsert(root, cache(spark, [(1, 1, same[0], True)]), ["owner_id", "key"], merge, buckets=8)
        assert merged == merges
        assert sorted(r.key for r in versions.read_table(spark, root).collect()) == sorted((same[0], fast))


def test_a_crash_before_publishing_loses_nothing_and_sweeping_clears_it(spark, tmp_path, monkeypatch):
    root, real = str(tmp_path), versions.publish
    counts = lambda n: spark.createDataFrame([("b", n, 1)], "branch string, length long, n long")
    add = lambda n: versions.add_run(spark, root, "s", n, lambda runs: counts(n), lambda df: df.groupBy("branch", "length").agg(F.sum("n").alias("n")), fan=2)
    add(0)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(versions, "publish", crash)
    with pytest.raises(OSError):
        add(1)  # the run and the merged one are written, the version is not
    monkeypatch.setattr(versions, "publish", real)
    assert [r.length for r in versions.read_runs(spark, root).collect()] == [0]
    add(1), add(1), add(0)  # played again
    assert sorted(r.length for r in versions.read_runs(spark, root).collect()) == [0, 1]
    assert versions.sweep(spark, root, keep=1, older_s=3600) == 0
    assert versions.sweep(spark, root, keep=1, older_s=-1) == 4
    assert sorted(r.length for r in versions.read_runs(spark, root).collect()) == [0, 1]


def test_many_batches_leave_few_runs(spark, tmp_path):
    root, fan = str(tmp_path), 3
    for n in range(20):
        rows = spark.createDataFrame([("b", n % 5, 1), ("c", 1, 2)], "branch string, length long, n long").coalesce(1)
        versions.add_run(spark, root, "s", n, lambda runs, rows=rows: rows, lambda df: scan.S.merge_counts(df).coalesce(1), fan=fan)
    levels = [r["level"] for r in versions.latest(spark, root)[1]["runs"]]
    assert sorted(levels) == [0, 0, 2, 2]  # 20 in base 3 is 202
    found = {(r.branch, r.length): r.n for r in scan.S.merge_counts(versions.read_runs(spark, root)).collect()}
    assert found == {("b", k): 4 for k in range(5)} | {("c", 1): 40}


def test_first_rows_by_digest_over_batches(spark, tmp_path):
    """Against a set in memory: null digests, ties and repeats within and across batches, an empty batch, a replay, merged runs."""
    root, deal = str(tmp_path), random.Random(5)
    known, expected = set(), []
    for n in range(7):
        rows = [(f"{n}:{i:04d}", None if deal.random() < 0.1 else f"d{deal.randrange(3000)}", deal.choice([None, "x"])) for i in range(0 if n == 3 else 600)]
        rows += [(f"{n}:hot", "hot", None)] * 50
        rows = [] if n == 3 else rows
        batch = spark.createDataFrame(rows, "row_id string, content_digest string, other string")
        for _ in range(2 if n in (2, 5) else 1):
            seen.add_batch(root, "log", n, batch, "content_digest", "row_id", fan=3)
        for row_id, digest, _ in sorted(rows, key=lambda r: r[0]):
            if digest is not None and digest not in known:
                known.add(digest)
                expected.append((row_id, digest))
    table = versions.read_runs(spark, root)
    assert table.columns == ["row_id", "content_digest", "other"]
    assert sorted((r.row_id, r.content_digest) for r in table.collect()) == sorted(expected)
    assert len(versions.latest(spark, root)[1]["runs"]) == 3  # 7 in base 3 is 21


def test_filters_pass_all_members_and_few_others(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    blocks = -(-10_000 // seen.PER_BLOCK)
    members = rows.limit(10_000).cache()
    bits = seen.bloom(members, "d", blocks)
    assert bits.count() == blocks
    asked = rows.select("d", seen._block(F.col("d"), F.lit(blocks)).alias("block")).join(bits, "block")
    for mark in seen._marks(F.col("d")):
        asked = asked.where(seen._is_set(F.col("bits"), mark))
    passed = asked.select("d")
    assert members.join(passed, "d", "left_anti").count() == 0
    others = passed.join(members, "d", "left_anti").count()
    assert others < 100  # of 10,000


def test_a_stream_without_rows_gives_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([], "row_id string, content_digest string").write.parquet(path)
    rows = scan.file_stream(spark, path, "row_id string, content_digest string")
    out = seen.stream_dedup(rows, str(tmp_path / "out"), str(tmp_path / "log"))
    assert out.count() == 0 and out.columns == ["row_id", "content_digest"]
