import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lengthlab.llm import multi_index


def brute(rows, k=20, every=20):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            clean[i] = min(clean.get(i, v), v)
    ids = np.array(sorted(clean))
    matrix = np.array([clean[i] for i in ids.tolist()], np.float64)
    out = {}
    for at, i in enumerate(ids.tolist()):
        if i % every == 0:
            score = (matrix * matrix[at]).sum(axis=1)
            order = sorted((-s, o) for s, o in zip(score.tolist(), ids.tolist()) if o != i)[:k]
            out[i] = [(o, -s) for s, o in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    wanted = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    out = found(multi_index.search(df, F.col("id") % 20 == 0))
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert set(out) == set(wanted) and all(len(out[q]) == len(near) for q, near in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_cells_come_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(9), rng.standard_normal(9)
    sums = [a[i] + b[j] for i, j in multi_index.cells_in_order(a, b)]
    assert len(sums) == 81 and all(x >= y for x, y in zip(sums, sums[1:]))


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, [0.0, 0.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (20, [-1.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string")
    out = found(multi_index.search(df, F.col("id") % 20 == 0))
    assert out == {0: [(1, 1.0), (2, 1.0), (3, 0.5), (20, -1.0)], 20: [(3, 2.5), (0, -1.0), (1, -1.0), (2, -1.0)]}
    assert multi_index.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0, 0.5, 0.0]) for i in range(3000)] + [(i, [float(i % 7), 1.0, i / 9000, -1.0]) for i in range(3000, 4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, wanted = found(multi_index.search(df, F.col("id") % 500 == 0)), brute(rows, every=500)
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_clustered_vectors_need_a_small_share(spark):
    """Where vectors have structure, the index visits little of the table and finds the nearest all the same."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((80, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    points = np.repeat(centres, 100, axis=0) + 0.05 * rng.standard_normal((8000, 32))
    assert multi_index.train(points[::2], len(points), 20).share < 0.15
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, wanted = found(multi_index.search(df, F.col("id") % 20 == 0)), brute(rows)
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_blocks_hold_every_cell_once():
    rng = np.random.default_rng(6)
    books = multi_index.Codebooks(np.zeros((40, 2)), np.zeros((40, 2)), 1.0)
    sizes = rng.integers(0, 60, 1600) * (rng.random(1600) < 0.5)
    sizes[[0, 7, 8, 1599]] = [0, 5000, 1, 3000]
    books.lay_out(sizes)
    held = np.zeros(len(books.low), np.int64)
    for cell in np.flatnonzero(sizes):
        first, splits = books.block[cell], books.splits[cell]
        assert (books.low[first : first + splits] <= cell).all() and (splits == 1 or (books.low[first : first + splits] == cell).all())
        held[first : first + splits] += -(-sizes[cell] // splits)
    assert held.max() <= max(multi_index.BLOCK, sizes.sum() // multi_index.BLOCKS) and held.sum() >= sizes.sum()


def _rows_probed(spark):
    """Rows that came from the blocks in each execution so far, by the metrics of the plans."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    executions = store.executionsList()
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "probe(block" in node.desc():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        out[at, node.id()] = int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "many rounds"])
def test_what_blocks_pass_on_does_not_grow_with_their_number(spark, monkeypatch, kind):
    """About WIDER * k entries a query and round, where an eighth of all visited vectors came from 125 blocks unasked."""
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    if kind == "many rounds":
        monkeypatch.setattr(multi_index, "GUIDE_BYTES", 8 * 16 * 50)
    rng = np.random.default_rng(9)
    points = rng.standard_normal((8000, 16))
    if kind == "copies":
        points[rng.random(8000) < 0.5] = points[0]
    rows = list(enumerate(points.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    before = _rows_probed(spark)
    out, wanted = found(multi_index.search(df, F.col("id") % 80 == 0)), brute(rows, every=80)
    passed = sum(n for at, n in _rows_probed(spark).items() if at not in before)
    hits = sum(len({i for i, _ in out[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert set(out) == set(wanted) and all(len(near) == 20 for near in out.values())
    assert hits / sum(map(len, wanted.values())) >= 0.9
    rounds = 1 if kind != "many rounds" else 4
    assert 20 * len(wanted) <= passed <= 1.5 * 8 * 20 * rounds * len(wanted)


def test_floors_are_no_better_than_what_is_visited():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (300, 4)).astype(float)  # many ties
    guides = multi_index.Guides(rng.permutation(300), vectors, rng.integers(0, 30, 300))
    for q in range(0, 300, 7):
        visited = rng.random(30) < 0.6
        own = [i for i in range(300) if visited[guides.cells[i]] and guides.ids[i] != q]
        order = sorted((-float((vectors[i] * vectors[5]).sum()), int(guides.ids[i])) for i in own)
        assert guides.floor(q, vectors[5], visited, 20) == (-order[19][0], order[19][1])
    assert guides.floor(0, vectors[0], np.zeros(30, bool), 20) == (-math.inf, multi_index.LAST)
    assert multi_index.reaches(100, 800, 500) == [500] and multi_index.reaches(100, 64_000, 32_000) == [400, 3200, 25_600, 32_000]
