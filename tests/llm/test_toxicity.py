import math
import random
import zlib

import numpy as np

from lengthlab.llm import toxicity


def sets(n, toxic, rng):
    common = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrstlpmk"]
    out = []
    for _ in range(n):
        s = set(rng.sample(common, 40))
        if toxic:
            s |= set(rng.sample(["vile", "nasty", "rotten", "awful", "filthy", "mean", "cruel", "ugly"], 3))
        out.append(s)
    return out


def test_unlabelled_positives_do_not_hide_the_signal():
    rng = random.Random(1)
    positives, unlabelled = sets(200, True, rng), sets(800, False, rng) + sets(100, True, rng)
    words = ["vile", "nasty", "rotten", "awful", "filthy", "mean", "cruel", "ugly", "ban", "ber", "kot", "lum"]
    index = {w: i for i, w in enumerate(words)}
    places = lambda texts: [[index[w] for w in t if w in index] for t in texts]
    model = toxicity.train(words, places(positives), places(unlabelled), 0.11)
    fresh = [(s, 1) for s in sets(100, True, rng)] + [(s, 0) for s in sets(400, False, rng)]
    right = sum((model.logit(" ".join(s)) >= 0) == (y == 1) for s, y in fresh)
    assert right >= 0.97 * len(fresh)


def test_near_copies_count_once():
    texts = [{f"lengthy{a}{b}" for b in "bcdfghjklm"} for a in "xyz"]
    texts.append((texts[0] - {"lengthyxb"}) | {"another"})
    assert toxicity.once(list(enumerate(map(toxicity.signature, texts)))) == [0, 1, 2]


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in toxicity.op3_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert sum(out[i].predicted == labels[i] for i in held) / len(held) >= 0.95
    toxic = [i for i in held if labels[i]]
    assert sum(out[i].predicted for i in toxic) >= 0.6 * len(toxic)


def test_drawn_ids_are_distinct_and_as_many_as_asked_for(spark):
    ids = spark.range(50_000).union(spark.range(1).crossJoin(spark.range(5_000)).toDF("id", "n").select("id"))
    least = sorted(r.id for r in toxicity._drawn(ids, 50_000, 300, "seed").collect())
    assert len(set(least)) == 300 and least == sorted(r.id for r in toxicity._drawn(ids, 50_000, 300, "seed").collect())
    assert toxicity._drawn(ids, 50_000, 30_000, "seed").count() == 30_000
    assert toxicity._drawn(ids.limit(0), 0, 10, "seed").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "vile thing", 7), (None, None, 1), (1, "vile thing", 7), (2, "", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 4 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in out)
    assert toxicity.scores(docs.limit(0), toxicity.Model()).count() == 0


def plain_parts(theta, positives, unlabelled, prior):
    """Both parts of the risk, text by text."""
    logit = lambda t: theta[-1] + sum(theta[i] for i in t)
    loss = lambda z, y: math.log1p(math.exp(-y * z))
    mean = lambda texts, y: sum(loss(logit(t), y) for t in texts) / len(texts)
    return prior * mean(positives, 1), mean(unlabelled, -1) - prior * mean(positives, -1)


def test_risk_and_gradient_match_plain_versions():
    rng = np.random.default_rng(2)
    draw = lambda n, p: [np.flatnonzero(rng.random(6) < p).tolist() for _ in range(n)]
    positives, unlabelled = draw(30, 0.6), draw(80, 0.3)
    reversed_seen = kept_seen = 0
    for prior in (0.1, 0.4, 0.85):
        risk = toxicity.Risk(positives, unlabelled, 6, prior)
        for _ in range(20):
            theta = rng.normal(0, 1.5, 7)
            first, second = plain_parts(theta, positives, unlabelled, prior)
            assert np.allclose(risk.parts(theta), (first, second)) and np.isclose(risk.value(theta), first + max(0, second))
            step = 1e-6
            slopes = []
            for i in range(7):
                up, down = theta.copy(), theta.copy()
                up[i] += step
                down[i] -= step
                a, b = (plain_parts(t, positives, unlabelled, prior) for t in (up, down))
                slopes.append([(x - y) / (2 * step) for x, y in zip(a, b)])
            slopes = np.array(slopes)
            assert np.allclose(risk.gradients(theta), slopes.T, atol=1e-6)
            if second >= 0:
                kept_seen += 1
                assert np.allclose(risk.direction(theta), slopes.sum(axis=1), atol=1e-6)
            else:
                reversed_seen += 1
                assert np.allclose(risk.direction(theta), slopes[:, 0] - slopes[:, 1], atol=1e-6)
    assert kept_seen > 5 and reversed_seen > 5


def test_training_lowers_the_risk():
    rng = random.Random(3)
    positives = [[0, 1] if rng.random() < 0.8 else [0] for _ in range(60)]
    unlabelled = [[2] for _ in range(180)] + [[0, 1] for _ in range(20)]
    model = toxicity.train(["a", "b", "c"], positives, unlabelled, 0.1)
    risk = toxicity.Risk(positives, unlabelled, 3, 0.1)
    theta = np.array([model.weights[w] for w in "abc"] + [model.bias])
    assert risk.value(theta) < 0.5 * risk.value(np.array([0, 0, 0, math.log(0.1 / 0.9)])) and model.weights["a"] > 0 > model.weights["c"]


def test_very_long_texts_are_read_whole(spark):
    model = toxicity.Model(-3.0, {"vile": 10.0})
    df = spark.createDataFrame([(1, "calm words " * 200_000 + "vile"), (2, "calm words " * 200_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.scores(df, model).collect()} == {1: 1, 2: 0}
