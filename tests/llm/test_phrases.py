import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lengthlab.llm import phrases


def expected(rows, support, top):
    """All phrases counted in plain dictionaries. rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and a >= count[p[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((lang, " ".join(p), a, count[p[:k]], count[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def test_phrases_match_plain_counts_for_any_shards_and_filters(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    odd = [(1, None, "One two. ONE TWO, one two; one two"), (1, "en", None), (None, "fr", ""), (2, None, "one two!\x0cone\x0btwo one\ttwo . "), (3, None, "é É \x1cz é É \x1cz " * 9)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("key", docs.lang).repartition(5, "doc_id")
    rows = [(r.lang, r.text) for r in docs.collect()]
    for support, top, options in ((4, 50, {}), (3, 10_000, {"shards": 2, "filter_bits": 1 << 12})):
        found = phrases.collocations(docs, support=support, top=top, **options)
        wanted = expected(rows, support, top)
        assert len(wanted) > 100 and {r[0] for r in wanted} >= {"und", "en"}
        assert sorted(map(tuple, found.collect())) == wanted
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    text = "cast((cast(1000 * a as decimal(20, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0))) as long)"
    assert text in open(phrases.__file__).read()
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in (rng.integers(1, 10**12), rng.integers(10**12, 10**15), rng.integers(10**12, 10**14), rng.integers(1, 10**14))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{text} as score")
    assert all(r.score == 1000 * r.a * r.n // (r.l * r.r) for r in df.collect())


def _rows_of_passes(spark):
    """Rows that the passes over the hashed words made in each execution so far, by the metrics of the plans."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    executions = store.executionsList()
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if re.search(r"run\((shard|lang)#.*rid#\w+, ids#\w+\)", node.desc()):
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        out[at, node.id()] = int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


def test_pairs_that_stand_a_few_times_are_not_shuffled_one_by_one(spark):
    """Frequent words side by side by chance: before, each pair was a row of each task that held it."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(400):
        words = [f"w{j}" for j in rng.integers(0, 300, 400)]
        words[50:53] = ["one", "rare", f"phrase{i % 2}"]
        texts.append((i, " ".join(words), "en" if i % 4 else "de"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(8, "doc_id")
    before = _rows_of_passes(spark)
    found = sorted(map(tuple, phrases.collocations(docs, support=90).collect()))
    made = sum(n for at, n in _rows_of_passes(spark).items() if at not in before)
    assert found == expected([(lang, text) for _, text, lang in texts], 90, 2000)
    assert {"one rare", "one rare phrase1"} <= {r[2] for r in found}
    assert made <= 160_000 / 10


def test_what_cannot_reach_the_support_goes_with_its_level(spark, monkeypatch):
    """Before, a pair frequent in one shard was kept and counted elsewhere, whatever its words could reach in the corpus."""
    shards = [[f"x{i} y{i}" for i in range(20)] * 26 + ["far seen"] * 40 + [f"once{i}" for i in range(120)]]
    # The words of "far seen" are frequent in the first shard only, but with the other shards it just reaches the support.
    shards += [[f"x{i} . y{i}" for i in range(20)] * 30 + ["far seen"] * 20 for _ in range(3)]
    rows = [("en", " . ".join(pieces)) for pieces in shards]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "lang string, text string")
    stored, materialise = {}, phrases.materialise

    def noted(df, name):
        out = materialise(df, name)
        stored[name] = out.columns, out.count()
        return out

    monkeypatch.setattr(phrases, "materialise", noted)
    found = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert found == expected(rows, 100, 2000) and [r[2:4] for r in found] == [("far seen", 100)]
    assert stored["frequent_2"][1] == 1
    assert not {"id", "key"} & set(stored["encoded"][0])  # a word's hash follows from the word


def test_packed_counts_are_those_put_in(monkeypatch):
    rng = np.random.default_rng(3)
    for held in (1, 500, 1 << 20):
        monkeypatch.setattr(phrases, "HELD", held)
        wanted, put = Counter(), []
        for _ in range(12):
            name = (int(rng.integers(2)), "en", 3, 6)
            keys, n = np.unique(rng.integers(0, 300, 400).astype(np.uint64) << np.uint64(55), return_counts=True)
            put.append((name, keys, n, np.arange(len(keys)) + (7 << 32)))
            for key, m in zip(keys.tolist(), n.tolist()):
                wanted[name[0], key] += m
        found = Counter()
        for batch in phrases._packed(iter(put), 4):
            for row in batch.to_pylist():
                keys, n, rids = (phrases._joined(pa.chunked_array([[row[c]]], pa.binary()), t) for c, t in (("keys", np.uint64), ("n", np.int64), ("rids", np.int64)))
                assert set((keys >> np.uint64(60)).tolist()) == {row["part"]} and (rids >> 32 == 7).all()
                for key, m in zip(keys.tolist(), n.tolist()):
                    found[row["shard"], key] += m
        assert found == wanted
