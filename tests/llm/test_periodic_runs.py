import hashlib
import random
from fractions import Fraction

from lengthlab.llm import periodic_runs as pr


def plain_runs(words):
    """Runs by walking along the words once per period."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_up(rng):
    words = [str(rng.randint(0, rng.choice([1, 3, 50]))) for _ in range(rng.choice([0, 1, 20, 90]))]
    for _ in range(rng.randint(0, 3)):  # runs of runs, cut anywhere
        unit = [str(rng.randint(0, 2)) for _ in range(rng.randint(1, 6))]
        part = unit * rng.randint(2, 12)
        part = part * rng.randint(1, 4) if rng.random() < 0.3 else part
        words += part[: rng.randint(1, len(part))] + [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 4))]
    return [w.encode() for w in words]


def test_runs_of_many_texts_match_a_plain_search():
    rng = random.Random(5)
    texts = [made_up(rng) for _ in range(1500)]
    wanted = [plain_runs(t) for t in texts]
    assert sum(len(w) > 1 for w in wanted) > 50 and any(not w for w in wanted)
    assert pr.find_runs(texts) == wanted
    assert [pr.find_runs([t])[0] for t in texts[:40]] == wanted[:40]
    assert pr.find_runs([]) == []


def test_long_periodic_texts_take_little_time():
    words = [b"a"] * 100_000
    assert pr.find_runs([words]) == [[(0, 100_000, 1)]]
    words = [b"%d" % (i % 7_000) for i in range(70_000)] + [b"end"]
    assert pr.find_runs([words]) == [[(0, 70_000, 7_000)]]


def test_digests_and_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, b" \n".join(made_up(rng)).decode(), "x") for i in range(300)]
    rows += [(0, "a " * 40, "x"), (None, "b " * 30, None), (1000, None, "x"), (1001, "", "x"), (1001, " \t\x0b", "x"), (1002, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    wanted = []
    for i, text, _ in rows:
        words = pr.periodic_tenth(i, (text or "").encode().split())
        runs = plain_runs(words) if len(words) < 1000 else [(0, 50_000, 1)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        rest = b" ".join(w for k, w in enumerate(words) if k not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        wanted.append((i, len(runs), *figures, hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest()))
    found = [tuple(r) for r in pr.run_digests(df, prepare=pr.periodic_tenth).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert pr.run_digests(df.limit(0)).count() == 0
    plain = {(r.doc_id, r.collapsed): r.runs for r in pr.runs_and_rest(df).collect()}
    assert [tuple(x) for x in plain[(None, "b")]] == [(0, 30, 1)]


def test_the_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pr.op13_periodic_runs(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        assert r.n_runs == len(plain_runs(pr.periodic_tenth(r.doc_id, docs[r.doc_id].encode().split())))
