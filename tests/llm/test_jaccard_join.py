import random
import re

import pytest

from lengthlab.llm import jaccard_join, set_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(rng):
    """Groups of texts on both sides of the similarity, most of them small, some of them chains."""
    texts, passage = [], [f"p{i}" for i in range(40)]
    for size in (9, 11, 12, 21, 22, 25, 32, 40, 60, 150):
        for _ in range(3):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(7):
                texts.append(" ".join(words))
                words = list(words)
                for _ in range(1 + size // 60):
                    kind, at = rng.randrange(4), rng.choice([0, 1, len(words) - 1, rng.randrange(len(words))])
                    if kind == 0:
                        words[at] = f"x{rng.randrange(10**6)}"
                    elif kind == 1:
                        words = words[1:]
                    elif kind == 2:
                        words = words[:-1]
                    else:
                        words.append(f"y{rng.randrange(10**6)}")
    texts += [" ".join([f"z{rng.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(40)]
    return texts


@pytest.mark.parametrize("limit", [None, 0, 25])
def test_components_match_brute_force_on_either_side_of_the_boundary(spark, monkeypatch, limit):
    monkeypatch.setattr(set_join, "SAMPLE", 2)
    monkeypatch.setattr(set_join, "PART", 5)
    texts = near_copies(random.Random(2))
    texts += texts[:5] + [None, "", " \t", "a", "A", "a b"]
    texts.append("long word " * 40_000)
    least, sizes = plain_components(texts)
    ids = {}
    for i, group in enumerate(least):
        ids.setdefault(group, i)
    wanted = sorted((i, sizes[i], ids[group]) for i, group in enumerate(least))
    assert 40 < len(ids) < len(texts) - 60
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, size string").repartition(3)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, limit=limit).collect())) == wanted


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words), (7, words), (7, words.upper()), (5, words + " more"), (None, None), (3, None), (3, ""), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    wanted = [(None, 48, 5), (7, 48, 5), (7, 48, 5), (5, 49, 5), (None, 0, None), (3, 0, 3), (3, 0, 3), (None, 1, None)]
    assert found == sorted(wanted, key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_what_subsets_and_prefixes_must_hold():
    for like in (jaccard_join.NEAR, set_join.Likeness(5, 4, 5)):
        for n in range(1, 120):
            for m in range(1, 120):
                least = next((k for k in range(min(n, m) + 1) if like.q * k >= like.p * (n + m - k)), None)
                assert (least is None) == (like.required(n, m) > min(n, m))
                if least is not None:
                    assert least == like.required(n, m) and m >= like.least_partner(n) and least >= like.least_partner(max(n, m))
                    if n != m or least < n:
                        assert m in like.partners(n, 200) and least in like.shared(n, 200)
