import hashlib
import random

import pytest

from lengthlab.llm import suffix_dedup as sd


def brute(rows):
    """rows: (doc_id, text) in corpus order; the expected digest columns."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        flags = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                flags[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, f in zip(data, flags) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        out.append((doc_id, len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r) for r in sd.removals(df, **more).collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 24, 30, 60, 150)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            passage = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(passage)), 2))
            parts += [text(rng.randint(0, 40)), passage if rng.random() < 0.5 else passage[a:b]]
        rows.append((i, " ".join(parts)))
    rows += [(60, "-" * 90), (61, "-" * 99), (62, "-" * 100), (63, "-" * 350), (64, "ab" * 200), (65, "xab" * 150 + "ab" * 60)]
    rows += [(66, rows[3][1]), (67, rows[5][1] + "!"), (68, "?" + rows[5][1]), (69, ""), (70, "\0" * 150 + "a" + "\0" * 150)]
    return rows


@pytest.mark.parametrize("most", [sd.MOST_SUFFIXES, 2])
def test_matches_brute_force(spark, most):
    rows = corpus(most)
    assert run(spark, rows, most=most) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    at, h = sd.anchors(sd.np.frombuffer(base.encode(), sd.np.uint8), sd.np.array([0, len(base)]))
    monkeypatch.setattr(sd, "PIECE", 4000)
    ((of, pos, hashes),) = list(sd._document_anchors([base.encode()]))
    assert set(at.tolist()) == set(pos.tolist()) and len(of) == len(hashes)


def test_repeated_and_odd_rows(spark):
    text = "some words that are long enough to count as a passage of one hundred bytes or more, which this surely is now"
    rows = [(None, text), (1, text), (1, "other " + text), (2, None), (2, ""), (3, text), (3, text)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ord int, row string")
    out = sd.removals(df).collect()
    assert len(out) == 7
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert sum(r.n_removed for r in out) == 4 * len(text)
    left = sd.without_repeats(df)
    assert left.columns == df.columns and left.count() == 7
    assert sorted(r.text for r in left.where("doc_id = 1").collect()) == ["", "other "]
    assert sd.removals(df.limit(0)).count() == 0


def test_intervals_and_left_extensions():
    assert sorted(sd.intervals([0, 40, 50, 40, 0, 35], 32)) == [(0, 3, 40), (1, 2, 50), (4, 5, 35)]
    assert sd.left_extensions([2, 0, 1], [0, 5, 9]) == [5, -1, 9]
