import random

import numpy as np

from lengthlab.llm import licenses


def full_best(template, ids):
    """The best local alignment over the whole document, without index or band."""
    found = licenses.align(template, ids, -len(template), len(ids))
    return found[0] if found else 0


def text_with(rng, line, edits):
    words = licenses.WORD.findall(line)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        words[at : at + 1] = [] if kind < 0.3 else ["filler"] if kind < 0.6 else [words[at], "extra"]
    noise = lambda: " ".join(rng.choice(["the", "of", "license", "under", "zeta", "kappa", "software", "work"]) for _ in range(60))
    return f"{noise()}\n{' '.join(words)}\n{noise()}"


def test_detections_match_full_alignment(spark):
    """No notice or paragraph that full alignment finds is missed, and none is reported that it does not find."""
    rng = random.Random(7)
    every = licenses.default_templates()
    chosen = {name: every[name] for name in (*licenses.TEMPLATES, "mit", "zlib", "bsd-3-clause", "unlicense")}
    parts = [p for parts in chosen.values() for p in parts]
    lines = [rng.choice(list(licenses.TEMPLATES.values())) for _ in range(90)] + [rng.choice(parts) for _ in range(50)]
    texts = [text_with(rng, line, rng.randint(0, 4)) for line in lines]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.license, r.part): r for r in licenses.scan(df, chosen).collect()}
    index = licenses.Index(chosen)
    for i, text in enumerate(texts):
        ids = np.array([index.vocabulary.get(w, -1) for w in licenses.WORD.findall(text.lower())])
        for t, owners in enumerate(index.owners):
            wanted = full_best(index.words[t].tolist(), ids)
            for name, part in owners:
                if wanted >= licenses.MIN_COVERAGE * len(index.words[t]):
                    assert (i, name, part) in found, (text, name, part)
                    assert found[i, name, part].matched_words <= wanted
                else:
                    assert (i, name, part) not in found


def test_whole_texts_are_covered(spark):
    """A document that holds a whole license has nearly all its paragraphs; one with another license does not."""
    every = licenses.default_templates()
    names = ["mit", "bsd-2-clause", "isc", "zlib", "bsl-1.0", "gpl-2.0", "apache-2.0"]
    rows = [(i, "before it all\n" + "\n\n".join(every[name]) + "\nafter") for i, name in enumerate(names)]
    share = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        share[r.doc_id, r.license] = r.license_coverage
    for i, name in enumerate(names):
        assert share[i, name] > 0.99
    assert share.get((0, "gpl-2.0"), 0) < 0.1 and (5, "mit") not in share and share.get((1, "bsd-3-clause"), 0) < 0.95


def test_spans_and_several_places(spark):
    line = licenses.TEMPLATES["mit-line"]
    text = f"Some text. {line} More text é. {line}"
    out = sorted(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.start)
    assert [(r.license, text[r.start : r.stop]) for r in out] == [("mit-line", line[:-1])] * 2
    assert all(r.coverage == r.license_coverage == 1.0 for r in out) and out[0].stop <= out[1].start


def test_odd_rows(spark):
    line = licenses.TEMPLATES["apache-2.0-line"]
    rows = [(1, None, "x"), (None, line, "y"), (2, "", ""), (3, line, "z"), (3, line, "z"), (4, "word " * 50000 + line, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert sorted(str(r.doc_id) for r in licenses.scan(df).where("license = 'apache-2.0-line'").collect()) == ["3", "3", "4", "None"]
    assert licenses.scan(df.limit(0)).count() == 0
