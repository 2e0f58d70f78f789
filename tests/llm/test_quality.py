import re
from collections import Counter

from lengthlab.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def counts(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)


def test_base_counts_match_brute_force(spark):
    texts = [
        "",
        " \t\n",
        "a",
        "a b",
        "a a a a a",
        "x y z x y z q",
        "one two three\none two three\n\n \nother | # line",
        "é É ß x \x0b y\x0c\r z 😀 \x1c #&%",
        "the cat sat on the mat " * 3000,
        " ".join(f"w{i * 7919 % 1000}" for i in range(4000)),
    ]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for row in quality.quality(df).collect():
        assert counts(row) == plain(texts[row.doc_id]), row.doc_id


def test_divergent_documents_are_rejected_and_plain_ones_kept(spark):
    good = "The old men of the town said that it was time to go in for the day, as planned with care. "
    rows = [(i, good * (3 + i % 4) + f"Some more words follow in line {i}.", "en") for i in range(60)]
    rows = [(i, " ".join(dict.fromkeys(f"{w}{k}" if k % 3 else w for k, w in enumerate(t.split()))), l) for i, t, l in rows]
    rows.append((900, " ".join(f"{'#$%'[k % 3] * 9}{k}" for k in range(120)), "en"))
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not out[900].base_failed and not out[900].kept
    assert all(out[i].kept for i in range(60) if not out[i].base_failed)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, None, "a"), (1, text, None, "a"), (None, None, "xx", None), (2, "", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, q string")
    out = quality.quality(df).collect()
    assert len(out) == 4 and sum(r.kept for r in out) == 2
    assert {r.base_failed for r in out if r.doc_id in (None, 2)} == {True}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 2
    assert quality.quality(df.limit(0)).count() == 0
