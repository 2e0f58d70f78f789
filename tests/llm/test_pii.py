import hashlib
import math
import random
import re
import time
from collections import Counter

from lengthlab.llm import pii

# The contract's patterns, as given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(GIVEN.items()):
        found += [(m.start(), k, m.end(), kind + ":" + m[0].lower()) for m in re.finditer(pattern, text) if valid(kind, m[0])]
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def blanked(text):
    """The text with the valid matches of each kind in turn replaced by blanks."""
    for kind, pattern in GIVEN.items():
        text = re.sub(pattern, lambda m: " " * len(m[0]) if valid(kind, m[0]) else m[0], text)
    return text


def words(text):
    """(start, end, word) of the runs of three or more letters and digits with a letter."""
    return [(*m.span(), m[0].lower()) for m in re.finditer(r"[^\W_]+", blanked(text)) if len(m[0]) >= 3 and re.search(r"[^\W\d_]", m[0])]


def near(text, spans):
    """The set of (key, term, start) near each base span."""
    own = words(text)
    return {
        (key, w, a) for s, _, e, key in spans for a, b, w in own if s - 60 <= a and b <= s or e <= a and b <= e + 60
    }


def expected(texts):
    spans = [base(t) for t in texts]
    around = [near(t, s) for t, s in zip(texts, spans)]
    c_et = Counter((k, t) for rows in around for k, t, _ in rows)
    n_e = Counter()
    for (k, _), n in c_et.items():
        n_e[k] += n
    c_t = Counter(w for t in texts for _, _, w in words(t))
    total = sum(c_t.values())
    told = {
        t
        for (k, t), n in c_et.items()
        if n >= 3 and 2 * n >= c_t[t] and 1 + math.log2(n / c_t[t]) / -math.log2(n_e[k] / total) >= 0.9
    }
    out = []
    for text, s in zip(texts, spans):
        terms = {(a, 4, b) for a, b, w in words(text) if w in told}
        out.append((listed([x[:3] for x in s]), listed(sorted({x[:3] for x in s} | terms))))
    return out


TEXTS = [
    "",
    "mail a@b@c.de and x.y+z@mail-1.example.com. or a@b.c_x@d.e and @x.y a@b. done",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.255 1.2.3 9.9.9.9999",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112 12 3 1  2 79927398713 00000000000000",
    "+1 (017) 555-7713 and +44 20 7946 0958. +1 2 +123456789012345678 +1-(((555)))-0100-22",
    "é😀 10.0.0.1 é😀 +49 30 1234567890",
    "1" * 3000 + " " + "a" * 5000 + " " + "1-" * 4000 + "@" * 100,
    "4111 1111 1111 1111.2.3.4 and +4111111111111111",
]


def test_base_spans_match_the_given_patterns(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("a.@-+ 0123456789()b_%é") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.personal_data(df).collect():
        spans = base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(listed([s[:3] for s in spans]).encode()).hexdigest(), texts[row.doc_id][:150]
        counts = Counter(k for _, k, _, _ in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [counts[k] for k in range(4)]


def test_terms_match_brute_force(spark):
    rng = random.Random(3)
    common = [a + b for a in ("stone", "river", "cloud", "grass", "light") for b in ("", "ing", "like", "ward", "some")]
    telling = {"ann@corp.example.org": ["treasurer", "harbourside"], "10.1.2.3": ["mainframe"], "+49 30 1234567": ["hotline", "ückendorf"]}
    texts = []
    for i in range(120):
        chosen = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        for entity in rng.sample(sorted(telling), rng.randint(0, 2)):
            at = rng.randint(0, len(chosen))
            chosen[at:at] = [rng.choice(telling[entity]), entity, rng.choice(telling[entity])]
        texts.append(" ".join(chosen))
    texts.append("the mainframe and a hotline far from anything protected")
    texts += ["Mail ann@corp.example.org, phone +49 30 1234567, Li Wu7 room42" + " stone" * 30] * 3
    texts += ["x" * 70 + " edge ann@corp.example.org", "abc10.1.2.3abc mainframe", "-" * 61 + "word10.1.2.3", "10.1.2.3 " + "-" * 55 + "last4 more"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = expected(texts)
    assert sum("term" in w for _, w in wanted) > 20
    for word in ("mainframe", "room42", "wu7", "treasurer"):  # every occurrence, near an entity or not
        assert all(f"term:{a}:{b}" in w for t, (_, w) in zip(texts, wanted) for a, b, x in words(t) if x == word), word
    for row in pii.personal_data(df).collect():
        assert row.spans == wanted[row.doc_id][1], texts[row.doc_id]


def test_large_term_sets_take_the_other_way(spark, monkeypatch):
    texts = ["the treasurer wrote to ann@corp.example.org again"] * 4 + ["nothing here at all"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = sorted(map(tuple, pii.personal_data(df).collect()))
    monkeypatch.setattr(pii, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(pii, "MAX_BROADCAST_CHARS", 0)
    assert sorted(map(tuple, pii.personal_data(df).collect())) == small


def test_sanitised_and_odd_rows(spark):
    rows = [(1, "Mail bob@site.example now", "a"), (1, "Mail bob@site.example now", "a"), (None, None, None), (2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.sanitised(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == ["", "Mail [EMAIL] now", "Mail [EMAIL] now", "None"]
    assert pii.personal_data(df).count() == 4
    assert pii.personal_data(df.limit(0)).count() == 0 and pii.sanitised(df.limit(0)).count() == 0


def test_work_is_linear_in_the_matches_of_a_text(spark):
    """100,000 numbers in one text; twice the text takes about twice the time."""
    took = []
    for n in (50_000, 100_000):
        text = " ".join(f"10.{i % 256}.{i // 256 % 256}.7 host{i % 50}" if i % 4 == 0 else str(10 + i % 90) for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.monotonic()
        row = pii.personal_data(df).first()
        clean = pii.sanitised(df).first().text
        took.append(time.monotonic() - start)
        assert row.n_ip == n // 4 and row.base_sha256 == hashlib.sha256(listed([x[:3] for x in base(text)]).encode()).hexdigest()
        assert clean.count("[IP]") == n // 4 and not base(clean)
    assert took[1] < 60 and took[1] < 4 * took[0] + 5


def test_sanitised_texts_match_the_spans(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("a.@-+ 0123456789()b_%é") for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.sanitised(df).collect():
        at, out, text = 0, "", texts[row.doc_id]
        for s, k, e, _ in base(text):
            if s >= at:
                out += text[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        assert row.text == out + text[at:]
