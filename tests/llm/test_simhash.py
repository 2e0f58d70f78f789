import numpy as np
import xxhash

from lengthlab.llm import set_join, simhash


def plain_fingerprint(text):
    words = [w for w in text.encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_the_definition():
    for text in ("", " \n", "one", "One two THREE", "a b c d", "a b c d e f g a b c d", "é Ü x y z É " * 20):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * 2 + rng.integers(0, 2, 300, dtype=np.uint64)
    flipped = base.copy()
    for i in range(len(base)):
        bits = [3, 16, 30, 45] if i % 3 == 0 else rng.choice(64, rng.integers(0, 5), replace=False)
        if i % 3 == 0:
            bits = [int(rng.integers(low, low + width)) for low, width in rng.permutation(simhash.SEGMENTS)[:4]]
        for b in bits:
            flipped[i] ^= np.uint64(1) << np.uint64(b)
    rows_a, keys_a = simhash.keys_of(base)
    rows_b, keys_b = simhash.keys_of(flipped)
    for i in range(len(base)):
        assert set(keys_a[rows_a == i]) & set(keys_b[rows_b == i])


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(12):  # clusters that drift, so that many members are not within four bits of the first
        at = int(rng.integers(0, 1 << 62))
        for _ in range(25):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                at ^= 1 << int(b)
            prints.append(at)
    prints += [int(x) for x in rng.integers(0, 1 << 62, 100)] + [0, 0]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, fp long")
    found = {r.fp: r.component for r in simhash.fingerprint_components(df).collect()}
    expected = plain_components(prints)
    groups, wanted = {}, {}
    for i, s in enumerate(signed):
        groups.setdefault(found[s], set()).add(i)
        wanted.setdefault(expected[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, text, "x"), (2, text.upper(), "x"), (2, text, "x"), (3, None, None), (None, "", "x"), (5, "a " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert out[(3, "0" * 16)] == 3 and out[(None, "0" * 16)] == 3
    assert len({c for (i, _), c in out.items() if i in (1, 2)}) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_keeps_one_near_copy_and_all_clean_texts(spark):
    rng = np.random.default_rng(8)
    fresh = lambda: [f"w{rng.integers(0, 10**6)}" for _ in range(300)]
    base = [fresh() for _ in range(20)]
    rows = [(i, " ".join(words)) for i, words in enumerate(base)]
    for i in range(5):  # copies, and near copies that differ in one word
        rows.append((100 + i, rows[i][1]))
        words = list(base[i])
        words[150] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(None, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rid string")
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(20))
    assert simhash.one_of_each(df.limit(0)).count() == 0


def five_word_groups(texts):
    """The least index of each text's group by brute-force five-word Jaccard similarity."""
    sets = []
    for text in texts:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similar_groups_match_brute_force_five_word_similarity(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 10**5)}"
    line = [word() for _ in range(40)]  # stands in many texts that are not near copies
    texts = []
    for size in (6, 20, 60, 120, 200, 400):
        for _ in range(4):
            first = [word() for _ in range(size)]
            texts.append(" ".join(first))
            for _ in range(10):  # on both sides of 0.8, by changed words, added and lost ends
                words = list(first)
                for at in rng.choice(size, int(rng.integers(0, 2 + size // 25)), replace=False):
                    words[at] = word()
                words = words[int(rng.integers(0, 1 + size // 15)) :] + [word() for _ in range(int(rng.integers(0, 1 + size // 12)))]
                texts.append(" ".join(words))
    texts += [" ".join([word() for _ in range(60)] + line) for _ in range(40)]
    texts += [" ".join(line + [word() for _ in range(8)]) for _ in range(30)]
    # Few single words, so that SimHashes of words agree where the order of the words does not.
    for _ in range(5):
        words = [word() for _ in range(100)]
        texts += [" ".join(words), " ".join(rng.permutation(words))]
    rng.shuffle(texts)
    wanted = five_word_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 60 < len(set(wanted)) < len(texts) - 60
    monkeypatch.setattr(set_join, "SAMPLE", 2)
    found = {r.id: r.group_id for r in simhash.similar_groups(df).collect()}
    groups = lambda of: sorted([i for i in range(len(texts)) if of[i] == g] for g in {of[i] for i in range(len(texts))})
    assert groups(found) == groups(wanted)
