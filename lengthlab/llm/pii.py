"""Personal data and what reveals it, in SQL functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found per kind, leftmost and without
overlap, by regular expressions whose repetitions are possessive (no backtracking over long runs).

Information-theoretic sanitisation adds spans: words that stand near a protected entity can give it away
wherever they are read. An entity is the matched text of a base span. Over the whole corpus, c(e, t) counts the
occurrences of term t within REACH characters of entity e, c(t) all occurrences of t, n(e) the occurrences of
terms near e and N all terms. A term's disclosure of an entity is its pointwise mutual information with it, as a
share of what there is to know:

    disclosure(e, t) = log2(P(e | t) / P(e)) / log2(1 / P(e)),  P(e | t) = c(e, t) / c(t),  P(e) = n(e) / N

A term with c(e, t) >= MIN_SUPPORT, P(e | t) >= MIN_SHARE and a disclosure of at least THRESHOLD for some entity is
a disclosing term: all its occurrences, in any document, are spans of kind "term". Terms are words of the text in
which valid matches of each kind in turn are blanked, so what stands in a base span is no term, and contexts reach
past neighbouring spans. `sanitised` replaces base spans and terms by their kind's name.

Work is linear in a text: offsets are running sums over blocks of BLOCK matches, contexts are cut from chunks of
CHUNK characters, and their number grows with the number of base spans; no pairs are built within a document.

Null text counts as empty (no spans). Repeated rows are treated alike and count each time. Very long texts are
taken whole. An empty table gives no rows. Other columns are ignored by `personal_data` and kept by `sanitised`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import discard, look_up, materialise, read

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
#: Equal to the contract's patterns: a match never starts within a run of characters that could precede it.
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
VALID = {
    "email": "true",
    "ip": "forall(transform(split(m, '[.]'), p -> regexp_replace(p, '^0+', '')), z -> length(z) < 3 or length(z) = 3 and z <= '255')",
    "card": "length(regexp_replace(m, '[^0-9]', '')) between 14 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 10 and 15",
}
#: A run of three or more letters and digits with a letter in it.
TERM = "(?<![\\p{L}\\p{N}])(?=\\p{N}*+\\p{L})[\\p{L}\\p{N}]{3,}+"
#: Characters of context on either side of an entity.
REACH = 60
MIN_SUPPORT = 3
MIN_SHARE = 0.5
THRESHOLD = 0.9
#: Terms that may be broadcast to the passes over all words; beyond it the words are counted per text first.
MAX_BROADCAST_TERMS = 50_000
#: Characters of terms, by text, that may be broadcast to the texts; beyond it they are joined by a shuffle.
MAX_BROADCAST_CHARS = 4_000_000
#: Matches whose offsets are added up together; lists of this length are copied, so it bounds the copying.
BLOCK = 128
#: Characters of a chunk of text; a context lies in two chunks at most.
CHUNK = 1024


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body`, in which `name` stands for the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _found(text: str, pattern: str, matches: str | None = None) -> str:
    """SQL for the matches of a pattern as structs (s, e, v) of code point offsets and the matched text.

    The text is split at its matches; lengths of the gaps and matches, added up in order, give the offsets: first of
    blocks, then within each block, as a list that grows by appending is copied each time.
    """
    matches = matches or f"regexp_extract_all({text}, r'{pattern}', 0)"
    steps = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size(mm)), mm, (p, m) -> named_struct('g', length(p), 'l', length(m), 'v', m))"
    block = f"slice(zz, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size(zz) - 1) div {BLOCK})"
    lengths = f"transform({blocks}, b -> aggregate({block}, 0, (a, z) -> a + z.g + z.l))"
    starts = f"aggregate({lengths}, array(0), (acc, l) -> array_append(acc, element_at(acc, -1) + l))"
    place = "named_struct('s', acc.at + z.g, 'e', acc.at + z.g + z.l, 'v', z.v)"
    step = f"named_struct('at', acc.at + z.g + z.l, 'out', array_append(acc.out, {place}))"
    none = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    inside = f"aggregate({block}, named_struct('at', get(starts, b), 'out', {none}), (acc, z) -> {step}).out"
    placed = _let(starts, "starts", f"flatten(transform({blocks}, b -> {inside}))")
    return _let(matches, "mm", f"if(size(mm) = 0, {none}, {_let(steps, 'zz', placed)})")


def _cut(start: str, stop: str) -> str:
    """SQL for the characters from start to stop (0-based) of the text in `chunks`; no other chunks are touched."""
    held = f"slice(chunks, ({start}) div {CHUNK} + 1, ({stop}) div {CHUNK} - ({start}) div {CHUNK} + 1)"
    return f"substring(array_join({held}, ''), ({start}) % {CHUNK} + 1, ({stop}) - ({start}))"


def _chunks(text: str) -> str:
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def _contexts() -> str:
    """SQL for the surroundings of each base span: structs (key, at, before, stop, after).

    `before` starts at offset `at`, `after` at `stop`; each holds one character more than REACH at its far end, a blank
    at the text's edge, by which words that go on outside are told.
    """
    low, high = f"greatest(x.s - {REACH + 1}, 0)", f"least(x.e + {REACH + 1}, n)"
    before = f"concat(if(x.s <= {REACH}, ' ', ''), {_cut(low, 'x.s')})"
    after = f"concat({_cut('x.e', high)}, if(x.e + {REACH} >= n, ' ', ''))"
    at = f"if(x.s <= {REACH}, -1, {low})"
    return f"transform(base, x -> named_struct('key', x.key, 'at', {at}, 'before', {before}, 'stop', x.e, 'after', {after}))"


def _blanked() -> str:
    """SQL for the text with the valid matches of each kind in turn replaced by as many blanks."""
    out = "text"
    for kind, pattern in PATTERNS.items():
        blank = f"if({VALID[kind]}, repeat(' ', length(m)), m)"  # the last piece has no match
        joined = f"array_join(zip_with(split(t, r'{pattern}', -1), mm, (p, m) -> concat(p, coalesce({blank}, ''))), '')"
        out = _let(out, "t", _let(f"regexp_extract_all(t, r'{pattern}', 0)", "mm", f"if(size(mm) = 0, t, {joined})"))
    return out


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns row (all input columns), text, n_terms, base (structs s, k, e in order) and around (their contexts)."""
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    for kind, pattern in PATTERNS.items():
        there = f"contains(text, '{NEEDS[kind]}')" if kind in NEEDS else "text rlike '[0-9]'"
        df = df.withColumn(
            f"m_{kind}", F.expr(f"if({there}, regexp_extract_all(text, r'{pattern}', 0), cast(array() as array<string>))")
        )
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        valid = VALID[kind].replace("(m,", "(x.v,")
        spans = f"filter({_found('text', pattern, f'm_{kind}')}, x -> {valid})"
        spans = f"transform({spans}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'key', concat('{kind}:', lower(x.v))))"
        empty = "cast(array() as array<struct<s:int,k:int,e:int,key:string>>)"
        parts.append(f"if(size(m_{kind}) = 0, {empty}, {spans})")
    df = df.select("row", "text", F.expr(f"sort_array(concat({', '.join(parts)}))").alias("base"))
    # Columns that later columns use more than once are kept by Spark, not computed again for each use.
    df = df.withColumn("blanked", F.expr(f"if(size(base) = 0, null, {_blanked()})"))
    contexts = _let(_chunks("blanked"), "chunks", _let("length(blanked)", "n", _contexts()))
    none = "cast(array() as array<struct<key:string,at:int,before:string,stop:int,after:string>>)"
    return df.select(
        "row",
        "text",
        "blanked",
        F.expr(f"cast(regexp_count(coalesce(blanked, text), r'{TERM}') as bigint)").alias("n_terms"),
        F.expr("transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))").alias("base"),
        F.expr(f"if(size(base) = 0, {none}, {contexts})").alias("around"),
    )


def _near(found: DataFrame) -> DataFrame:
    """(rid, key, term, s): every occurrence of a term near an entity once, however many spans of it are near."""
    each = found.select("rid", F.explode("around").alias("a")).select("rid", "a.*")
    left = _found("before", "(?<=[^\\p{L}\\p{N}])" + TERM)
    right = _found("after", TERM + "(?=[^\\p{L}\\p{N}])")
    placed = "transform({0}, x -> named_struct('t', lower(x.v), 's', x.s + {1}))"
    terms = each.select("rid", "key", F.explode(F.expr(f"concat({placed.format(left, 'at')}, {placed.format(right, 'stop')})")).alias("x"))
    return terms.select("rid", "key", F.col("x.t").alias("term"), F.col("x.s").alias("s")).distinct()


def _uses(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, term, n): how often each of the terms stands in each text.

    Many terms are looked up after the words of each text have been counted, so a frequent word is one row per text,
    and its rows are not gathered under one key.
    """
    words = found.select("rid", F.explode(F.expr(f"regexp_extract_all(lower(coalesce(blanked, text)), r'{TERM}', 0)")).alias("term"))
    if terms.count() <= MAX_BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
        return materialise(words.groupBy("rid", "term").agg(F.count("*").alias("n")), "uses")
    each = materialise(words.groupBy("rid", "term").agg(F.count("*").alias("n")), "words")
    uses = materialise(look_up(each, terms, "term"), "uses")
    discard(each)
    return uses.select("rid", "term", "n")


def disclosing(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, term, disclosure) of the terms that reveal an entity, and (rid, term, n) of where these terms stand.

    `found` is a materialised base_spans table with rid.
    """
    near = materialise(_near(found), "near")
    pairs = materialise(near.groupBy("key", "term").agg(F.count("*").alias("c_et")), "pairs")
    entities = materialise(pairs.groupBy("key").agg(F.sum("c_et").alias("n_e")), "entities")
    # Places near entities are some of a term's places, so they bound its disclosures from above: common words go here.
    places = near.select("rid", "term", "s").distinct().groupBy("term").agg(F.count("*").alias("c_near"))
    places = materialise(places, "places")
    total = F.lit(found.agg(F.sum("n_terms")).first()[0] or 0)
    p_e = F.col("n_e") / total

    def reveals(c_t: str) -> tuple[Column, Column]:
        share = F.col("c_et") / F.col(c_t)
        disclosure = 1 + F.log2(share) / F.greatest(-F.log2(p_e), F.lit(1e-9))
        return disclosure, (disclosure >= THRESHOLD) & (share >= MIN_SHARE)

    # A word may stand near most entities and an entity near most words, so no key of these pairs is gathered.
    often = materialise(pairs.where(F.col("c_et") >= MIN_SUPPORT), "often")
    often = materialise(look_up(often, entities, "key"), "known")
    wanted = look_up(often, places, "term").where(reveals("c_near")[1])
    wanted = materialise(wanted.select("key", "term", "c_et", "n_e"), "wanted")
    terms = materialise(wanted.select("term").distinct(), "terms")
    uses = _uses(found, terms)
    counts = materialise(uses.groupBy("term").agg(F.sum("n").alias("c_t")), "counts")
    disclosure, holds = reveals("c_t")
    scored = look_up(wanted, counts, "term").where(holds).select("key", "term", disclosure.alias("disclosure"))
    scored = materialise(scored, "disclosures")
    telling = materialise(scored.select("term").distinct(), "telling")
    return scored, look_up(uses, telling, "term").select("rid", "term", "n")


def _with_spans(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns row, text, base and spans (base and terms in order), one row per input row."""
    found = base_spans(docs, text_col).withColumn("rid", F.monotonically_increasing_id())
    found = found.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in keep]))
    found = materialise(found, "spans")
    _, uses = disclosing(found)
    told = materialise(uses.groupBy("rid").agg(F.collect_set("term").alias("told")), "told")
    size = told.agg(F.sum(F.expr("16 + aggregate(told, 0L, (n, t) -> n + 16 + length(t))"))).first()[0] or 0
    few = size <= MAX_BROADCAST_CHARS
    out = found.drop("around").join(F.broadcast(told) if few else told, "rid", "left")
    terms = f"filter({_found('coalesce(blanked, text)', TERM)}, x -> array_contains(told, lower(x.v)))"
    terms = f"transform({terms}, x -> named_struct('s', x.s, 'k', 4, 'e', x.e))"
    return out.select("row", "text", "base", F.expr(f"if(told is null, base, sort_array(concat(base, {terms})))").alias("spans"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(get(array({names}), x.k), ':', x.s, ':', x.e)), ',')"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text."""
    df = _with_spans(docs.select(id_col, text_col), text_col, [id_col])
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return df.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        *counts,
        F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets."""
    df = _with_spans(docs, text_col, docs.columns)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    blocks, block = f"sequence(0, (size(spans) - 1) div {BLOCK})", f"slice(spans, b * {BLOCK} + 1, {BLOCK})"
    # How far spans have reached before each block, and at last; a span that begins before that is covered already.
    reach = f"aggregate(transform({blocks}, b -> array_max(transform({block}, x -> x.e))), array(0), (acc, m) -> array_append(acc, greatest(element_at(acc, -1), m)))"
    label = f"concat({_cut('acc.at', 'x.s')}, get(array({names}), x.k))"
    step = f"if(x.s < acc.at, named_struct('at', greatest(acc.at, x.e), 'out', acc.out), named_struct('at', x.e, 'out', array_append(acc.out, {label})))"
    pieces = f"transform({blocks}, b -> aggregate({block}, named_struct('at', get(reach, b), 'out', cast(array() as array<string>)), (acc, x) -> {step}).out)"
    whole = f"concat(array_join(flatten({pieces}), ''), {_cut('element_at(reach, -1)', 'length(text)')})"
    replaced = _let(_chunks("text"), "chunks", _let(reach, "reach", whole))
    clean = F.expr(f"if(size(spans) = 0, row.`{text_col}`, {replaced})")
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
