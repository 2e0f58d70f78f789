"""Quality rules with a distribution-divergence verdict, in SQL functions only.

Per document: base counts (words, symbols, repeated lines, words in repeated 3-word windows) and two
histograms, of character classes and of common words of the document's language. The histograms of all
documents of a language, summed, are the language's reference. A document whose Jensen-Shannon distance to
a reference exceeds a threshold is rejected; a histogram built on too few characters or words is not
judged. Everything stays inside built-in functions: one pass over the texts, then sums over a narrow table.

Repeated windows are found by sorting 64-bit hashes of a document's own windows (about n log n for n words).
Null text counts as empty (no words, so base_failed); a null language counts as the language ''; a language
without a word list is judged by characters only; repeated rows are judged alike; very long texts are judged
whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lengthlab.llm.common import SPACE, SPACE_CHARS, materialise, read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.29
#: Characters and words below which a histogram is not judged.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 100

# Frequent words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "was"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "des", "im", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}

#: Character classes in the order in which they are taken out of the text; what is left is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", f"[{SPACE}]+", "[0-9]+", "[.,;:!?'\"()-]+", "[\\x21-\\x7E]+", "\\p{L}+")
SYMBOLS = "[#*$%&|<>]+"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27").replace('"', "\\x22") + "'"


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns row (a struct of all input columns) and q (a struct of counts and histograms)."""
    space = _quoted(f"[{SPACE}]+")
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    left = "text"
    for k, pattern in enumerate(CLASSES):
        if k == 5:
            df = df.withColumn("n_symbols", F.expr(f"length({left}) - length(regexp_replace({left}, {_quoted(SYMBOLS)}, ''))"))
        df = df.withColumn(f"left{k}", F.expr(f"regexp_replace({left}, {_quoted(pattern)}, '')"))
        df = df.withColumn(f"class{k}", F.expr(f"length({left}) - length(left{k})"))
        left = f"left{k}"
    counts = ", ".join([f"class{k}" for k in range(len(CLASSES))] + [f"length({left})"])
    df = df.select(
        "row",
        "lang",
        "text",
        "n_symbols",
        F.expr(f"array({counts})").alias("classes"),
        F.expr("length(text) - class2").alias("word_chars"),
        F.btrim("text", F.lit(SPACE_CHARS)).alias("trimmed"),
        F.concat(F.lit("  "), F.expr(f"regexp_replace(lower(text), {space}, '  ')"), F.lit("  ")).alias("spaced"),
        F.expr(f"filter(split(text, '\\n'), l -> l rlike r'[^{SPACE}]')").alias("lines"),
    )
    histograms = " ".join(
        f"when '{lang}' then array({', '.join(_occurrences(w) for w in words)})" for lang, words in COMMON_WORDS.items()
    )
    df = df.select(
        "row",
        "lang",
        "n_symbols",
        "classes",
        "word_chars",
        F.expr(f"if(trimmed = '', array(), split(trimmed, {space}))").cast("array<string>").alias("words"),
        F.expr("size(lines) - size(array_distinct(lines))").alias("n_dup_lines"),
        F.expr(f"case lang {histograms} end").alias("common"),
    )
    df = df.withColumn(
        "windows",
        F.expr(
            "if(size(words) < 3, cast(array() as array<bigint>), "
            "transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))))"
        ),
    )
    df = df.withColumn(
        "ordered",
        F.expr(
            "if(size(windows) = size(array_distinct(windows)), null, "
            "sort_array(transform(windows, (h, i) -> struct(h as h, i as i))))"
        ),
    )
    df = df.withColumn(
        "starts",
        F.expr(
            "sort_array(transform(filter(ordered, (x, k) -> get(ordered, k - 1).h <=> x.h or get(ordered, k + 1).h <=> x.h), x -> x.i))"
        ),
    )
    covered = (
        "coalesce(aggregate(transform(starts, (s, k) -> least(3, coalesce(get(starts, k + 1) - s, 3))), 0, (a, x) -> a + x), 0)"
    )
    return df.select(
        "row",
        F.struct(
            F.col("lang"),
            F.expr("cast(size(words) as bigint)").alias("n_words"),
            F.col("word_chars").cast("long").alias("word_chars"),
            F.col("n_symbols").cast("long").alias("n_symbols"),
            F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
            F.expr(f"cast({covered} as bigint)").alias("n_repeat_words"),
            F.expr("transform(classes, x -> cast(x as bigint))").alias("classes"),
            F.expr(
                "transform(concat(common, array(size(words) - aggregate(common, cast(0 as bigint), (a, x) -> a + x))), x -> cast(x as bigint))"
            ).alias("common"),
        ).alias("q"),
    )


def _occurrences(word: str) -> str:
    """Times the word stands between spaces in `spaced`, where each gap holds two."""
    return f"(octet_length(spaced) - octet_length(replace(spaced, ' {word} ', ''))) div {len(word) + 2}"


def references(featured: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): per language the sums of all documents' histograms."""
    bins = [("classes", k) for k in range(len(CLASSES) + 1)] + [("common", k) for k in range(13)]
    sums = [F.sum(F.get(F.col(f"q.{name}"), F.lit(k))).alias(f"{name}{k}") for name, k in bins]
    out = featured.groupBy(F.col("q.lang").alias("lang")).agg(*sums)
    return out.select(
        "lang",
        F.array(*[f"classes{k}" for k in range(len(CLASSES) + 1)]).alias("ref_classes"),
        F.array(*[f"common{k}" for k in range(13)]).alias("ref_common"),
    )


def _distance(one: str, other: str) -> str:
    """SQL for the Jensen-Shannon distance of two count arrays; null where either holds nothing."""
    total = "aggregate({0}, cast(0 as double), (a, x) -> a + x)"
    part = "if({0} > 0, {0} * log2(2 * {0} / ({0} + {1})), 0)"
    terms = f"zip_with({one}, {other}, (x, y) -> struct(x / {total.format(one)} as p, y / {total.format(other)} as r))"
    halves = f"transform({terms}, t -> {part.format('t.p', 't.r')} + {part.format('t.r', 't.p')})"
    divergence = f"aggregate({halves}, cast(0 as double), (a, x) -> a + x) / 2"
    return f"if({total.format(one)} > 0 and {total.format(other)} > 0, sqrt(greatest({divergence}, 0)), null)"


def judged(featured: DataFrame) -> DataFrame:
    """Adds char_distance, word_distance, base_failed and kept to a materialised feature table."""
    refs = materialise(references(featured), "references")
    df = featured.withColumn("lang", F.col("q.lang")).join(refs, "lang")
    df = df.withColumn("char_distance", F.expr(_distance("q.classes", "ref_classes")))
    df = df.withColumn("word_distance", F.expr(_distance("q.common", "ref_common")))
    df = df.withColumn(
        "base_failed",
        F.expr(f"q.n_words < {MIN_WORDS} or 100 * q.n_repeat_words > {MAX_REPEAT_PERCENT} * q.n_words"),
    )
    chars = f"aggregate(q.classes, cast(0 as bigint), (a, x) -> a + x) >= {MIN_CHARS}"
    return df.withColumn(
        "kept",
        F.expr(
            f"not base_failed and not coalesce({chars} and char_distance > {MAX_CHAR_DISTANCE}, false) "
            f"and not coalesce(q.n_words >= {MIN_HISTOGRAM_WORDS} and word_distance > {MAX_WORD_DISTANCE}, false)"
        ),
    )


def quality(docs: DataFrame) -> DataFrame:
    """One row of counts, distances and verdict per document."""
    df = judged(materialise(features(docs.select("doc_id", "text", "lang")).withColumn("row", F.struct("row.doc_id")), "features"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select("row.doc_id", *[f"q.{c}" for c in base], "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(materialise(features(docs), "features")).where("kept").select("row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def oracle_sql() -> str:
    """The same query in DuckDB SQL; repeated windows are counted on the words themselves."""
    left, steps, counts = "text", [], []
    for k, pattern in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        if k == 5:
            steps.append(f"length({left}) - length(regexp_replace({left}, '{SYMBOLS}', '', 'g')) AS n_symbols")
        steps.append(f"regexp_replace({left}, '{quoted}', '', 'g') AS left{k}")
        counts.append(f"length({left}) - length(left{k})")
        left = f"left{k}"
    counts.append(f"length({left})")
    common = " ".join(
        f"WHEN '{lang}' THEN [{', '.join(f'len(list_filter(lowered, lambda w: w = {chr(39)}{w}{chr(39)}))' for w in words)}]"
        for lang, words in COMMON_WORDS.items()
    )
    bins = len(CLASSES) + 1

    def distance(one: str, other: str) -> str:
        p, r = f"({one}[k] / list_sum({one})::DOUBLE)", f"({other}[k] / list_sum({other})::DOUBLE)"
        half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
        total = f"list_sum(list_transform(range(1, len({one}) + 1), lambda k: {half.format(p, r)} + {half.format(r, p)}))"
        return f"CASE WHEN list_sum({one}) > 0 AND list_sum({other}) > 0 THEN sqrt(greatest({total} / 2, 0)) END"

    class_refs = ", ".join(f"sum(classes[{k + 1}])" for k in range(bins))
    common_refs = ", ".join(f"sum(common[{k + 1}])" for k in range(13))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), c AS (SELECT *, {", ".join(steps)} FROM d),
w AS (
  SELECT rid, doc_id, lang, n_symbols, [{", ".join(counts)}] AS classes,
    length(text) - (length(left1) - length(left2)) AS word_chars,
    regexp_extract_all(text, '[^{SPACE}]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) AS lines
  FROM c
), x AS (SELECT *, list_transform(words, lambda w: lower(w)) AS lowered FROM w),
h AS (
  SELECT rid, doc_id, lang, n_symbols, classes, word_chars, len(words) AS n_words,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CASE lang {common} END AS counted
  FROM x
), q AS (
  SELECT *, CASE WHEN counted IS NOT NULL THEN list_append(counted, n_words - list_sum(counted)::BIGINT) END AS common FROM h
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w) s
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) s GROUP BY rid
), ref AS (SELECT lang, [{class_refs}] AS ref_classes, [{common_refs}] AS ref_common FROM q GROUP BY lang),
j AS (
  SELECT q.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    {distance("classes", "ref_classes")} AS char_distance, {distance("common", "ref_common")} AS word_distance
  FROM q JOIN ref USING (lang) LEFT JOIN rep USING (rid)
), v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(list_sum(classes) >= {MIN_CHARS} AND char_distance > {MAX_CHAR_DISTANCE}, false)
    AND NOT coalesce(n_words >= {MIN_HISTOGRAM_WORDS} AND word_distance > {MAX_WORD_DISTANCE}, false) AS kept
FROM v
"""
