"""Text formats in which a bad record is a failed row, not a failed job: JSON lines, JSON arrays and fields, CSV.

Readers return the declared columns plus `line` (1-based) or `element` (0-based) within the file, `path` and
`error_code` (null for good rows; failed rows have null columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.scratch import stored
from lengthlab.sources.json_split import split_elements

# Cells that stand for a missing value in CSV files.
NA_TOKENS = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "n/a", "#N/A", "<NA>", "None")


def indexed_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, value): every line with its 1-based number in its file.

    A text scan has no row index, but splits of a file are read in order: lines are numbered within
    partitions, and the counts of the partitions before give the offset. Only counts are gathered.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("rid").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, ["path", "block"])  # a row per file block: broadcast only if Spark finds it small
    return joined.select("path", (F.col("offset") + F.col("rid") - F.col("first") + 1).alias("line"), "value")


def _too_large(text: Column) -> Column:
    """Whether a number with a point or an exponent is beyond double range; what stands in strings does not count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"), F.lit(0))
    beyond = F.exists(numbers, lambda n: n.rlike("[.eE]") & (n.try_cast("double") == float("inf")))
    return F.when(text.rlike(r"[0-9][eE]\+?[0-9]{2}|[0-9]{300}"), beyond).otherwise(False)


def _record_problem(text: Column, parsed: Column) -> Column:
    """Why a JSON record is bad: invalid_utf8, json_parse (a repeated key and an infinite number too), not_an_object,
    schema_mismatch; null if it is fine."""
    variant = F.try_parse_json(text)
    return (
        F.when(~F.is_valid_utf8(text), "invalid_utf8")
        .when(variant.isNull() | _too_large(text), "json_parse")
        .when(~F.schema_of_variant(variant).startswith("OBJECT"), "not_an_object")
        .when(parsed.isNull(), "schema_mismatch")
    )


def _parsed(rows: DataFrame, text: str, schema: T.StructType, position: str) -> DataFrame:
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    value = F.from_json(F.col(text), corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = rows.withColumn("_value", value)
    usable = F.when(F.col("_value._corrupt").isNull(), F.col("_value"))
    df = df.withColumn("error_code", _record_problem(F.col(text), usable))
    good = F.col("error_code").isNull()
    return df.select("path", position, *[F.when(good, F.col(f"_value.`{f.name}`")).alias(f.name) for f in schema.fields], "error_code")


def scan_json_lines(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> DataFrame:
    """JSON lines; a bad line is a failed row with its number, blank lines are skipped."""
    lines = indexed_lines(spark, paths).where(F.trim("value") != "")
    return _parsed(lines, "value", schema, "line")


def _elements(elements: DataFrame) -> DataFrame:
    """(path, element, value) as text lines are: scalars are wrapped as {"text": item}; an unfinished element is no JSON."""
    item = F.btrim(F.col("text").cast("string"), F.lit(" \t\r\n"))
    scalar = ~item.rlike(r"^[\[{]") & (item != "null") & F.try_parse_json(item).isNotNull()
    wrapped = F.concat(F.lit('{"text":'), F.when(item.startswith('"'), item).otherwise(F.concat(F.lit('"'), item, F.lit('"'))), F.lit("}"))
    value = F.when(~F.col("whole"), "").when(scalar, wrapped).otherwise(item)
    return elements.select("path", "element", value.alias("value"))


def _failed(files: DataFrame, schema: T.StructType, code: str) -> DataFrame:
    """One failed row for each file that has no elements to give."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return files.select("path", F.lit(None).cast("long").alias("element"), *empty, F.lit(code).alias("error_code"))


def scan_json_array(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> DataFrame:
    """One JSON array per file: objects, or scalars wrapped as {"text": item}.

    A bad element, and the element in which a cut file ends, is a failed row; so is a file that holds no array
    (`not_an_array`, without an element). A file is read by many tasks, see json_split.
    """
    elements, _, files = split_elements(spark, paths, 1, stored)
    other = files.where(~F.col("opening").eqNullSafe("["))
    if not other.isEmpty():
        elements = elements.join(F.broadcast(other.select("path")), "path", "left_anti")  # files, not rows
    return _parsed(_elements(elements), "value", schema, "element").unionByName(_failed(other, schema, "not_an_array"))


def scan_json_field(spark: SparkSession, paths: list[str] | str, field: str, schema: T.StructType) -> DataFrame:
    """The rows below one key of one JSON object per file.

    A row of another kind, and the row in which a cut file ends, is a failed row; so is a file without the field
    or with no array there (`json_field_unreadable`, without an element). A file is read by many tasks, see json_split.
    """
    elements, headers, files = split_elements(spark, paths, 2, stored)
    key = F.regexp_extract(F.col("text").cast("string"), r'^[\x{FEFF}\s]*\{?\s*("(?:[^"\\]|\\.)*")\s*:\s*\[$', 1)
    name = F.from_json(F.concat(F.lit('{"k":'), key, F.lit("}")), "k string")["k"]
    chosen = stored(headers.where(name == field).groupBy("path").agg(F.min("section").alias("section")), "sections")
    found = elements.join(F.broadcast(chosen), ["path", "section"])  # a row per file
    missing = files.join(chosen, "path", "left_anti")
    return _parsed(_elements(found), "value", schema, "element").unionByName(_failed(missing, schema, "json_field_unreadable"))


def scan_csv(
    spark: SparkSession, paths: list[str] | str, schema: T.StructType, sep: str = ",", na: tuple[str, ...] = NA_TOKENS
) -> DataFrame:
    """CSV with a header, quoted separators and line ends; the declared columns are found by their names in it.

    A declared column that the header lacks is null, other columns are not kept. All files of a call have the header of
    the first; another one is an error, so no column can take another's place. Cells in `na` are null; values that do
    not fit the type fail the row. `element` is the 0-based place of the record in its file.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "sep": sep, "enforceSchema": False}
    rows = spark.read.options(**options).csv(paths)
    there = set(rows.columns)
    cells = [F.col(f"`{f.name}`") if f.name in there else F.lit(None).cast("string") for f in schema.fields]
    clean = [F.when(~c.isin(*na), c).alias(f.name) for f, c in zip(schema.fields, cells)]
    place = F.monotonically_increasing_id().alias("_place")  # a file with quoted line ends is read by one task, in order
    rows = rows.select(F.col("_metadata.file_path").alias("path"), place, *clean)
    first = rows.groupBy("path").agg(F.min("_place").alias("_first"))
    rows = rows.join(first, "path").withColumn("element", F.col("_place") - F.col("_first"))
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    lost = F.lit(False)
    for name, value in cast.items():
        lost = lost | (F.col(f"`{name}`").isNotNull() & value.isNull())
    good = [F.when(~lost, v).alias(n) for n, v in cast.items()]
    return rows.select("path", "element", *good, F.when(lost, "schema_mismatch").alias("error_code"))
