"""Queries of sources and sinks: files are written from the given tables, then read by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.functions import redact
from lengthlab.operators import lengths as L
from lengthlab.plans.statistics import sql, text_lengths
from lengthlab.scratch import new_folder
from lengthlab.sources import arrow, files, text
from lengthlab.views import table, view

RECORD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])


def _json(df):
    return F.to_json(F.struct("doc_id", "lang"))


def _written_lines(spark, sf_dir, name="lines", parts=4, compression=None):
    """documents as JSON lines: of 50 one each is broken, no object, with a doubled key, with bytes that are no text and
    with an infinite number; every string ends like a number that would be infinite."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(" 9e1234")).alias("lang"))
    k = F.col("doc_id") % 50
    line = (
        F.when(k == 1, "{bad")
        .when(k == 2, "[1]")
        .when(k == 3, F.concat(F.lit('{"lang":"x",'), F.substring(_json(rows), 2, 1000)))
        .when(k == 5, F.concat(F.lit('{"lang":"'), F.expr("cast(unhex('FFFE') as string)"), F.lit('"}')))
        .when(k == 6, '{"doc_id":6e999}')
        .otherwise(_json(rows))
    )
    path = new_folder(spark, name)
    out = rows.select(F.when(k == 4, F.concat(line, F.lit("\n"))).otherwise(line).alias("value"))
    writer = out.repartition(parts).write
    (writer.option("compression", compression) if compression else writer).text(path)
    return path


_LINES = """
SELECT CASE WHEN doc_id % 50 NOT IN (1, 2, 3, 5, 6) THEN doc_id END AS doc_id, CASE WHEN doc_id % 50 NOT IN (1, 2, 3, 5, 6) THEN lang || ' 9e1234' END AS lang,
  CASE doc_id % 50 WHEN 1 THEN 'json_parse' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'json_parse' WHEN 5 THEN 'invalid_utf8' WHEN 6 THEN 'json_parse' END AS error_code FROM {documents}"""


def _src1(spark, sf_dir):
    return text.scan_json_lines(spark, _written_lines(spark, sf_dir), RECORD).select("doc_id", "lang", "error_code")


_ELEMENTS = """
SELECT CASE WHEN doc_id % 20 <> 1 THEN doc_id END AS doc_id, CASE WHEN doc_id % 20 <> 1 THEN lang || ' 9e1234' END AS lang,
  CASE WHEN doc_id % 20 = 1 THEN 'schema_mismatch' END AS error_code FROM {documents}"""

#: Documents of one written array.
ARRAY = 5000


def _written_arrays(spark, sf_dir, wrap=None):
    """documents as JSON arrays of at most ARRAY items, one per file."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("lang", F.lit(" 9e1234")).alias("lang"))
    item = F.when(F.col("doc_id") % 20 == 1, F.to_json(F.struct(F.lit("oops").alias("doc_id"), "lang"))).otherwise(_json(rows))
    chunk = F.floor(F.col("doc_id") / ARRAY).alias("chunk")
    whole = rows.groupBy("source", chunk).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    start = f'{{"note": [{{"{wrap}": [1, "],"]}}], "{wrap}": [' if wrap else "["
    path = new_folder(spark, "arrays")
    out = whole.select(F.concat(F.lit(start), "items", F.lit("]}" if wrap else "]")).alias("value"), "source")
    out.write.option("maxRecordsPerFile", 1).partitionBy("source").text(path)
    return path


def _src2(spark, sf_dir):
    return text.scan_json_array(spark, _written_arrays(spark, sf_dir), RECORD).select("doc_id", "lang", "error_code")


def _src3(spark, sf_dir):
    return text.scan_json_field(spark, _written_arrays(spark, sf_dir, "rows"), "rows", RECORD).select("doc_id", "lang", "error_code")


def _src4(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    path = new_folder(spark, "csv")
    k = F.col("doc_id") % 10
    out = rows.select(
        F.when(k == 1, "x1").otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(k == 2, "NA").when(k == 3, 'a "b", c\nd').otherwise(F.col("lang")).alias("lang"),
    ).select("lang", F.lit("kept out").alias("extra"), "doc_id")  # not the declared order
    out.write.csv(path, header=True, escape='"', quoteAll=True)
    return text.scan_csv(spark, path, RECORD).select("doc_id", "lang", "error_code")


def _split_files(spark, sf_dir):
    """documents as Parquet files, one per source and in order of their ids, in a train and a test folder.

    The sort begins with the folders' columns: the writer would else sort by them again, which drops the order of the ids.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source").withColumn("part", F.when(F.col("source") < "src3", "test").otherwise("train"))
    path = new_folder(spark, "split")
    rows.repartition("part", "source").sortWithinPartitions("part", "source", "doc_id").write.partitionBy("part", "source").parquet(path)
    found = files.layout(files.list_files(spark, path, "*.parquet"), {"test": "/part=test/", "train": "/part=train/"})
    return path, found


def _src5(spark, sf_dir):
    _, found = _split_files(spark, sf_dir)
    paths = [r.path for r in found.where("split = 'train'").orderBy("file_ord").collect()]
    return files.scan_parquet(spark, paths, columns=["doc_id", "n_chars"])


def _written_arrow(spark, sf_dir):
    """The folder and paths of documents as Arrow files, in stream and file form by turns, below the shared folder."""
    import pyarrow as pa

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    root = new_folder(spark, "arrow")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)
        system.create_dir(base, recursive=True)
        for i, batch in enumerate(batches):
            name = f"{base}/{TaskContext.get().partitionId()}-{i}.arrow"
            form = pa.ipc.new_stream if (TaskContext.get().partitionId() + i) % 2 else pa.ipc.new_file
            with system.open_output_stream(name) as sink, form(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    paths = [r.path for r in rows.repartition(4).mapInArrow(write, "path string").collect()]  # a listing
    return root, paths


def _src6(spark, sf_dir):
    return arrow.scan_arrow(spark, _written_arrow(spark, sf_dir)[0], "doc_id long, lang string")


def _coded(kind: str, data: bytes) -> bytes:
    """The bytes as a member of this compressed form."""
    import bz2
    import gzip
    import lzma

    import pyarrow as pa
    import zstandard

    if kind == "lz4":
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as stream:
            stream.write(data)
        return sink.getvalue().to_pybytes()
    forms = {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}
    return forms[kind](data) if kind in forms else data


def _written_members(spark, sf_dir):
    """The folder and paths of the lines of src1 in files of all compressed forms by turns, each of several members that
    end within lines."""
    import pyarrow as pa

    lines = spark.read.text(_written_lines(spark, sf_dir, "members")).select(F.col("value").cast("binary").alias("value"))
    root = new_folder(spark, "members")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)
        system.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        kind = ("gzip", "bz2", "xz", "zstd", "lz4", "plain")[part % 6]
        name = f"{base}/{part}.{kind}"
        with system.open_output_stream(name, compression=None) as sink:  # else the name would choose one more
            for batch in batches:
                data = b"".join(line + b"\n" for line in batch.column(0).to_pylist())
                for start in range(0, len(data), 5001):
                    sink.write(_coded(kind, data[start : start + 5001]))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return root, [r.path for r in lines.repartition(6).mapInArrow(write, "path string").collect()]  # a listing


def _src7(spark, sf_dir):
    """Each line with how often it is read: once by ranges of 2,000 bytes, once through Spark's own file access."""
    root, paths = _written_members(spark, sf_dir)
    lines = arrow.scan_text_files(spark, paths, split=2000).unionByName(arrow.scan_compressed_text(spark, root))
    lines = lines.where("value is null or trim(value) <> ''")
    return lines.groupBy("value", "error_code").agg(F.count("*").alias("n"), F.countDistinct("path", "line").alias("places"))


def _src8(spark, sf_dir):
    _, found = _split_files(spark, sf_dir)
    return files.load_split(spark, found, "test").select("doc_id")


def _indexed(spark, sf_dir, split="train"):
    _, found = _split_files(spark, sf_dir)
    return files.with_row_index(spark, files.load_split(spark, found, split), found, split)


def _src9(spark, sf_dir):
    return _indexed(spark, sf_dir).select("doc_id", "row_index", "row_id")


_INDEXED = "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM {documents} WHERE source >= 'src3'"


def _src10(spark, sf_dir):
    """The manifest of files whose bytes the SQL can spell: the ids of a source, one per line."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("value"), "source", "doc_id")
    path = new_folder(spark, "manifest")
    rows.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(path)
    manifest = files.build_manifest(spark, path).where("path like '%.txt'")
    named = manifest.withColumn("path", F.regexp_extract("path", "source=([^/]*)", 1))
    return named.crossJoin(files.content_identity(named.repartition(5)))  # one row


def _src11(spark, sf_dir):
    return files.verify_manifest(view(spark, sf_dir, "v_manifest_old"), view(spark, sf_dir, "v_manifest_new"))


def _src12(spark, sf_dir):
    _, found = _split_files(spark, sf_dir)
    counts = None
    for split in ("train", "test"):
        own = files.load_split(spark, found, split)
        row = own.agg(F.count("*").alias("footer")).crossJoin(own.where("doc_id % 100 <> 7").agg(F.count("*").alias("found"))).withColumn("split", F.lit(split))
        counts = row if counts is None else counts.unionByName(row)
    declared = spark.createDataFrame([("test", 5)], "split string, declared long")
    return files.declared_row_check(counts, declared)


def _src13(spark, sf_dir):
    """Files of every format by their number; the array files hold at most ARRAY documents of one source."""
    parquet, _ = _split_files(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id")).alias("value"), "source")
    lines, plain = new_folder(spark, "lines"), new_folder(spark, "plain")
    rows.repartition("source").write.partitionBy("source").text(lines)
    rows.select(F.concat(F.lit("-"), "value").alias("value"), "source").repartition("source").write.partitionBy("source").text(plain)
    out = None
    for path in (parquet, lines, plain, _written_arrays(spark, sf_dir)):
        found = files.sniff_format(spark, path).where("path rlike 'part-[^/]*$'")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("format").agg(F.count("*").alias("files"))


def _src14(spark, sf_dir):
    _, found = _split_files(spark, sf_dir)
    df, exhausted = files.preview(spark, found, "train")
    return df.agg(F.count("*").alias("rows"), exhausted.alias("exhausted"))


def _src15(spark, sf_dir):
    return files.sample_scan(_indexed(spark, sf_dir), 30).select("doc_id", "row_index")


def _src16(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    within, more = files.read_quota(indexed, 40)
    return within.agg(F.count("*").alias("rows")).crossJoin(indexed.agg(more.alias("over_quota")))


def _snk1(spark, sf_dir):
    path = new_folder(spark, "lengths")
    lengths = text_lengths(spark, sf_dir)
    L.write_lengths(lengths.limit(3), path, "pre_a")
    L.write_lengths(lengths.where("split = 'test'"), path, "pre_b")
    L.write_lengths(lengths, path, "pre_a")
    return spark.read.parquet(path).groupBy("preprocess_key", "processing_status").agg(F.count("*").alias("n"))


def _snk2(spark, sf_dir):
    path = new_folder(spark, "lengths")
    L.write_lengths(text_lengths(spark, sf_dir), path, "pre_a")
    return L.read_lengths(spark, path).select("row_id", "sequence_tokens")


def _snk3(spark, sf_dir):
    """Every conversation row with its whole text and a planted note, exported after redaction."""
    path = new_folder(spark, "export")
    note = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit("see"), F.concat(F.lit("/home/u/"), "role", F.lit(".txt")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", redact.redact_text(note).alias("note"))
    rows.select(F.to_json(F.struct("conv_id", "turn", "note")).alias("value")).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "conv_id long, turn long, note string").alias("x"))
    return back.select("x.conv_id", "x.turn", F.md5("x.note").alias("note_md5"))


def _udf2(spark, sf_dir):
    """Lengths of every text by a tokenizer file, loaded once per worker."""
    from lengthlab.functions.tokenizer import file_token_length

    rows = view(spark, sf_dir, "v_text").where("text is not null")
    return rows.select("row_index", file_token_length()(F.col("text")).alias("n"))


def _ds1(spark, sf_dir):
    """The registered data source over Arrow files in the shared folder, where executors can open paths."""
    return arrow.scan_arrow_files(spark, _written_arrow(spark, sf_dir)[1], "doc_id long, lang string")


ENTRIES = {
    "src1_scan_json_lines": (_src1, sql(_LINES)),
    "src2_scan_json_array": (_src2, sql(_ELEMENTS)),
    "src3_scan_json_field": (_src3, sql(_ELEMENTS)),
    "src4_scan_csv": (
        _src4,
        sql("""
SELECT CASE WHEN doc_id % 10 <> 1 THEN doc_id END AS doc_id, CASE doc_id % 10 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'a "b", c' || chr(10) || 'd' ELSE lang END AS lang,
  CASE WHEN doc_id % 10 = 1 THEN 'schema_mismatch' END AS error_code FROM {documents}"""),
    ),
    "src5_scan_parquet": (_src5, sql("SELECT doc_id, n_chars FROM {documents} WHERE source >= 'src3'")),
    "src6_scan_arrow_ipc": (_src6, sql("SELECT doc_id, lang FROM {documents}")),
    "src7_scan_compressed_text": (
        _src7,
        sql("""
SELECT value, error_code, 2 * count(*) AS n, 2 * count(*) AS places FROM (
  SELECT CASE doc_id % 50 WHEN 1 THEN '{bad' WHEN 2 THEN '[1]' WHEN 3 THEN '{"lang":"x",' || substr(line, 2) WHEN 5 THEN NULL WHEN 6 THEN '{"doc_id":6e999}' ELSE line END AS value,
    CASE WHEN doc_id % 50 = 5 THEN 'invalid_utf8' END AS error_code
  FROM (SELECT doc_id, '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || ' 9e1234"}' AS line FROM {documents}) l) v
GROUP BY value, error_code"""),
    ),
    "src8_load_split": (_src8, sql("SELECT doc_id FROM {documents} WHERE source < 'src3'")),
    "src9_with_row_index": (_src9, sql(f"SELECT doc_id, row_index, 'train:' || CAST(row_index AS VARCHAR) AS row_id FROM ({_INDEXED}) t")),
    "src10_build_manifest": (
        _src10,
        sql("""
SELECT path, size, sha256, identity, files FROM (WITH m AS (SELECT source AS path, strlen(content)::BIGINT AS size, sha256(content) AS sha256
  FROM (SELECT source, string_agg(CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY doc_id) AS content FROM {documents} GROUP BY source) c),
e AS (SELECT path || chr(9) || CAST(size AS VARCHAR) || chr(9) || sha256 AS line FROM m),
leaf AS (SELECT sha256(line)[1:4] AS k, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM e GROUP BY 1),
branch AS (SELECT k[1:2] AS k, sha256(string_agg(k || chr(9) || digest, chr(10) ORDER BY k)) AS digest FROM leaf GROUP BY 1)
SELECT m.*, (SELECT sha256(string_agg(k || chr(9) || digest, chr(10) ORDER BY k)) FROM branch) AS identity, (SELECT count(*) FROM m) AS files FROM m) t"""),
    ),
    "src11_verify_manifest": (
        _src11,
        sql("""
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'not_in_manifest' WHEN b.path IS NULL THEN 'missing' WHEN a.size <> b.size THEN 'size_mismatch' ELSE 'sha256_mismatch' END AS problem
FROM {v_manifest_old} a FULL JOIN {v_manifest_new} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.sha256 <> b.sha256"""),
    ),
    "src12_declared_row_check": (
        _src12,
        sql("""
SELECT split, CASE WHEN split = 'test' THEN 5 ELSE n END::BIGINT AS expected, found, CASE WHEN split = 'test' THEN 5 ELSE n END = found AS complete
FROM (SELECT CASE WHEN source < 'src3' THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (doc_id % 100 <> 7) AS found FROM {documents} GROUP BY 1) t"""),
    ),
    "src13_sniff_format": (
        _src13,
        sql(f"""
SELECT format, n AS files FROM (SELECT count(DISTINCT source) AS n FROM {{documents}}) t, (VALUES ('parquet'), ('json_lines'), ('text')) f(format)
UNION ALL SELECT 'json_array', count(DISTINCT source || '/' || CAST(doc_id // {ARRAY} AS VARCHAR)) FROM {{documents}}"""),
    ),
    "src14_preview": (_src14, sql("SELECT least(100, count(*)) AS rows, false AS exhausted FROM (SELECT doc_id FROM {documents} WHERE source IN (SELECT DISTINCT source FROM {documents} WHERE source >= 'src3' ORDER BY source LIMIT 4)) t")),
    "src15_sample_scan": (_src15, sql(f"SELECT doc_id, row_index FROM ({_INDEXED}) t WHERE row_index < 30")),
    "src16_read_quota": (_src16, sql(f"SELECT least(40, count(*)) AS rows, count(*) > 40 AS over_quota FROM ({_INDEXED}) t")),
    "snk1_write_lengths": (
        _snk1,
        sql("""
SELECT 'pre_a' AS preprocess_key, processing_status, count(*) AS n FROM {sft} GROUP BY processing_status
UNION ALL SELECT 'pre_b', processing_status, count(*) FROM {sft} WHERE split = 'test' GROUP BY processing_status"""),
    ),
    "snk2_read_lengths": (_snk2, sql("SELECT row_id, sequence_tokens::BIGINT AS sequence_tokens FROM {sft} WHERE processing_status = 'ok'")),
    "snk3_export_results": (_snk3, sql("SELECT conv_id, turn, md5(concat_ws(' ', coalesce(text, ''), 'see <redacted-path>')) AS note_md5 FROM {conversations}")),
    "udf2_tokenizer_plugin": (_udf2, None),  # no SQL tokenizes by a file; tests compare with the library
    "ds1_file_source": (_ds1, sql("SELECT doc_id, lang FROM {documents}")),
    "win5_file_offsets": (
        lambda s, d: files.file_offsets(
            table(s, d, "documents").groupBy(F.col("source").alias("_path")).agg(F.count("*").alias("n")).withColumn("file_ord", F.regexp_extract("_path", "[0-9]+", 0).cast("int"))
        ),
        sql("SELECT source AS _path, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INT) AS o, count(*) AS n FROM {documents} GROUP BY source) t"),
    ),
}
