"""Queries of the tensor catalog and of job, event, upload and cache tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lengthlab.functions.units import with_bytes
from lengthlab.operators import jobs as J
from lengthlab.operators import tensors as X
from lengthlab.scratch import new_folder
from lengthlab.sources import versions
from lengthlab.views import duck, table, view

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
CATALOG = {
    "typed": """
SELECT *, dim0 * dim1 AS numel, CASE WHEN raw_dtype = 'F32' THEN 4 ELSE 2 END * dim0 * dim1 AS nbytes, CASE WHEN dim1 = 1 THEN 1 ELSE 2 END AS ndim,
  CASE WHEN name LIKE 'mtp.%' THEN 'mtp' WHEN name LIKE '%.visual.%' THEN 'vision' ELSE 'text' END AS component,
  regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS module FROM {v_tensors}""",
    "roled": """
SELECT *, CASE WHEN name LIKE '%layernorm%' THEN 'norm' WHEN ndim = 2 THEN 'linear_weight' ELSE 'other' END AS role FROM {typed}""",
    "distinct_tensors": "SELECT model, shard, name, min(raw_dtype) AS raw_dtype, min(dim0) AS dim0, min(dim1) AS dim1 FROM {v_tensors} GROUP BY model, shard, name",
    "laid": """
SELECT *, sum(size) OVER (PARTITION BY model, shard ORDER BY name)::BIGINT AS stop, sum(size) OVER (PARTITION BY model, shard ORDER BY name)::BIGINT - size + CASE WHEN dim0 % 640 = 0 THEN 2 ELSE 0 END AS start
FROM (SELECT *, (CASE WHEN raw_dtype = 'F32' THEN 4 ELSE 2 END * dim0 * dim1)::BIGINT AS size FROM {distinct_tensors}) t""",
    "jobs": """
SELECT *, updated_at + INTERVAL 1 DAY AS lease_expires_at, CASE WHEN analysis_id % 6 = 0 THEN updated_at END AS cancel_requested_at FROM {v_analyses}""",
    "configs": """
SELECT o_orderkey AS config_id, 'dataset' AS field, o_orderpriority AS value FROM {orders} UNION ALL SELECT o_orderkey, 'hardware', o_orderstatus FROM {orders}""",
    "configs2": """
SELECT o_orderkey AS config_id, 'dataset' AS field, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS value FROM {orders}
UNION ALL SELECT o_orderkey, 'hardware', CASE WHEN o_orderkey % 5 = 0 THEN 'y' ELSE o_orderstatus END FROM {orders} WHERE o_orderkey % 7 <> 0""",
}


def sql(query: str) -> str:
    return duck(query, CATALOG)


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def _tensors(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tensors").withColumn("numel", F.col("dim0") * F.col("dim1"))
    return with_bytes(rows).withColumn("ndim", F.when(F.col("dim1") == 1, 1).otherwise(2))


def _roles(spark, sf_dir):
    """Two-dimensional embeddings under numbered names count as linear weights; the module's last part decides."""
    return X.classify(_tensors(spark, sf_dir))


def _distinct(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tensors").groupBy("model", "shard", "name")
    return rows.agg(F.min("raw_dtype").alias("raw_dtype"), F.min("dim0").alias("dim0"), F.min("dim1").alias("dim1"))


def _laid(spark, sf_dir):
    from pyspark.sql import Window

    rows = _distinct(spark, sf_dir).withColumn("size", (F.when(F.col("raw_dtype") == "F32", 4).otherwise(2) * F.col("dim0") * F.col("dim1")).cast("long"))
    stop = F.sum("size").over(Window.partitionBy("model", "shard").orderBy("name"))
    return rows.withColumns({"stop": stop, "start": stop - F.col("size") + F.when(F.col("dim0") % 640 == 0, 2).otherwise(0)})


def _headers(spark, sf_dir):
    """Header JSON per (model, shard), built from the tensor rows."""
    entry = F.struct("name", F.struct(F.col("raw_dtype").alias("dtype"), F.array("dim0", "dim1").alias("shape"), F.array("start", "stop").alias("data_offsets")).alias("t"))
    rows = _laid(spark, sf_dir).groupBy("model", "shard").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    body = F.to_json("m")
    return rows.select("model", "shard", F.concat(F.lit('{"__metadata__": {"format": "pt"},'), F.substring(body, 2, 10**9)).alias("header"))


def _ten1(spark, sf_dir):
    rows = X.explode_headers(_headers(spark, sf_dir))
    return rows.select("model", "shard", "name", "raw_dtype", X.numel("shape").alias("numel"), F.get("offsets", F.lit(1)).alias("stop"))


def _ten2(spark, sf_dir):
    rows = X.explode_headers(_headers(spark, sf_dir))
    rows = rows.withColumn("raw_dtype", F.when(F.contains("name", F.lit("mtp")), "Q9").otherwise(F.col("raw_dtype")))
    return X.header_checks(rows).select("model", "shard", "name", "problem")


def _win4(spark, sf_dir):
    return X.contiguous_offsets(_laid(spark, sf_dir), ["model", "shard"], "start", "stop").select("model", "shard", "name", "gap")


def _ten6(spark, sf_dir):
    rows = _tensors(spark, sf_dir)
    renamed = F.when(F.col("name").contains("embed_tokens") & (F.col("shard") == "shard-0"), "model.embed_tokens.weight").otherwise(F.col("name"))
    rows = rows.withColumn("name", renamed).dropDuplicates(["model", "name"])
    return X.tied_groups(X.classify(rows).withColumn("shape_key", F.col("dim0").cast("string")))


def _ten7(spark, sf_dir):
    rows = _tensors(spark, sf_dir)
    k = F.regexp_extract("model", "([0-9]+)$", 1).cast("int") % 10
    rows = rows.withColumns(
        {
            "name": F.when((k == 1) & F.col("name").contains("q_proj"), "model.layers.1.self_attn.q_proj.qweight").otherwise(F.col("name")),
            "dtype": F.when((k == 2) & F.col("name").contains("norm"), "float8_e8m0fnu").when((k == 2) & F.col("name").contains("q_proj"), "float4_e2m1")
            .when((k == 3) & F.col("name").contains("down_proj"), "float8_e4m3fn").when((k == 4) & F.col("name").contains("down_proj"), "int8").otherwise(F.col("dtype")),
        }
    )
    return X.quantized_evidence(X.classify(rows))


_TEN7 = """
SELECT model, CASE k WHEN 1 THEN CASE WHEN q THEN 'gptq/awq' END WHEN 2 THEN CASE WHEN n AND q THEN 'mxfp4' WHEN n THEN 'mx' WHEN q THEN 'fp4' END
    WHEN 3 THEN CASE WHEN d THEN 'fp8' END WHEN 4 THEN CASE WHEN d THEN 'integer-packed' END END AS format,
  CASE k WHEN 1 THEN CASE WHEN q THEN 'prequantized_checkpoint' END WHEN 2 THEN CASE WHEN n OR q THEN 'quantized_dtype' END
    WHEN 3 THEN CASE WHEN d THEN 'quantized_dtype' END WHEN 4 THEN CASE WHEN d THEN 'quantized_dtype' END END AS reason
FROM (SELECT model, CAST(regexp_extract(model, '([0-9]+)$', 1) AS INT) % 10 AS k, bool_or(name LIKE '%q_proj%') AS q, bool_or(name LIKE '%norm%') AS n, bool_or(name LIKE '%down_proj%') AS d FROM {v_tensors} GROUP BY model) t"""


def _ten8(spark, sf_dir):
    rows = _roles(spark, sf_dir)
    biases = rows.where(F.col("name").contains("q_proj")).withColumns({"name": F.concat("module", F.lit(".bias")), "role": F.lit("linear_bias")})
    return X.linear_modules(rows.unionByName(biases)).groupBy("model", "kind", "layer_type", "has_bias").agg(
        F.count("*").alias("modules"), F.sum("out_features").alias("out_features"), F.sum("in_features").alias("in_features")
    )


def _ten9(spark, sf_dir):
    return X.weight_bytes(_roles(spark, sf_dir), ["lm_head", r"model\.layers\.[02468]\.self_attn", "down_proj"])


_TEN9 = r"""
SELECT model, coalesce(sum(p) FILTER (q), 0)::BIGINT AS payload, coalesce(sum(x) FILTER (q), 0)::BIGINT AS metadata, coalesce(sum(d) FILTER (NOT q), 0)::BIGINT AS dense,
  max(CASE WHEN q THEN p + x ELSE d END)::BIGINT AS largest
FROM (SELECT model, role = 'linear_weight' AND component = 'text' AND name NOT LIKE '%down_proj%' AND NOT (regexp_matches(name, '^model\.layers\.[02468]\.self_attn')) AS q, (numel + 1) // 2 AS p, 2 * numel AS d,
    (numel + 63) // 64 + 4 * (((numel + 63) // 64 + 255) // 256) + 4 + 64 + 1024 AS x FROM {roled}) t GROUP BY model"""


def _ten10(spark, sf_dir):
    modules = X.linear_modules(_roles(spark, sf_dir)).where("layer_type is null or layer_type = 'mlp'")
    return X.adapter_params(modules, 16, [(r"layers\.[0-3]\..*down_proj", 2), (r"mlp\.(down|up)_proj", 4), ("down_proj", 99), ("[a-z]_proj", 8)])


_TEN10 = """
SELECT model, matrix, d0::BIGINT AS d0, d1::BIGINT AS d1, sum(d0 * d1)::BIGINT AS params, count(*) AS matrices
FROM (SELECT model, 'A' AS matrix, r AS d0, dim1 AS d1 FROM m UNION ALL SELECT model, 'B', dim0, r FROM m) t GROUP BY model, matrix, d0, d1"""


def _win6(spark, sf_dir):
    rows = view(spark, sf_dir, "v_allocations").where("bytes_high is null")
    return X.first_occurrence(rows, ["category", "live_at"], ["scenario_id", "name"]).select("category", "live_at", "scenario_id", "name")


def _jobs(spark, sf_dir):
    return view(spark, sf_dir, "v_analyses").withColumns(
        {"lease_expires_at": F.col("updated_at") + F.expr("interval 1 day"), "cancel_requested_at": F.when(F.col("analysis_id") % 6 == 0, F.col("updated_at"))}
    )


def _job7(spark, sf_dir):
    cache = view(spark, sf_dir, "v_analyses").select("analysis_id", F.concat(F.lit("a/"), F.col("analysis_id").cast("string")).alias("artifact_path"), F.col("updated_at").alias("last_used_at"))
    files = cache.where("analysis_id % 4 <> 0").select(F.col("artifact_path").alias("path"))
    return J.cache_to_evict(cache, files, _now() - F.expr("interval 5 days")).select("analysis_id")


def _job8(spark, sf_dir):
    folders = view(spark, sf_dir, "v_uploads").groupBy("analysis_id").agg(F.min("expires_at").alias("modified_at"))
    owners = view(spark, sf_dir, "v_analyses").where("analysis_id % 3 = 0").select("analysis_id")
    return J.orphans(folders, owners, F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")).select("analysis_id")


def _job9(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 10).alias("owner_id"), (F.col("o_orderkey") % 977).alias("request_key"), F.col("o_orderstatus").alias("fingerprint")
    )
    return J.idempotent_requests(rows)


def _job10(spark, sf_dir):
    rows = view(spark, sf_dir, "v_events").select(
        F.col("event_id").alias("entry_id"), "owner_id", (F.col("analysis_id") % 40).alias("key"), F.col("event_id").alias("used_at"),
        (F.col("status") == "COMPLETED").alias("complete"), F.col("status").alias("summary"),
    )
    table = new_folder(spark, "cache")
    for part in ("entry_id % 2 = 0", "entry_id % 2 = 1"):
        versions.upsert(table, rows.where(part), ["owner_id", "key"], J.cache_upsert)
    return versions.read_table(spark, table)


def _job11(spark, sf_dir):
    analyses = view(spark, sf_dir, "v_analyses")
    return J.cascade(analyses, view(spark, sf_dir, "v_events"), view(spark, sf_dir, "v_uploads"), analyses.where("analysis_id % 25 = 3"))


def _job12(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = lambda df, field, value: df.select(k.alias("config_id"), F.lit(field).alias("field"), value.alias("value"))
    old = row(o, "dataset", F.col("o_orderpriority")).unionByName(row(o, "hardware", F.col("o_orderstatus")))
    new = row(o, "dataset", F.when(k % 4 == 0, "x").otherwise(F.col("o_orderpriority")))
    new = new.unionByName(row(o.where(k % 7 != 0), "hardware", F.when(k % 5 == 0, "y").otherwise(F.col("o_orderstatus"))))
    return J.reanalysis_reasons(old, new)


def _agg20(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.where("source <> 'src1'").select("source", F.when(~((F.col("source") == "src2") & (F.col("doc_id") % 2 == 0)), F.col("n_chars")).alias("size"))
    return J.manifest_bytes(files, docs.select("source").distinct())


def _findings(spark, sf_dir):
    rows = view(spark, sf_dir, "v_events")
    one = rows.where("event_id % 2 = 0").select("analysis_id", "status")
    other = rows.where("event_id % 3 = 0").select("analysis_id", "status")
    return one.union(other).dropDuplicates(["analysis_id", "status"])


ENTRIES = {
    "ten1_explode_headers": (_ten1, sql("SELECT model, shard, name, raw_dtype, (dim0 * dim1)::BIGINT AS numel, stop FROM {laid}")),
    "ten2_header_checks": (_ten2, sql("SELECT model, shard, name, CASE WHEN name LIKE '%mtp%' THEN 'unknown_dtype' WHEN dim0 % 640 = 0 THEN 'size_mismatch' END AS problem FROM {laid}")),
    "win4_contiguous_offsets": (_win4, sql("SELECT model, shard, name, (start - lag(stop, 1, 0) OVER (PARTITION BY model, shard ORDER BY start, stop))::BIGINT AS gap FROM {laid}")),
    "ten3_duplicate_tensors": (lambda s, d: X.duplicates(view(s, d, "v_tensors")), sql("SELECT model, name, count(*) AS copies FROM {v_tensors} GROUP BY model, name HAVING count(*) > 1")),
    "ten4_classify_tensors": (lambda s, d: _roles(s, d).groupBy("model", "component", "role").agg(F.count("*").alias("n")), sql("SELECT model, component, role, count(*) AS n FROM {roled} GROUP BY model, component, role")),
    "ten5_inventory_rollup": (
        lambda s, d: X.rollup(_roles(s, d), ["component", "dtype"], F.col("name").contains("embed_tokens") & (F.col("shard") == "shard-1")),
        sql("""
SELECT component, CASE WHEN raw_dtype = 'F32' THEN 'float32' ELSE 'bfloat16' END AS dtype, coalesce(sum(numel) FILTER (NOT (name LIKE '%embed_tokens%' AND shard = 'shard-1')), 0)::BIGINT AS params,
  sum(nbytes)::BIGINT AS nbytes, count(*) AS tensors FROM {typed} GROUP BY 1, 2"""),
    ),
    "ten6_tied_groups": (
        _ten6,
        sql("""
SELECT model, 'model.embed_tokens.weight' AS embedding, 'lm_head.weight' AS head FROM {v_tensors}
WHERE name LIKE '%embed_tokens%' AND shard = 'shard-0' GROUP BY model"""),
    ),
    "ten7_quantized_evidence": (_ten7, sql(_TEN7)),
    "ten8_linear_modules": (
        _ten8,
        sql("""
SELECT model, kind, CASE WHEN component <> 'text' THEN component WHEN name LIKE '%.mlp.%' THEN 'mlp' END AS layer_type, name LIKE '%q_proj%' AS has_bias, count(*) AS modules,
  sum(dim0)::BIGINT AS out_features, sum(dim1)::BIGINT AS in_features
FROM (SELECT *, split_part(module, '.', -1) AS kind FROM {roled} WHERE role = 'linear_weight') t GROUP BY 1, 2, 3, 4"""),
    ),
    "ten9_weight_bytes": (_ten9, sql(_TEN9)),
    "ten10_adapter_params": (
        _ten10,
        duck(_TEN10.replace(" FROM m", " FROM {ranked}"), CATALOG | {"ranked": r"SELECT *, CASE WHEN name LIKE '%mlp.down_proj%' THEN CASE WHEN regexp_matches(name, 'layers\.[0-3]\.') THEN 2 ELSE 4 END WHEN name LIKE '%.q_proj%' THEN 8 ELSE 16 END AS r FROM {roled} WHERE role = 'linear_weight' AND component = 'text'"}),
    ),
    "win6_first_occurrence": (
        _win6,
        sql("SELECT category, live_at, scenario_id, name FROM (SELECT *, row_number() OVER (PARTITION BY category, live_at ORDER BY scenario_id, name) AS k FROM {v_allocations} WHERE bytes_high IS NULL) t WHERE k = 1"),
    ),
    "job1_events_after": (lambda s, d: J.events_after(view(s, d, "v_events"), 100).select("event_id", "analysis_id", "status"), sql("SELECT event_id, analysis_id, status FROM {v_events} WHERE event_id > 100 ORDER BY event_id LIMIT 200")),
    "job2_last_event_id": (lambda s, d: J.last_event(view(s, d, "v_events")), sql("SELECT analysis_id, max(event_id) AS last_event_id FROM {v_events} GROUP BY analysis_id")),
    "job3_latest_status": (lambda s, d: J.latest_status(view(s, d, "v_events")), sql("SELECT analysis_id, arg_max(status, event_id) AS status FROM {v_events} GROUP BY analysis_id")),
    "job4_stalled_jobs": (
        lambda s, d: J.stalled(_jobs(s, d), _now()).select("analysis_id", "reason"),
        sql(f"""
SELECT analysis_id, reason FROM (SELECT analysis_id, CASE WHEN status IN ('QUEUED','TOKENIZING','ESTIMATING') AND lease_owner IS NOT NULL AND lease_expires_at < {NOW} THEN 'lease_expired'
  WHEN status = 'QUEUED' AND lease_owner IS NULL AND updated_at < {NOW} - INTERVAL 2 DAY THEN 'queued_too_long'
  WHEN status IN ('QUEUED','TOKENIZING','ESTIMATING') AND cancel_requested_at < {NOW} - INTERVAL 1 DAY THEN 'cancel_not_followed' END AS reason FROM {{jobs}}) t WHERE reason IS NOT NULL"""),
    ),
    "job5_retention_expired": (
        lambda s, d: J.expired_jobs(view(s, d, "v_analyses"), _now() - F.expr("interval 3 days")).select("analysis_id"),
        sql(f"SELECT analysis_id FROM {{v_analyses}} WHERE status IN ('COMPLETED','FAILED') AND coalesce(finished_at, created_at) < {NOW} - INTERVAL 3 DAY"),
    ),
    "job6_uploads_to_delete": (
        lambda s, d: J.uploads_to_delete(view(s, d, "v_uploads"), view(s, d, "v_analyses"), _now()).select("upload_id"),
        sql(f"SELECT upload_id FROM {{v_uploads}} WHERE expires_at < {NOW} AND analysis_id NOT IN (SELECT analysis_id FROM {{v_analyses}} WHERE status IN ('QUEUED','TOKENIZING','ESTIMATING'))"),
    ),
    "job7_cache_to_evict": (_job7, sql(f"SELECT analysis_id FROM {{v_analyses}} WHERE updated_at < {NOW} - INTERVAL 5 DAY OR analysis_id % 4 = 0")),
    "job8_orphan_artifacts": (
        _job8,
        sql("SELECT analysis_id FROM {v_uploads} WHERE analysis_id NOT IN (SELECT analysis_id FROM {v_analyses} WHERE analysis_id % 3 = 0) GROUP BY analysis_id HAVING min(expires_at) < TIMESTAMP '2000-01-01 00:00:00'"),
    ),
    "job9_idempotent_requests": (
        _job9,
        sql("""
SELECT request_id, owner_id, CASE WHEN k = 1 THEN 'new' WHEN lo = hi THEN 'reuse' ELSE 'conflict' END AS outcome, answer
FROM (SELECT o_orderkey AS request_id, o_custkey % 10 AS owner_id, row_number() OVER w AS k, first_value(o_orderkey) OVER w AS answer,
    min(o_orderstatus) OVER p AS lo, max(o_orderstatus) OVER p AS hi FROM {orders}
  WINDOW w AS (PARTITION BY o_custkey % 10, o_orderkey % 977 ORDER BY o_orderkey), p AS (PARTITION BY o_custkey % 10, o_orderkey % 977)) t"""),
    ),
    "job10_cache_upsert": (
        _job10,
        sql("""
SELECT event_id AS entry_id, owner_id, key, event_id AS used_at, status = 'COMPLETED' AS complete, CASE WHEN status = 'COMPLETED' THEN status END AS summary
FROM (SELECT *, analysis_id % 40 AS key, row_number() OVER (PARTITION BY owner_id, analysis_id % 40 ORDER BY event_id DESC) AS k FROM {v_events}) t WHERE k = 1"""),
    ),
    "job11_cascade_delete_set": (
        _job11,
        sql("""
SELECT 'analysis' AS kind, analysis_id::BIGINT AS id FROM {v_analyses} WHERE analysis_id % 25 = 3
UNION ALL SELECT 'event', event_id FROM {v_events} WHERE analysis_id IN (SELECT analysis_id FROM {v_analyses} WHERE analysis_id % 25 = 3)
UNION ALL SELECT 'upload', upload_id FROM {v_uploads} u WHERE analysis_id IN (SELECT analysis_id FROM {v_analyses} WHERE analysis_id % 25 = 3)"""),
    ),
    "job12_reanalysis_reasons": (
        _job12,
        sql("""
SELECT coalesce(a.config_id, b.config_id) AS config_id, coalesce(a.field, b.field) AS field, CASE WHEN coalesce(a.field, b.field) = 'dataset' THEN 'lengths' ELSE 'estimate' END AS layer
FROM {configs} a FULL JOIN {configs2} b ON a.config_id = b.config_id AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value"""),
    ),
    "agg18_owner_active_count": (lambda s, d: J.owner_active_count(view(s, d, "v_analyses")), sql("SELECT owner_id, count(*) AS active FROM {v_analyses} WHERE status IN ('QUEUED','TOKENIZING','ESTIMATING') GROUP BY owner_id")),
    "agg19_owner_upload_bytes": (
        lambda s, d: J.owner_upload_bytes(view(s, d, "v_uploads"), view(s, d, "v_uploads"), F.expr("TIMESTAMP_NTZ '1998-07-30 00:00:00'")),
        sql("SELECT owner_id, coalesce(sum(size_bytes) FILTER (expires_at >= TIMESTAMP '1998-07-30 00:00:00'), 0)::BIGINT AS bytes FROM {v_uploads} GROUP BY owner_id"),
    ),
    "agg20_manifest_bytes": (
        _agg20,
        sql("""
SELECT source, CASE WHEN source = 'src1' THEN NULL WHEN source = 'src2' THEN coalesce(sum(n_chars) FILTER (doc_id % 2 = 1), 0) ELSE sum(n_chars) END::BIGINT AS bytes_low,
  CASE WHEN source = 'src1' THEN NULL WHEN source = 'src2' AND bool_or(doc_id % 2 = 0) THEN NULL ELSE sum(n_chars) END::BIGINT AS bytes_high FROM {documents} GROUP BY source"""),
    ),
    "set3_distinct_union": (_findings, sql("SELECT analysis_id, status FROM {v_events} WHERE event_id % 2 = 0 UNION SELECT analysis_id, status FROM {v_events} WHERE event_id % 3 = 0")),
}
