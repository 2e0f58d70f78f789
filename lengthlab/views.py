"""Views over the given tables, in SQL that Spark and DuckDB both run; the queries and their oracles share them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "v_text": """
SELECT doc_id AS row_index, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, source AS shard_id, lang,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE text END AS text FROM {documents}""",
    "v_messages": "SELECT conv_id, turn, role, text AS content FROM {conversations}",
    "v_preference": """
SELECT CAST(conv_id AS BIGINT) * 100000 + turn AS row_index, conv_id,
  CASE WHEN sys IS NULL THEN '' ELSE sys END AS system, prompt, chosen, rejected
FROM (SELECT conv_id, turn, role, text AS chosen,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
    max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys,
    coalesce(lead(text) OVER (PARTITION BY conv_id, role ORDER BY turn), lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn)) AS rejected
  FROM {conversations}) c
WHERE role = 'assistant' AND prev_role = 'user'""",
    "v_events": """
SELECT event_id, user_id AS analysis_id, user_id % 10 AS owner_id,
  CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'TOKENIZING' WHEN 'click' THEN 'ESTIMATING'
    WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts FROM {events}""",
    "v_analyses": """
SELECT analysis_id, owner_id, created_at, updated_at, status,
  CASE WHEN status IN ('COMPLETED','FAILED') AND analysis_id % 7 <> 0 THEN updated_at END AS finished_at,
  CASE WHEN status IN ('TOKENIZING','ESTIMATING') THEN 'w1' END AS lease_owner
FROM (SELECT analysis_id, owner_id, status, ts AS updated_at,
    min(ts) OVER (PARTITION BY analysis_id) AS created_at,
    row_number() OVER (PARTITION BY analysis_id ORDER BY event_id DESC) AS rn FROM {v_events}) e
WHERE rn = 1""",
    "v_uploads": """
SELECT o_orderkey AS upload_id, o_custkey % 10 AS owner_id, o_orderkey % 150 AS analysis_id,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS expires_at FROM {orders}""",
    "v_tensors": """
SELECT p_brand AS model, 'shard-' || CAST(p_partkey % 4 AS VARCHAR(10)) AS shard,
  CASE p_partkey % 6 WHEN 0 THEN 'model.embed_tokens.' || CAST(p_partkey AS VARCHAR(10)) || '.weight'
    WHEN 1 THEN 'model.layers.' || CAST(p_size AS VARCHAR(10)) || '.self_attn.q_proj.weight'
    WHEN 2 THEN 'model.layers.' || CAST(p_size AS VARCHAR(10)) || '.mlp.down_proj.weight'
    WHEN 3 THEN 'model.layers.' || CAST(p_size AS VARCHAR(10)) || '.input_layernorm.weight'
    WHEN 4 THEN 'model.visual.blocks.' || CAST(p_size AS VARCHAR(10)) || '.attn.qkv.weight'
    ELSE 'mtp.layers.0.self_attn.k_proj.weight' END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'F32' ELSE 'BF16' END AS raw_dtype,
  CAST(p_size AS BIGINT) * 64 AS dim0, CASE WHEN p_partkey % 6 = 3 THEN CAST(1 AS BIGINT) ELSE CAST(64 AS BIGINT) END AS dim1
FROM {part}""",
    "v_timepoints": """
SELECT * FROM (VALUES (0,'LOAD','LOAD:peak'),(1,'FB','FB:forward'),(2,'FB','FB:backward'),(3,'OPT','OPT:step')) AS t(ord, phase, tp)""",
    "v_allocations": """
SELECT l_orderkey AS scenario_id,
  CAST(l_linenumber AS VARCHAR(10)) || '-' || CAST(l_partkey AS VARCHAR(10)) || '-' || CAST(l_suppkey AS VARCHAR(10)) AS name,
  CASE l_returnflag WHEN 'A' THEN 'weights_base' WHEN 'N' THEN 'saved_activations' ELSE 'optimizer_states' END AS category,
  CASE l_linenumber % 4 WHEN 0 THEN 'LOAD:*' WHEN 1 THEN 'FB:*' WHEN 2 THEN 'FB:backward' ELSE 'OPT:step' END AS live_at,
  CASE WHEN l_suppkey % 3 = 0 THEN 'alias' END AS alias_group,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS bytes_low,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) + CAST(l_linenumber AS BIGINT) END AS bytes_high
FROM {lineitem}""",
    "v_manifest_old": """
SELECT source || '/' || CAST(doc_id AS VARCHAR(20)) AS path, octet_len AS size, h AS sha256
FROM (SELECT doc_id, source, n_chars AS octet_len, md5(text) AS h FROM {documents}) d WHERE doc_id % 50 <> 1""",
    "v_manifest_new": """
SELECT source || '/' || CAST(doc_id AS VARCHAR(20)) AS path,
  CASE WHEN doc_id % 50 = 2 THEN octet_len + 1 ELSE octet_len END AS size,
  CASE WHEN doc_id % 50 = 3 THEN md5(h) ELSE h END AS sha256
FROM (SELECT doc_id, source, n_chars AS octet_len, md5(text) AS h FROM {documents}) d WHERE doc_id % 50 <> 4""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{need: view(spark, sf_dir, need) for need in _needs(sql)})


def duck(sql: str, more: dict[str, str] | None = None) -> str:
    """DuckDB SQL in which {name} stands for a table, a view or one of `more`; views become common tables."""
    defined = VIEWS | (more or {})
    order: list[str] = []

    def visit(text: str) -> None:
        for need in _needs(text):
            if need in defined and need not in order:
                visit(defined[need])
                order.append(need)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    if not order:
        return plain(sql)
    return "WITH " + ",\n".join(f"{n} AS ({plain(defined[n])})" for n in order) + "\n" + plain(sql)
