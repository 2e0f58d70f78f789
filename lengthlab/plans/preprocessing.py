"""Queries of the projection, mapping and function operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lengthlab.functions import chat, keys, names, redact, text, units
from lengthlab.operators import lengths as L
from lengthlab.operators import mapping as M
from lengthlab.plans.statistics import DERIVED, _n, preference_lengths, text_lengths
from lengthlab.views import duck, table, view

CHAT = {
    "chat": """
SELECT conv_id, list({'role': role, 'content': content} ORDER BY turn, role, content) AS messages, count(*) AS n FROM {v_messages} GROUP BY conv_id""",
    "pairs": """
SELECT conv_id, messages AS a, CASE conv_id % 3 WHEN 0 THEN messages[1:n - 1]
  WHEN 1 THEN list_append(messages[1:n - 1], {'role': messages[n].role, 'content': 'changed'}) ELSE messages END AS b FROM {chat}""",
}


def sql(query: str) -> str:
    return duck(query, DERIVED | CHAT)


def chats(spark, sf_dir):
    turns = view(spark, sf_dir, "v_messages").groupBy("conv_id")
    listed = turns.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    return listed.select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.content as content))").alias("messages"))


def _joined(messages: str):
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|"))


_JOINED = "md5(array_to_string(list_transform({0}, lambda m: m.role || '=' || m.content), '|'))"


def _fn1(spark, sf_dir):
    foreign = chats(spark, sf_dir).select(
        "conv_id", F.expr("transform(messages, m -> named_struct('from', m.role, 'value', if(m.content = '', null, m.content)))").alias("m")
    )
    fixed = foreign.select("conv_id", chat.normalize_messages("m").alias("messages"))
    return fixed.select("conv_id", F.size("messages").alias("n"), _joined("messages").alias("digest")).where("n >= 0")


def _fn2(spark, sf_dir):
    blocks = view(spark, sf_dir, "v_messages").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), F.col("content").alias("text")))).alias("blocks")
    )
    parts = blocks.select("conv_id", chat.text_parts("blocks").alias("parts"))
    return parts.select("conv_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest"))


def _fn3(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference")
    turns = F.array(
        F.struct(F.lit("system").alias("role"), F.when(F.col("row_index") % 4 == 0, "  ").otherwise(F.col("system")).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    kept = chat.omit_blank_system(turns)
    return rows.select("row_index", F.size(kept).alias("kept"), (F.size(turns) - F.size(kept)).alias("dropped"))


def _fn4(spark, sf_dir):
    return chats(spark, sf_dir).select(
        "conv_id",
        F.md5(chat.render_chat("messages")).alias("rendered"),
        F.md5(chat.render_chat("messages", True)).alias("prompted"),
    )


_RENDER = "array_to_string(list_transform({0}, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')"


def _fn5(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    return rows.select("row_index", *[text.token_length("text", by).alias(by) for by in ("tokens", "bytes", "chars")])


def _fn6(spark, sf_dir):
    plain = view(spark, sf_dir, "v_preference").withColumns({"split": F.lit("train"), "shard_id": F.lit("c")})
    out = L.sft_prompt_completion(plain, "prompt", "chosen")
    talk = chats(spark, sf_dir).withColumns({"row_index": F.col("conv_id"), "split": F.lit("chat"), "shard_id": F.lit("c")})
    out = out.unionByName(L.sft_messages(talk))
    out = out.unionByName(L.sft_messages(talk.withColumn("split", F.lit("spoken")), assistant_only=True))
    return out.select("row_id", "prompt_tokens", "completion_tokens", "sequence_tokens", "loss_token_count", "processing_status")


def _fn7(spark, sf_dir):
    return preference_lengths(spark, sf_dir).select(
        "row_id", "prompt_tokens", "chosen_total_tokens", "rejected_total_tokens", "chosen_completion_tokens", "rejected_completion_tokens", "error_code"
    )


def _fn8(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference").withColumns({"split": F.lit("train"), "shard_id": F.lit("c")})
    return L.grpo(rows, 64).select("row_id", "prompt_tokens", "context_status")


def _pairs(spark, sf_dir):
    rows = chats(spark, sf_dir)
    first = F.expr("slice(messages, 1, size(messages) - 1)")
    last = F.array(F.struct(F.element_at("messages", -1)["role"].alias("role"), F.lit("changed").alias("content")))
    other = F.when(F.col("conv_id") % 3 == 0, first).when(F.col("conv_id") % 3 == 1, F.concat(first, last)).otherwise(F.col("messages"))
    return rows.select("conv_id", F.col("messages").alias("a"), other.alias("b"))


def _fn9(spark, sf_dir):
    parts = _pairs(spark, sf_dir).select("conv_id", chat.extract_prompt("a", "b").alias("x"))
    return parts.select("conv_id", *[F.when(F.col("x").isNotNull(), F.size(f"x.{c}")).alias(c) for c in ("prompt", "chosen", "rejected")])


def _fn10(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, "</s>").otherwise("")).alias("t"))
    return rows.select("conv_id", "turn", F.length(chat.add_eos("t", "</s>")).alias("with_eos"), F.length(chat.strip_eos("t", "</s>")).alias("without_eos"))


def _fn11(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text").where("text is not null")
    n = text.token_length("text")
    mask = F.transform(F.sequence(F.lit(0), F.length("lang") + 5), lambda i: F.when(i % 3 == 0, 0).otherwise(1))
    return rows.select("row_index", chat.loss_positions(None, n).alias("unmasked"), chat.loss_positions([mask], F.length("lang") + 6).alias("masked"))


def _fn12(spark, sf_dir):
    rows = view(spark, sf_dir, "v_text")
    digest = keys.content_digest({"text": F.col("text"), "lang": F.col("lang")})
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("row_index").alias("row_index")).select("row_index", "n")


def _fn13(spark, sf_dir):
    """The digests of the records: of every text, of rendered conversations and of both branches of a preference."""
    rows = view(spark, sf_dir, "v_text")
    out = L.sft_text(rows).where("processing_status = 'ok'").select("row_id", "token_digest")
    talk = chats(spark, sf_dir).withColumns({"row_index": F.col("conv_id"), "split": F.lit("chat"), "shard_id": F.lit("c")})
    return out.unionByName(L.sft_messages(talk).select("row_id", "token_digest"))


def _fn14(spark, sf_dir):
    rows = chats(spark, sf_dir)
    pieces = F.transform("messages", lambda m: F.when(F.col("conv_id") % 5 == 0, F.upper(m["content"])).otherwise(m["content"]))
    return rows.select("conv_id", chat.content_preserved(pieces, chat.render_chat("messages")).alias("preserved"))


def _fn15(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = F.concat(F.when(F.col("turn") % 3 == 0, "<|im_start|><|a|>").otherwise(""), F.col("text"), F.when(F.col("turn") % 2 == 0, "<|im_start|>").otherwise(""))
    ids = F.array(F.col("turn").cast("int"), F.lit(0), F.lit(7), F.when(F.col("role") == "user", 7).otherwise(1))
    ends = chat.doubled_ends(ids, F.lit(0), F.lit(7))
    return rows.select(
        "conv_id", "turn", F.array_join(chat.literal_tokens(marked), " ").alias("literal"), ends["duplicate_bos"].alias("duplicate_bos"),
        ends["duplicate_eos"].alias("duplicate_eos"), chat.is_prefix(F.array(F.lit(0), F.lit(0)), ids).alias("prefix"),
    )


REDACTION = (
    (0, "key hf_abcdefgh12", "key hf_***"),
    (1, "Bearer abc.def now", "Bearer *** now"),
    (2, "see https://user:pw@example.com/a?q=1#f.", "see https://example.com/a."),
    (3, "at http://10.1.2.3/x and", "at <redacted-url> and"),
    (4, "file /home/someone/data.txt here", "file <redacted-path> here"),
    (5, "ftp://example.com/x", "<redacted-url>"),
    (6, "C:\\Users\\x y", "<redacted-path> y"),
    (7, "~/notes/a.txt and text/plain", "<redacted-path> and text/plain"),
)


def _fn16(spark, sf_dir):
    """Every conversation row's whole text with a planted secret behind it; the SQL knows what becomes of the secret."""
    rows = table(spark, sf_dir, "conversations")
    spelled = F.lit("plain")
    for k, given, _ in REDACTION:
        spelled = F.when((F.col("conv_id") + F.col("turn")) % 9 == k, F.lit(given)).otherwise(spelled)
    whole = F.concat_ws(" ", F.coalesce("text", F.lit("")), spelled)
    return rows.select("conv_id", "turn", F.md5(redact.redact_text(whole)).alias("redacted_md5"))


_FN16 = "SELECT conv_id, turn, md5(concat_ws(' ', coalesce(text, ''), CASE (conv_id + turn) % 9 " + " ".join(
    f"WHEN {k} THEN '{wanted}'" for k, _, wanted in REDACTION
) + " ELSE 'plain' END)) AS redacted_md5 FROM {conversations}"


def _fn17(spark, sf_dir):
    return text_lengths(spark, sf_dir).select(
        "row_index", units.round_up(F.col("sequence_tokens"), 64).alias("to_64"), units.round_up(F.col("sequence_tokens"), 1).alias("to_1"),
        units.round_up(F.col("sequence_tokens"), None).alias("to_none"),
    )


def _fn18(spark, sf_dir):
    rows = view(spark, sf_dir, "v_uploads")
    source = keys.stable_key("src_", F.col("owner_id"), F.col("analysis_id"))
    step = rows.select("upload_id", source.alias("source_key"))
    return step.select("upload_id", "source_key", keys.stable_key("pre_", F.col("source_key"), F.lit("sft-text-1"), F.lit(None)).alias("preprocess_key"))


def _fn19(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tensors").withColumn("numel", F.col("dim0") * F.col("dim1"))
    rows = rows.withColumn("raw_dtype", F.when(F.col("shard") == "shard-3", "F4").otherwise(F.col("raw_dtype")))
    return units.with_bytes(rows).groupBy("model", "dtype").agg(F.sum("nbytes").alias("nbytes"), F.sum("numel").alias("numel"))


def _fn20(spark, sf_dir):
    return view(spark, sf_dir, "v_tensors").select(
        "name", names.component("name").alias("component"), names.layer_index("name").alias("layer_index"), names.module("name").alias("module"),
        names.leaf("name").alias("leaf"), names.parameter("name").alias("parameter"),
    ).distinct()


def _prj1(spark, sf_dir):
    rows = chats(spark, sf_dir).select("conv_id", "messages", (F.col("conv_id") % 2 == 0).alias("flag"), F.lit("x").alias("name"), F.lit(1.5).alias("score"))
    return M.column_kinds(rows).select("position", "name", "kind")


def _prj2(spark, sf_dir):
    return M.column_kinds(table(spark, sf_dir, "documents")).select("name", "dtype")


def schemas(spark, sf_dir):
    """Schemas of many datasets, derived from the suppliers: which columns a dataset has depends on its key."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    cols = F.array(
        F.when(F.col("k") % 2 == 0, F.lit("Question")), F.when(F.col("k") % 3 == 0, F.lit("prompt")), F.when(F.col("k") % 2 == 0, F.lit("chosen")),
        F.when(F.col("k") % 4 == 0, F.lit("rejected")), F.when(F.col("k") % 5 == 0, F.lit("answer")), F.when(F.col("k") % 7 == 0, F.lit("text")),
    )
    named = rows.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("dataset"), F.posexplode(F.array_compact(cols)).alias("position", "name"))
    return named.withColumn("kind", F.lit("string"))


def _prj3(spark, sf_dir):
    return M.suggest(M.mapping_candidates(schemas(spark, sf_dir), "dpo")).select("dataset", "format", "prompt", "chosen", "rejected")


_PRJ3 = """
SELECT dataset, format, prompt, chosen, rejected FROM (
  SELECT 'd' || CAST(s_suppkey AS VARCHAR) AS dataset, s_suppkey % 4 = 0 AS pair, s_suppkey % 3 = 0 AS two,
    'preference' AS format, 'Question' AS prompt, 'chosen' AS chosen, 'rejected' AS rejected FROM {supplier}) t WHERE pair AND NOT two"""


def _prj4(spark, sf_dir):
    """One mapping held against the schemas of all datasets."""
    kinds = schemas(spark, sf_dir).withColumn("kind", F.when(F.col("name") == "prompt", "number").otherwise(F.col("kind")))
    requested = {"prompt": "prompt", "chosen": "chosen", "text": "Question", "system": "nothing"}
    return M.validate_mapping(kinds, requested, "preference")


#: Datasets with a column at all.
_SCHEMAS = "SELECT 'd' || CAST(s_suppkey AS VARCHAR) AS dataset, s_suppkey AS k FROM {supplier} WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0".replace("k %", "s_suppkey %")
_PRJ4 = f"""
SELECT dataset, role, name, issue FROM (SELECT dataset, unnest([
    {{'role': 'prompt', 'name': 'prompt', 'issue': CASE WHEN k % 3 = 0 THEN 'kind_mismatch' ELSE 'missing_column' END}},
    {{'role': 'chosen', 'name': 'chosen', 'issue': CASE WHEN k % 2 <> 0 THEN 'missing_column' END}},
    {{'role': 'text', 'name': 'Question', 'issue': 'role_not_in_format'}},
    {{'role': 'system', 'name': 'nothing', 'issue': 'missing_column'}},
    {{'role': 'rejected', 'name': NULL, 'issue': 'missing_role'}}], recursive := true) FROM ({_SCHEMAS}) t) u WHERE issue IS NOT NULL"""


def _prj5(spark, sf_dir):
    return M.apply_mapping(table(spark, sf_dir, "documents"), {"prompt": "lang", "completion": "source"}, ("doc_id",))


def _prj6(spark, sf_dir):
    rows = view(spark, sf_dir, "v_preference")
    return rows.select("row_index", L.row_checks({r: F.col(r) for r in ("prompt", "chosen", "rejected")}).alias("error_code"))


def _prj7(spark, sf_dir):
    lengths = text_lengths(spark, sf_dir)
    return L.ok_rows(lengths).select("row_id").withColumn("kind", F.lit("ok")).unionByName(L.failed_rows(lengths).select("row_id").withColumn("kind", F.lit("failed")))


def _prj8(spark, sf_dir):
    rows = chats(spark, sf_dir)
    chars = text.row_chars(rows)
    return rows.select("conv_id", chars.alias("chars"), L.oversize(chars, 400).alias("error_code"))


def _prj9(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.row_bytes(rows).alias("row_bytes")).where("row_bytes <= 3000")


def _prj10(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct("lang").alias("meta"), F.when(F.col("doc_id") % 10 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("n_chars")
    )
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("meta", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("extra", T.StringType())])
    return M.cast_to(rows, schema)


def _prj11(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_index"),
        F.when(F.col("doc_id") % 7 == 3, '"text"').otherwise("12").alias("a"),
        F.when(F.col("doc_id") % 11 == 5, "[1]").otherwise('{"k": 1}').alias("b"),
        F.lit("true").alias("c"),
    )
    return M.mixed_types(rows, ["a", "b", "c"]).select("name", "row_index")


def _prj13(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/"), F.col("source"), F.lit("/part.json"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("C:\\data\\"), F.col("source"))
    )
    return rows.select("doc_id", text.safe_shard_id(F.coalesce(spelled, F.concat(F.lit("rel/"), F.col("source")))).alias("shard_id"))


def _set2(spark, sf_dir):
    """The declared columns that each dataset lacks."""
    have = schemas(spark, sf_dir).select("dataset", "name")
    wanted = have.select("dataset").distinct().select("dataset", F.explode(F.array(*map(F.lit, ("text", "prompt", "chosen", "notes")))).alias("name"))
    return wanted.exceptAll(have)


_SET2 = f"""
SELECT dataset, name FROM ({_SCHEMAS}) t, (VALUES ('text'), ('prompt'), ('chosen'), ('notes')) w(name)
EXCEPT ALL SELECT dataset, name FROM ({_SCHEMAS}) t, (VALUES ('text', 7), ('prompt', 3), ('chosen', 2)) h(name, m) WHERE k % m = 0"""


def _udf1(spark, sf_dir):
    """Every registered adapter's row, ok and token counts over its own rows."""
    text_rows = view(spark, sf_dir, "v_text")
    place = {"split": F.lit("train"), "shard_id": F.lit("c")}
    pairs = view(spark, sf_dir, "v_preference").withColumns(place)
    talks = chats(spark, sf_dir).withColumns(place | {"row_index": F.col("conv_id").cast("long")})
    rows_of = {
        "text": lambda f: f(text_rows), "messages": lambda f: f(talks), "preference": lambda f: f(pairs), "prompt": lambda f: f(pairs),
        "prompt_completion": lambda f: f(pairs, "prompt", "rejected"),
    }
    out = None
    for (_, layout), (adapter, version) in L.ADAPTERS.items():
        longest = F.coalesce("sequence_tokens", "chosen_total_tokens", "prompt_tokens")
        counted = rows_of[layout](adapter).agg(
            F.count("*").alias("rows"), F.count_if(F.col("processing_status") == "ok").alias("ok"), F.sum(longest).alias("tokens")
        )
        counted = counted.withColumn("adapter", F.lit(version))
        out = counted if out is None else out.unionByName(counted)
    return out.select("adapter", "rows", "ok", "tokens")


def _udtf1(spark, sf_dir):
    from lengthlab.operators import stats as S

    return S.branch_rows(preference_lengths(spark, sf_dir), "dpo").groupBy("branch").agg(F.count("*").alias("n"), F.sum("length").alias("total"))


_DIGEST = f"sha256('input_ids:' || array_to_string(list_transform(regexp_extract_all({{}}, '{text.TOKENS}'), lambda t: hex(t)), ',') || chr(10))"

ENTRIES = {
    "fn1_normalize_messages": (_fn1, sql("SELECT conv_id, n::INT AS n, " + _JOINED.format("messages") + " AS digest FROM {chat} WHERE len(list_filter(messages, lambda m: m.content = '' OR m.content IS NULL)) = 0")),
    "fn2_text_parts": (_fn2, sql("SELECT conv_id, count(*) FILTER (role <> 'system')::INT AS n, md5(coalesce(string_agg(content, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS digest FROM {v_messages} GROUP BY conv_id")),
    "fn3_empty_system_policy": (_fn3, sql("SELECT row_index, CASE WHEN row_index % 4 = 0 OR trim(system) = '' THEN 1 ELSE 2 END AS kept, CASE WHEN row_index % 4 = 0 OR trim(system) = '' THEN 1 ELSE 0 END AS dropped FROM {v_preference}")),
    "fn4_render_chat": (_fn4, sql(f"SELECT conv_id, md5({_RENDER.format('messages')}) AS rendered, md5({_RENDER.format('messages')} || '<|im_start|>assistant' || chr(10)) AS prompted FROM {{chat}}")),
    "fn5_token_length": (_fn5, sql(f"SELECT row_index, {_n('text')} AS tokens, strlen(text) AS bytes, length(text) AS chars FROM {{v_text}}")),
    "fn6_sft_lengths": (
        _fn6,
        sql(f"""
SELECT 'train:' || CAST(row_index AS VARCHAR) AS row_id, p AS prompt_tokens, greatest(t - p, 0) AS completion_tokens, t AS sequence_tokens,
  greatest(t - greatest(p, 1), 0) AS loss_token_count, 'ok' AS processing_status
FROM (SELECT row_index, {_n('prompt')} AS p, {_n("prompt || CASE WHEN ends_with(chosen, '<|im_end|>') THEN chosen ELSE chosen || '<|im_end|>' END")} AS t FROM {{v_preference}}) a
UNION ALL
SELECT 'chat:' || CAST(conv_id AS VARCHAR), NULL, NULL, t, greatest(t - 1, 0), 'ok' FROM (SELECT conv_id, {_n(_RENDER.format('messages'))} AS t FROM {{chat}}) b
UNION ALL
SELECT 'spoken:' || CAST(conv_id AS VARCHAR), NULL, NULL, {_n(_RENDER.format('messages'))},
  coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: {_n("coalesce(m.content, '') || '<|im_end|>'")})), 0), 'ok' FROM {{chat}}"""),
    ),
    "fn7_dpo_lengths": (
        _fn7,
        sql(
            "SELECT row_id, CASE WHEN ok THEN prompt_tokens END AS prompt_tokens, chosen_total_tokens, rejected_total_tokens, chosen_completion_tokens, rejected_completion_tokens, "
            "CASE WHEN chosen IS NULL THEN 'missing_chosen' WHEN prompt IS NULL THEN 'missing_prompt' WHEN rejected IS NULL THEN 'missing_rejected' END AS error_code FROM {pref}"
        ),
    ),
    "fn8_grpo_lengths": (_fn8, sql("SELECT row_id, prompt_tokens, CASE WHEN prompt_tokens > 64 THEN 'exceeded' ELSE 'ok' END AS context_status FROM {pref}")),
    "fn9_extract_prompt": (
        _fn9,
        sql("""
SELECT conv_id, CASE WHEN m > 0 THEN p::INT END AS prompt, CASE WHEN m > 0 THEN (len(a) - p)::INT END AS chosen, CASE WHEN m > 0 THEN (len(b) - p)::INT END AS rejected
FROM (SELECT *, least(len(a), len(b)) AS m,
  coalesce(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role || a[i].content <> b[i].role || b[i].content)[1], least(len(a), len(b))) - 1 AS p FROM {pairs}) t"""),
    ),
    "fn10_add_strip_eos": (
        _fn10,
        sql("""
SELECT conv_id, turn, (length(t) + CASE WHEN ends_with(t, '</s>') THEN 0 ELSE 4 END)::INT AS with_eos, (length(t) - CASE WHEN ends_with(t, '</s>') THEN 4 ELSE 0 END)::INT AS without_eos
FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN '</s>' ELSE '' END AS t FROM {conversations}) x"""),
    ),
    "fn11_loss_positions": (
        _fn11,
        sql(f"SELECT row_index, greatest({_n('text')} - 1, 0) AS unmasked, len(list_filter(range(1, length(lang) + 6), lambda i: i % 3 <> 0)) AS masked FROM {{v_text}} WHERE text IS NOT NULL"),
    ),
    "fn12_content_digest": (_fn12, sql("SELECT min(row_index) AS row_index, count(*) AS n FROM {v_text} GROUP BY text, lang")),
    "fn13_token_digest": (
        _fn13,
        sql(
            f"SELECT split || ':' || CAST(row_index AS VARCHAR) AS row_id, {_DIGEST.format('text')} AS token_digest FROM {{v_text}} WHERE text IS NOT NULL "
            f"UNION ALL SELECT 'chat:' || CAST(conv_id AS VARCHAR), {_DIGEST.format(_RENDER.format('messages'))} FROM {{chat}}"
        ),
    ),
    "fn14_content_preserved": (
        _fn14,
        sql(f"SELECT conv_id, len(list_filter(messages, lambda m: NOT contains({_RENDER.format('messages').replace('m.', 'k.').replace('lambda m', 'lambda k')}, CASE WHEN conv_id % 5 = 0 THEN upper(m.content) ELSE m.content END))) = 0 AS preserved FROM {{chat}}"),
    ),
    "fn15_special_token_findings": (
        _fn15,
        sql("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<|a|> <|im_start|>' WHEN turn % 2 = 0 THEN '<|im_start|>' ELSE '' END AS literal,
  turn = 0 AS duplicate_bos, role = 'user' AS duplicate_eos, turn = 0 AS prefix FROM {conversations}"""),
    ),
    "fn16_redact_text": (_fn16, sql(_FN16)),
    "fn17_round_up": (_fn17, sql("SELECT row_index, ((sequence_tokens + 63) // 64 * 64)::BIGINT AS to_64, sequence_tokens::BIGINT AS to_1, sequence_tokens::BIGINT AS to_none FROM {sft}")),
    "fn18_stable_keys": (
        _fn18,
        sql("""
SELECT upload_id, k AS source_key, 'pre_' || sha256(k || chr(31) || 'sft-text-1' || chr(31) || chr(0)) AS preprocess_key
FROM (SELECT upload_id, 'src_' || sha256(CAST(owner_id AS VARCHAR) || chr(31) || CAST(analysis_id AS VARCHAR)) AS k FROM {v_uploads}) t"""),
    ),
    "fn19_tensor_bytes": (
        _fn19,
        sql("""
SELECT model, dtype, sum((dim0 * dim1 * bits + 7) // 8)::BIGINT AS nbytes, sum(dim0 * dim1)::BIGINT AS numel FROM (
  SELECT *, CASE WHEN shard = 'shard-3' THEN 'float4_e2m1' WHEN raw_dtype = 'F32' THEN 'float32' ELSE 'bfloat16' END AS dtype,
    CASE WHEN shard = 'shard-3' THEN 4 WHEN raw_dtype = 'F32' THEN 32 ELSE 16 END AS bits FROM {v_tensors}) t GROUP BY model, dtype"""),
    ),
    "fn20_tensor_name_parts": (
        _fn20,
        sql("""
SELECT DISTINCT name, CASE WHEN name LIKE 'mtp.%' THEN 'mtp' WHEN name LIKE '%.visual.%' THEN 'vision' ELSE 'text' END AS component,
  CASE WHEN regexp_matches(name, 'layers\\.|blocks\\.') THEN CAST(regexp_extract(name, '(?:layers|blocks)\\.([0-9]+)', 1) AS BIGINT) END AS layer_index,
  regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS module, split_part(name, '.', -2) AS leaf, split_part(name, '.', -1) AS parameter FROM {v_tensors}"""),
    ),
    "prj1_column_kinds": (_prj1, sql("SELECT * FROM (VALUES (0,'conv_id','number'),(1,'messages','messages'),(2,'flag','other'),(3,'name','string'),(4,'score','number')) t(position, name, kind)")),
    "prj2_column_dtypes": (
        _prj2,
        sql("SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS dtype FROM (DESCRIBE SELECT * FROM {documents}) t"),
    ),
    "prj3_infer_mapping": (_prj3, sql(_PRJ3)),
    "prj4_validate_mapping": (_prj4, sql(_PRJ4)),
    "prj5_apply_mapping": (_prj5, sql("SELECT doc_id, lang AS prompt, source AS completion FROM {documents}")),
    "prj6_row_checks": (
        _prj6,
        sql("SELECT row_index, CASE WHEN chosen IS NULL THEN 'missing_chosen' WHEN prompt IS NULL THEN 'missing_prompt' WHEN rejected IS NULL THEN 'missing_rejected' END AS error_code FROM {v_preference}"),
    ),
    "prj7_ok_failed_filter": (_prj7, sql("SELECT row_id, processing_status AS kind FROM {sft}")),
    "prj8_oversize_filter": (
        _prj8,
        sql("SELECT conv_id, sum(length(role) + length(content))::BIGINT AS chars, CASE WHEN sum(length(role) + length(content)) > 400 THEN 'row_too_large' END AS error_code FROM {v_messages} GROUP BY conv_id"),
    ),
    "prj9_row_byte_quota": (
        _prj9,
        sql("SELECT doc_id, row_bytes FROM (SELECT doc_id, (coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0))::BIGINT AS row_bytes FROM {documents}) t WHERE row_bytes <= 3000"),
    ),
    "prj10_schema_cast": (
        _prj10,
        sql("SELECT doc_id, '{\"lang\":\"' || lang || '\"}' AS meta, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS n_chars, CAST(NULL AS VARCHAR) AS extra, CASE WHEN doc_id % 10 = 0 THEN 'schema_mismatch' END AS error_code FROM {documents}"),
    ),
    "prj11_mixed_type_columns": (
        _prj11,
        sql("SELECT 'a' AS name, min(doc_id) FILTER (doc_id % 7 = 3) AS row_index FROM {documents} UNION ALL SELECT 'b', min(doc_id) FILTER (doc_id % 11 = 5) FROM {documents}"),
    ),
    "prj13_safe_shard_id": (
        _prj13,
        sql("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'part.json' WHEN 1 THEN source ELSE 'rel/' || source END AS shard_id FROM {documents}"),
    ),
    "set2_except": (_set2, sql(_SET2)),
    "udf1_preprocessing_adapter": (
        _udf1,
        sql("""
SELECT 'sft-text-1' AS adapter, count(*) AS rows, count(text) AS ok, sum(sequence_tokens)::BIGINT AS tokens FROM {sft}
UNION ALL SELECT 'dpo-1', count(*), count(*) FILTER (ok), sum(chosen_total_tokens)::BIGINT FROM {pref}
UNION ALL SELECT 'grpo-1', count(*), count(prompt), (sum(prompt_tokens) FILTER (prompt IS NOT NULL))::BIGINT FROM {pref}
UNION ALL SELECT 'sft-messages-1', count(*), count(*), sum(""" + _n(_RENDER.format("messages")) + """)::BIGINT FROM {chat}
UNION ALL SELECT 'sft-prompt-completion-1', count(*), count(*) FILTER (ok), (sum(""" + _n("prompt || CASE WHEN ends_with(rejected, '<|im_end|>') THEN rejected ELSE rejected || '<|im_end|>' END") + """) FILTER (ok))::BIGINT
  FROM (SELECT *, prompt IS NOT NULL AND rejected IS NOT NULL AS ok FROM {v_preference}) q"""),
    ),
    "udtf1_branch_rows": (
        _udtf1,
        sql(
            " UNION ALL ".join(
                f"SELECT '{b}' AS branch, count(*) AS n, sum({e})::BIGINT AS total FROM {{pref}} WHERE ok"
                for b, e in (
                    ("pair_max", "greatest(chosen_total_tokens, rejected_total_tokens)"),
                    ("prompt", "prompt_tokens"),
                    ("chosen_total", "chosen_total_tokens"),
                    ("rejected_total", "rejected_total_tokens"),
                    ("chosen_completion", "chosen_completion_tokens"),
                    ("rejected_completion", "rejected_completion_tokens"),
                )
            )
        ),
    ),
}
