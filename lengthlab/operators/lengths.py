"""From source rows to length records: mapping checks, lengths per objective, statuses.

A record that cannot be processed is kept as a failed row with its position and code; unknown lengths are
null, never 0; nothing is truncated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lengthlab.functions import chat
from lengthlab.functions.keys import token_digest
from lengthlab.functions.text import safe_shard_id, token_ids, token_length, tokens

LENGTHS = (
    "prompt_tokens", "completion_tokens", "sequence_tokens", "loss_token_count", "chosen_total_tokens", "rejected_total_tokens",
    "chosen_completion_tokens", "rejected_completion_tokens",
)
SCHEMA = (
    ("row_id", "string"), ("row_index", "bigint"), ("shard_id", "string"), ("split", "string"), ("objective", "string"),
    *((name, "bigint") for name in LENGTHS),
    ("template_fingerprint", "string"), ("tokenizer_fingerprint", "string"), ("content_digest", "string"), ("token_digest", "string"),
    ("processing_status", "string"), ("context_status", "string"), ("error_code", "string"),
)
EOS = "<|im_end|>"
TEMPLATE, TOKENIZER = "chatml-1", "ascii-words-1"


#: How texts are counted: a name that token_length knows, or a function from a text column to a count.
Counter = str | Callable[[Column], Column]


def tokenizer_name(by: Counter) -> str:
    """What enters the records and keys; a counting function may carry its own name in `fingerprint`."""
    if callable(by):
        return getattr(by, "fingerprint", getattr(by, "__name__", type(by).__name__))
    return TOKENIZER if by == "tokens" else f"{by}-1"


def row_id(split: Column | str = "split", index: Column | str = "row_index") -> Column:
    split, index = (F.col(c) if isinstance(c, str) else c for c in (split, index))
    return F.concat(split, F.lit(":"), index.cast("string"))


def row_checks(required: dict[str, Column]) -> Column:
    """The error code of a row: the first required role (in name order) without a value; null if all are there."""
    code = F.lit(None).cast("string")
    for role in sorted(required, reverse=True):
        code = F.when(required[role].isNull(), F.lit(f"missing_{role}")).otherwise(code)
    return code


def oversize(chars: Column, most: int) -> Column:
    return F.when(chars > most, F.lit("row_too_large"))


def context_status(limit: Column | int | None) -> Column:
    """exceeded / ok / unknown per row, by its longest model input."""
    longest = F.greatest("sequence_tokens", "chosen_total_tokens", "rejected_total_tokens", "prompt_tokens")
    limit = F.lit(limit).cast("long") if not isinstance(limit, Column) else limit
    return F.when(limit.isNull() | longest.isNull(), "unknown").when(longest > limit, "exceeded").otherwise("ok")


def records(
    rows: DataFrame,
    objective: str,
    lengths: dict[str, Column],
    error: Column,
    content: Column,
    ids: Column,
    limit: int | None = None,
    by: Counter = "tokens",
) -> DataFrame:
    """The length table's rows; a failed row has no lengths and no digests."""
    ok = F.col("error_code").isNull()
    df = rows.withColumn("error_code", error)
    columns = {
        "row_id": row_id(),
        "row_index": F.col("row_index"),
        "shard_id": safe_shard_id("shard_id"),
        "split": F.col("split"),
        "objective": F.lit(objective),
        **{name: F.when(ok, lengths[name]) if name in lengths else F.lit(None) for name in LENGTHS},
        "template_fingerprint": F.lit(TEMPLATE),
        "tokenizer_fingerprint": F.lit(tokenizer_name(by)),
        "content_digest": F.when(ok, content),
        "token_digest": F.when(ok, ids),
        "processing_status": F.when(ok, "ok").otherwise("failed"),
        "error_code": F.col("error_code"),
    }
    df = df.select(*[column.cast(dict(SCHEMA)[name]).alias(name) for name, column in columns.items()])
    return df.withColumn("context_status", context_status(limit)).select(*[name for name, _ in SCHEMA])


def sft_text(rows: DataFrame, text: str = "text", limit: int | None = None, by: Counter = "tokens") -> DataFrame:
    """Plain text: the whole text is the sequence; every position but the first has loss."""
    if by == "tokens":  # a column of its own, so that a row's tokens are found once for its lengths, status and digest
        rows = rows.withColumn("_tokens", tokens(text))
        n, own = F.when(F.col("_tokens").isNotNull(), F.size("_tokens")), F.transform("_tokens", lambda t: F.hex(t))
    else:
        n, own = token_length(text, by), token_ids(text, by)
    lengths = {"sequence_tokens": n, "loss_token_count": chat.loss_positions(None, n)}
    content = F.sha2(F.concat_ws("\x1f", F.lit("text"), F.col(text)), 256)
    ids = token_digest({"input_ids": own})
    return records(rows, "sft", lengths, row_checks({"text": F.col(text)}), content, ids, limit, by)


def sft_messages(
    rows: DataFrame, messages: str = "messages", limit: int | None = None, by: Counter = "tokens", assistant_only: bool = False
) -> DataFrame:
    """A conversation rendered whole; an empty one fails.

    Every position but the first has loss; with assistant_only the positions of assistant turns with their end marks,
    which follow a header and so never hold the first position. A tokenizer whose tokens may cross the edge of a turn
    tells how many lie wholly inside; those that end at white space count the turns by themselves.
    """
    text = chat.render_chat(messages)
    n = token_length(text, by)
    loss = chat.loss_positions(None, n)
    if assistant_only and callable(by):
        if not hasattr(by, "inside"):
            raise ValueError("assistant-only loss needs a tokenizer that tells which tokens lie inside a span")
        loss = by.inside(text, chat.assistant_spans(messages))
    elif assistant_only:
        own = F.filter(messages, lambda m: m["role"] == "assistant")
        spoken = F.array_join(F.transform(own, lambda m: F.concat(F.coalesce(m["content"], F.lit("")), F.lit(EOS + "\n"))), "")
        loss = token_length(spoken, by)
    lengths = {"sequence_tokens": n, "loss_token_count": loss}
    code = F.when(F.col(messages).isNull(), "missing_messages").when(F.size(messages) == 0, "empty_conversation")
    return records(rows, "sft", lengths, code, F.sha2(text, 256), token_digest({"input_ids": token_ids(text, by)}), limit, by)


def sft_prompt_completion(
    rows: DataFrame, prompt: str, completion: str, limit: int | None = None, eos: str = EOS, by: Counter = "tokens"
) -> DataFrame:
    """Plain strings: the completion ends with the end text; loss on the completion only."""
    whole = F.concat(F.col(prompt), chat.add_eos(completion, eos))
    p, total = token_length(prompt, by), token_length(whole, by)
    lengths = {
        "prompt_tokens": p,
        "sequence_tokens": total,
        "completion_tokens": F.greatest(total - p, F.lit(0)),
        "loss_token_count": F.greatest(total - F.greatest(p, F.lit(1)), F.lit(0)),
    }
    code = row_checks({"prompt": F.col(prompt), "completion": F.col(completion)})
    return records(rows, "sft", lengths, code, F.sha2(whole, 256), token_digest({"input_ids": token_ids(whole, by)}), limit, by)


def _conversation(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def dpo(rows: DataFrame, limit: int | None = None, by: Counter = "tokens") -> DataFrame:
    """Prompt, and prompt with either branch, rendered whole; a branch is what follows the prompt's tokens."""
    turns = [("system", F.col("system")), ("user", F.col("prompt"))]
    prompt = chat.render_chat(chat.omit_blank_system(_conversation(*turns)), True)
    branch = {
        name: chat.render_chat(chat.omit_blank_system(_conversation(*turns, ("assistant", F.col(name)))))
        for name in ("chosen", "rejected")
    }
    p = token_length(prompt, by)
    lengths: dict[str, Column] = {"prompt_tokens": p}
    for name, text in branch.items():
        suffix = F.greatest(token_length(text, by) - p, F.lit(0))
        lengths[f"{name}_completion_tokens"] = suffix
        lengths[f"{name}_total_tokens"] = p + suffix
    code = row_checks({name: F.col(name) for name in ("prompt", "chosen", "rejected")})
    content = F.sha2(F.concat_ws("\x1f", "system", "prompt", "chosen", "rejected"), 256)
    own = token_ids(prompt, by)
    # What the model gets: the prompt's ids, and behind them what the branch adds.
    both = {f"{name}_input_ids": F.concat(own, F.slice(token_ids(t, by), F.size(own) + 1, F.greatest(F.size(token_ids(t, by)), F.lit(1)))) for name, t in branch.items()}
    ids = token_digest(both)
    return records(rows, "dpo", lengths, code, content, ids, limit, by)


def grpo(rows: DataFrame, limit: int | None = None, by: Counter = "tokens") -> DataFrame:
    """The prompt alone, with the generation prompt."""
    turns = [("system", F.col("system")), ("user", F.col("prompt"))]
    prompt = chat.render_chat(chat.omit_blank_system(_conversation(*turns)), True)
    code = row_checks({"prompt": F.col("prompt")})
    lengths = {"prompt_tokens": token_length(prompt, by)}
    return records(rows, "grpo", lengths, code, F.sha2(prompt, 256), token_digest({"prompt_ids": token_ids(prompt, by)}), limit, by)


#: Registered ways to process rows, by objective and layout; the name and version enter the preprocess key.
ADAPTERS = {
    ("sft", "text"): (sft_text, "sft-text-1"),
    ("sft", "messages"): (sft_messages, "sft-messages-1"),
    ("sft", "prompt_completion"): (sft_prompt_completion, "sft-prompt-completion-1"),
    ("dpo", "preference"): (dpo, "dpo-1"),
    ("grpo", "prompt"): (grpo, "grpo-1"),
}


def ok_rows(lengths: DataFrame) -> DataFrame:
    return lengths.where(F.col("processing_status") == "ok")


def failed_rows(lengths: DataFrame) -> DataFrame:
    return lengths.where(F.col("processing_status") == "failed")


def write_lengths(lengths: DataFrame, path: str, preprocess_key: str) -> None:
    """Parquet parts stamped with the key; parts of the same key are replaced, those of others stay."""
    keyed = lengths.withColumn("preprocess_key", F.lit(preprocess_key))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("preprocess_key").parquet(path)


def read_lengths(spark, path: str, preprocess_key: str | None = None) -> DataFrame:
    """The ok rows of one key; without a key the table must hold one key only."""
    df = spark.read.parquet(path)
    if preprocess_key is None:
        # The key is a folder name, so this reads no rows of the parts.
        if df.agg(F.min("preprocess_key") != F.max("preprocess_key")).first()[0]:
            raise ValueError("the table mixes preprocess keys")
    else:
        df = df.where(F.col("preprocess_key") == preprocess_key)
    return ok_rows(df)
