"""Digests over real token ids and loss masks by offsets, against plain versions with a tokenizer file."""

import hashlib

from pyspark.sql import functions as F

from lengthlab.functions import chat, tokenizer
from lengthlab.operators import lengths as L

TALK = "row_index long, split string, shard_id string, messages array<struct<role: string, content: string>>"


def digest(**sequences):
    lines = "".join(f"{name}:{','.join(map(str, ids))}\n" for name, ids in sorted(sequences.items()))
    return hashlib.sha256(lines.encode()).hexdigest()


def hexed(*tokens):
    return [t.encode().hex().upper() for t in tokens]


def test_digests_tell_texts_and_tokenizers_apart(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer.default_file())
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    rows = [(0, "cat"), (1, "dog"), (2, "A cat, été!"), (3, ""), (4, None)]
    df = spark.createDataFrame([(i, "s", "c", t) for i, t in rows], "row_index long, split string, shard_id string, text string")
    found = {by: [r.token_digest for r in L.sft_text(df, by=by).orderBy("row_index").collect()] for by in ("tokens", "bytes", "chars")}
    assert found["tokens"] == [digest(input_ids=hexed(*t)) for t in (["cat"], ["dog"], ["A", "cat", ",", "é", "t", "é", "!"], [])] + [None]
    assert found["bytes"][2] == digest(input_ids=[f"{b:02X}" for b in "A cat, été!".encode()]) and found["chars"][2] == digest(input_ids=hexed(*"A cat, été!"))
    by_file = L.sft_text(df, by=tokenizer.file_token_length()).orderBy("row_index").collect()
    assert [r.token_digest for r in by_file] == [digest(input_ids=ids(t)) for _, t in rows[:4]] + [None]
    assert by_file[0].tokenizer_fingerprint == "file-byte_bpe_50k.json"
    assert L.sft_text(df, by=lambda c: F.length(c)).where("token_digest is not null").count() == 0

    pairs = df.selectExpr("row_index", "split", "shard_id", "cast(null as string) as system", "'why' as prompt", "'yes it is' as chosen", "text as rejected")
    start, reply = "<|im_start|>user\nwhy<|im_end|>\n", "<|im_start|>assistant\n"
    first = L.dpo(pairs.where("row_index = 2"), by=tokenizer.file_token_length()).first()
    branch = {name: ids(f"{start}{reply}{t}<|im_end|>\n") for name, t in (("chosen", "yes it is"), ("rejected", "A cat, été!"))}
    own = ids(start + reply)
    assert first.token_digest == digest(**{f"{name}_input_ids": own + b[len(own) :] for name, b in branch.items()})
    assert L.grpo(pairs.where("row_index = 2"), by=tokenizer.file_token_length()).first().token_digest == digest(prompt_ids=own)


def test_loss_counts_tokens_that_lie_inside_assistant_turns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer.default_file())
    talks = [
        [("user", "hi"), ("assistant", "hello there, été"), ("user", "more"), ("assistant", "")],
        [("assistant", "<|im_end|>\n  spaces  "), ("tool", "x"), ("assistant", None)],
        [("user", "nobody answers")],
        [],
    ]
    df = spark.createDataFrame([(i, "s", "c", m) for i, m in enumerate(talks)], TALK)
    rows = L.sft_messages(df, by=tokenizer.file_token_length(), assistant_only=True).orderBy("row_index").collect()
    spans = [[(s.start, s.stop) for s in r.x] for r in df.orderBy("row_index").select(chat.assistant_spans("messages").alias("x")).collect()]
    for talk, row, found in zip(talks[:3], rows, spans):
        text, wanted = "", []
        for role, content in talk:
            start = len(text) + len(f"<|im_start|>{role}\n")
            text += f"<|im_start|>{role}\n{content or ''}<|im_end|>\n"
            if role == "assistant":
                wanted.append((start, len(text)))
        assert found == wanted
        offsets = library.encode(text, add_special_tokens=False).offsets
        inside = sum(any(a <= s and e <= b for a, b in wanted) for s, e in offsets[1:])
        assert (row.loss_token_count, row.sequence_tokens) == (inside, len(offsets))
    assert rows[3].error_code == "empty_conversation" and rows[3].loss_token_count is None


def test_texts_are_encoded_in_pieces(spark, monkeypatch):
    """A batch of many texts is never encoded at once; counts, ids and nulls stay with their rows."""
    import pandas as pd
    from tokenizers import Tokenizer

    assert [len(p) for p in tokenizer.pieces(pd.Series(["ab", None, "cd", "e" * 9, "", "f"]), 4)] == [3, 1, 2]
    library, held = Tokenizer.from_file(tokenizer.default_file()), []

    class Counted:
        def encode_batch(self, texts, **more):
            held.append(sum(map(len, texts)))
            return library.encode_batch(texts, **more)

    monkeypatch.setattr(tokenizer, "_load", lambda path: Counted())
    texts = [None if i % 7 == 0 else f"text {i} " * (i % 50) for i in range(5000)]
    wanted = [None if t is None else len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    (found,) = list(tokenizer.file_token_length().func(iter([pd.Series(texts)])))
    assert [None if pd.isna(n) else n for n in found] == wanted
    assert len(held) > 1 and max(held) <= 1 << 18
