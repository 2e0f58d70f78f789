"""Conversations as arrays of (role, content) structs: normalising, rendering, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalize_messages(messages: Column | str, role: str = "from", content: str = "value") -> Column:
    """from/value messages as role/content; null where a message lacks a role or textual content."""
    messages = _c(messages)
    fixed = F.transform(messages, lambda m: F.struct(m[role].alias("role"), m[content].alias("content")))
    return F.when(F.forall(fixed, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), fixed)


def text_parts(blocks: Column | str) -> Column:
    """The text pieces of block-list content: the texts of blocks of type "text"."""
    return F.transform(
        F.filter(_c(blocks), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]
    )


def is_blank(text: Column | str) -> Column:
    return F.trim(F.coalesce(_c(text), F.lit(""))) == ""


def omit_blank_system(messages: Column | str) -> Column:
    """The omit policy: system messages without content go."""
    return F.filter(_c(messages), lambda m: ~((m["role"] == "system") & is_blank(m["content"])))


def render_chat(messages: Column | str, generation_prompt: bool = False) -> Column:
    """One text in the ChatML layout; null for an empty conversation, which cannot be rendered."""
    messages = _c(messages)
    turns = F.transform(
        messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(END + "\n"))
    )
    text = F.concat(F.array_join(turns, ""), F.lit(f"{START}assistant\n" if generation_prompt else ""))
    return F.when(F.size(messages) > 0, text)


def assistant_spans(messages: Column | str) -> Column:
    """(start, stop) of the assistant turns with their end marks in the rendered text, in characters."""
    fixed = len(START) + 1, len(END) + 1  # the start mark and the line end behind the role; the end mark and its line end

    def add(found: Column, m: Column) -> Column:
        start = found["at"] + fixed[0] + F.length(m["role"])
        stop = start + F.coalesce(F.length(m["content"]), F.lit(0)) + fixed[1]
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(m["role"] == "assistant", F.concat(found["spans"], span)).otherwise(found["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start: int, stop: int>>")
    return F.aggregate(_c(messages), F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda found: found["spans"])


def extract_prompt(chosen: Column | str, rejected: Column | str) -> Column:
    """(prompt, chosen, rejected) of two message lists: their common beginning and what is left of each.

    Where one list is a beginning of the other, the last shared message stays out of the prompt. Null where
    either list is empty.
    """
    a, b = _c(chosen), _c(rejected)
    n = F.least(F.size(a), F.size(b))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    at = F.array_position(differs, True)
    shared = F.when(at > 0, at - 1).otherwise(n - 1).cast("int")
    rest = lambda x: F.slice(x, shared + 1, F.greatest(F.size(x), F.lit(1)))
    return F.when(n > 0, F.struct(F.slice(a, F.lit(1), shared).alias("prompt"), rest(a).alias("chosen"), rest(b).alias("rejected")))


def add_eos(text: Column | str, eos: str) -> Column:
    text = _c(text)
    return F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(eos)))


def strip_eos(text: Column | str, eos: str) -> Column:
    text = _c(text)
    return F.when(F.endswith(text, F.lit(eos)), F.substring(text, F.lit(1), F.length(text) - len(eos))).otherwise(text)


def loss_positions(masks: list[Column] | None, length: Column) -> Column:
    """Positions after the first at which every mask is 1; without masks all but the first; 0 for length <= 1."""
    length = length.cast("long")
    if not masks:
        return F.greatest(length - 1, F.lit(0).cast("long"))
    both = masks[0]
    for mask in masks[1:]:
        both = F.zip_with(both, mask, lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    counted = F.aggregate(F.slice(both, F.lit(2), F.greatest(length.cast("int"), F.lit(1))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("int"))
    return F.when(length <= 1, 0).otherwise(counted).cast("long")


def content_preserved(pieces: Column | str, rendered: Column | str) -> Column:
    """True if every piece stands verbatim in the rendered text."""
    rendered = _c(rendered)
    return F.forall(_c(pieces), lambda p: F.contains(rendered, p))


def literal_tokens(text: Column | str, pattern: str = r"<\|[a-z_]+\|>") -> Column:
    """Distinct control tokens spelled out in a text, sorted; texts without the first two characters skip the search."""
    text = _c(text)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    return F.when(F.contains(text, F.lit("<|")), found).otherwise(F.array().cast("array<string>"))


def doubled_ends(ids: Column | str, bos: Column, eos: Column) -> Column:
    """Flags duplicate_bos and duplicate_eos of a token array."""
    ids = _c(ids)
    n = F.size(ids)
    first = (F.get(ids, F.lit(0)) == bos) & (F.get(ids, F.lit(1)) == bos)
    last = (F.get(ids, n - 1) == eos) & (F.get(ids, n - 2) == eos)
    no = F.lit(False)
    return F.struct(F.coalesce((n >= 2) & first, no).alias("duplicate_bos"), F.coalesce((n >= 2) & last, no).alias("duplicate_eos"))


def is_prefix(prompt: Column | str, full: Column | str) -> Column:
    """True if the first array begins the second."""
    prompt, full = _c(prompt), _c(full)
    return F.slice(full, F.lit(1), F.greatest(F.size(prompt), F.lit(0))) == prompt
