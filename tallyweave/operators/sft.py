"""Corpora -> chat messages -> token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions import chat, tokens as tk
from tallyweave.functions.text import strip_ws
from tallyweave.operators.encoding import PAD_ID, Encoder
from tallyweave.operators.lookup import HEAD_ROWS, lookup
from tallyweave.operators.order import fitting_shifts, natural_position
from tallyweave.sources.scratch import materialise


def sft_convert(df: DataFrame, messages: Column, min_response_length: int = -1) -> DataFrame:
    """Add ``messages``; the length filter applies only if a length above 0 is given."""
    out = df.withColumn("messages", messages)
    if min_response_length > 0:
        out = min_response_filter(out, min_response_length)
    return out


def min_response_filter(df: DataFrame, min_length: int, messages: str = "messages") -> DataFrame:
    return df.where(chat.response_long_enough(F.col(messages), min_length))


def language_filter(df: DataFrame, language: str | None, column: str = "language") -> DataFrame:
    """Optional equality filter; a plain comparison, so it reaches the scan."""
    return df if language is None else df.where(F.col(column) == language)


def assemble_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """Turn rows -> one row of ordered messages per conversation, whole.

    A row holds its conversation, so run ``filter_conversations`` with a token limit
    first where conversations may be of any length: what it lets through is bounded.
    """
    packed = turns.select(
        key, F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")).alias("m")
    )
    return packed.groupBy(key).agg(chat.role_content(F.sort_array(F.collect_list("m"))).alias("messages"))


def filter_conversations(
    turns: DataFrame,
    min_response_length: int = -1,
    max_tokens: int | None = None,
    key: str = "conv_id",
    role: str = "role",
    content: str = "text",
    tokenizer=tk.tokenize_text,
    bos: str = "<s>",
    eos: str = "</s>",
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """The message filters on turn rows, exact for conversations of any length.

    Run it before ``assemble_conversations``. A null answer is an empty one. The token
    limit adds up the turns' own counts, which is the count of the whole rendering for
    a tokenizer that does not join text across turns. Flags per conversation are combined on the map side, and the conversations
    with the most turns are looked up by broadcast: one of them may hold a third of all
    turns without being gathered anywhere.
    """
    short = (F.col(role) == "assistant") & (
        F.length(strip_ws(F.coalesce(F.col(content), F.lit("")))) < min_response_length
    )
    keep = F.count_if(short) == 0 if min_response_length > 0 else F.lit(True)
    if max_tokens is not None:
        rendered = chat.render_turn(F.col(role), F.col(content), bos, eos)
        keep = keep & (F.sum(F.size(tokenizer(rendered))) <= max_tokens)
    flags = turns.groupBy(key).agg(keep.alias("__keep"), F.count(F.lit(1)).alias("__turns"))
    found = lookup(turns, materialise(flags, "flags"), key, "__turns", head_rows=head_rows)
    return found.where("__keep").drop("__keep", "__turns")


def turn_pairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """User turns with the assistant turn that follows next, gaps in the numbers or not.

    Turns are numbered by bucket counts and met by an equi-join on ``(key, place + 1)``:
    unlike a window per conversation this spreads one huge conversation over all tasks.
    """
    rows = turns.select(key, turn, role, content)
    placed = natural_position(rows, turn, "__place", [key], fitting_shifts(turns, turn))
    users = placed.where(F.col(role) == "user").select(key, turn, "__place", F.col(content).alias("prompt"))
    answers = placed.where(F.col(role) == "assistant").select(
        key, (F.col("__place") - 1).alias("__place"), F.col(content).alias("completion")
    )
    return users.join(answers, [key, "__place"]).drop("__place")


def chat_tokens(
    df: DataFrame, keys: Sequence[str], encode: Encoder, max_length: int | None, messages: str = "messages", tokenizer=tk.tokenize_text
) -> DataFrame:
    """``(*keys, __ids)``: rendered, tokenised once and encoded; rows over ``max_length`` are dropped, if it is given."""
    tokens = tokenizer(chat.chat_render(F.col(messages)))
    if max_length is None:
        listed = df.withColumn("__list", tokens)
    else:
        listed = tk.keep_tokens(df, "__list", tokens, lambda t: tk.at_most(t, max_length))
    return encode(listed, F.col("__list"), "__ids", keys, keys)


def padded(df: DataFrame, max_length: int, pad_id: int = PAD_ID) -> DataFrame:
    """``__ids`` padded left, and the mask."""
    return (
        df.withColumn("input_ids", tk.pad_left(F.col("__ids"), max_length, F.lit(pad_id)))
        .withColumn("attention_mask", tk.pad_left_mask(F.col("__ids"), max_length))
        .drop("__ids")
    )


def tokenize_chat(
    df: DataFrame,
    keys: Sequence[str],
    encode: Encoder,
    max_length: int = 2048,
    no_filter: bool = False,
    pad_id: int = PAD_ID,
    messages: str = "messages",
    tokenizer=tk.tokenize_text,
) -> DataFrame:
    """Integer token rows ``(*keys, input_ids, attention_mask)``; ``keys`` identify a row.

    Render, tokenise, drop rows that are too long, encode, pad left and add the mask. The
    filter runs on the unpadded list, before the lookup and the padding are paid for.
    """
    return padded(chat_tokens(df, keys, encode, None if no_filter else max_length, messages, tokenizer), max_length, pad_id)


def add_labels(df: DataFrame) -> DataFrame:
    """Labels are a copy of the ids, padding included."""
    return df.withColumn("labels", F.col("input_ids"))


def select_token_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "input_ids", "attention_mask", "labels")


def require_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Pass a ready-made messages column through after a check of its type."""
    want = {"role": "string", "content": "string"}
    kind = df.schema[messages].dataType
    fields = getattr(getattr(kind, "elementType", None), "fields", [])
    if {f.name: f.dataType.simpleString() for f in fields} != want:
        raise ValueError(f"{messages} must be an array of (role, content), not {kind.simpleString()}")
    return df


def response_column(df: DataFrame, question: str, answer: str, min_response_length: int = -1) -> DataFrame:
    """Choose by name which of several response columns becomes the assistant turn."""
    return sft_convert(df, chat.pair_messages(F.col(question), F.col(answer)), min_response_length)


def response_override(df: DataFrame, answer: str, value: str) -> DataFrame:
    """Replace every response by one constant (no length filter applies afterwards)."""
    return df.withColumn(answer, F.lit(value))
