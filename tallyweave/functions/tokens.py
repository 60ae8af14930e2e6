"""Token-list expressions. Tokens are runs of letters and digits unless a hook says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokenize_text(c: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def truncate_tokens(tokens: Column, limit: int) -> Column:
    return F.slice(tokens, 1, limit)


def prompt_tokens(tokens: Column, prompt_length: int) -> Column:
    return F.slice(tokens, 1, prompt_length)


def completion_tokens(tokens: Column, prompt_length: int, max_new: int) -> Column:
    """Tokens after the prompt, up to the cap of prompt + max_new."""
    return F.slice(tokens, prompt_length + 1, max_new)


def trim_prompt(output: Column, prompt: Column) -> Column:
    """Drop as many leading tokens as the prompt holds."""
    return F.slice(output, F.size(prompt) + 1, F.size(output))


def pad_left(tokens: Column, length: int, pad: Column) -> Column:
    """Left-pad to ``length``; a longer list is left whole (a filter drops it, not this)."""
    missing = F.greatest(F.lit(length) - F.size(tokens), F.lit(0))
    return F.concat(F.array_repeat(pad, missing), tokens)


def pad_left_mask(tokens: Column, length: int) -> Column:
    missing = F.greatest(F.lit(length) - F.size(tokens), F.lit(0))
    return F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(tokens)))


def at_most(tokens: Column, limit: int) -> Column:
    return F.size(tokens) <= limit


def at_least(tokens: Column, limit: int, minimum: int) -> Column:
    """Length after truncation at ``limit`` is at least ``minimum``."""
    return F.least(F.size(tokens), F.lit(limit)) >= minimum


def shift_pairs(values: Column, labels: Column) -> Column:
    """``values[t]`` with ``labels[t + 1]``; the last position falls out.

    Works inside the row, so no window and no shuffle is needed.
    """
    last = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(
        F.slice(values, F.lit(1), last),
        F.slice(labels, F.lit(2), last),
        lambda v, n: F.struct(v.alias("value"), n.alias("next_label")),
    )


def active_positions(values: Column, labels: Column, ignore: int = -100) -> Column:
    return F.filter(shift_pairs(values, labels), lambda p: p["next_label"] != ignore)


def keep_tokens(df: DataFrame, name: str, tokens: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Add the token list and drop the rows whose list fails ``keep``.

    A plain filter would be pushed below the projection and tokenise every text
    twice; here the list is made once and the generator emits it or nothing.
    """
    return df.select("*", F.explode(F.filter(F.array(tokens), keep)).alias(name))
