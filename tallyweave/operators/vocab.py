"""Corpus token counts, ids and per-token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.encoding import Encoder
from tallyweave.operators.lookup import HEAD_ROWS
from tallyweave.operators.order import sorted_rows


def token_rows(df: DataFrame, tokens: Column, *keys: str, pos: str = "pos") -> DataFrame:
    """One row per token: keys, position from 0, token."""
    return df.select(*keys, F.posexplode(tokens).alias(pos, "token"))


def token_counts(df: DataFrame, tokens: Column, *groups: str) -> DataFrame:
    """Counts per token (and group); combined on the map side, so a common token is
    one row per task before the shuffle."""
    return (
        df.select(*groups, F.explode(tokens).alias("token"))
        .groupBy(*groups, "token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """``(token, cnt, id)``: id by falling count, ties by the token's hash.

    ``counts`` is read twice and should be materialised.
    """
    rows = counts.withColumn("__h", F.md5("token"))
    return sorted_rows(rows, [-F.col("cnt"), F.col("__h"), F.col("token")], "id").drop("__h")


def with_nll(counts: DataFrame) -> DataFrame:
    """``-ln(cnt / total)`` per token."""
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.withColumn("nll", -F.ln(F.col("cnt") / total))


def token_ids(
    df: DataFrame, key: str, tokens: Column, vocab: DataFrame, head_rows: int = HEAD_ROWS, unknown_id: int = -1
) -> DataFrame:
    """``(key, input_ids)``: the ordered id list of every row; ``key`` identifies a row.

    A token that the vocabulary lacks becomes ``unknown_id``; a row without tokens has an
    empty list.
    """
    return Encoder(vocab, unknown_id, head_rows)(df, tokens, "input_ids", [key], [key])
