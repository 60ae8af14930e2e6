"""User functions. A column expression comes first; these are for the rest."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Series -> Series, or several Series -> Series.
SeriesFn = Callable[..., pd.Series]
#: Bytes of rows that a batch function gets at a time.
PIECE_BYTES = 4 << 20


def row_map(df: DataFrame, name: str, fn: Column | SeriesFn, inputs: list[str], returns: str) -> DataFrame:
    """Add a column from an expression, or from a vectorised function."""
    if isinstance(fn, Column):
        return df.withColumn(name, fn)

    @F.pandas_udf(returns)
    def apply(*series: pd.Series) -> pd.Series:
        return fn(*series)

    return df.withColumn(name, apply(*inputs))


def pieces(pdf: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch in order, about ``most`` bytes at a time; a longer row is a piece of its own."""
    size = np.zeros(len(pdf), np.int64)
    for _, column in pdf.items():
        size += np.array([sys.getsizeof(x) for x in column], np.int64)
    start = 0
    for end in [*(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), len(pdf)]:
        yield pdf.iloc[start:end]
        start = end


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Batch function; it may change the row count.

    A batch holds thousands of rows of any length, and what a function makes of them can be
    many times as much; so it gets pieces of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in pieces(pdf, piece_bytes):
                yield fn(piece)

    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, fn: Column | SeriesFn, inputs: list[str]) -> DataFrame:
    """Keep rows by an expression (pushed to the scan if possible) or a function."""
    if isinstance(fn, Column):
        return df.where(fn)

    @F.pandas_udf("boolean")
    def keep(*series: pd.Series) -> pd.Series:
        return fn(*series)

    return df.where(keep(*inputs))


def tokenizer_hook(make_encode: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """A real tokeniser as a column function, for every operator that takes ``tokenizer=``."""

    @F.pandas_udf("array<int>")
    def encode_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encode()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else encode(t))

    return lambda c: encode_all(c)
