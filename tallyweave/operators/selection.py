"""Rows between two ranks of a total order, without numbering or sorting the table.

A row's place in the order is a text code of fixed-width hex digits. Counts per prefix of a
code, at most 65,536 of them at once, tell which prefix holds a rank; a prefix with many
rows is counted again by its next digits. The few rows that share the last prefix are
looked at, and the rank's own row becomes a threshold. Taking the rows is then a filter, so
only these are rendered, and the same path serves a sample of any size.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.seeds import order_hash
from tallyweave.sources.scratch import materialise

#: Hex digits by which rows are counted at once: at most 16^4 counts.
DIGITS = 4
#: Rows with one prefix that are looked at one by one.
HELD = 4096


def hash_code(seed: int | str, keys: Sequence[str]) -> Column:
    """A seeded random order of unique keys."""
    return order_hash(seed, *[F.col(k) for k in keys])


def natural_code(key: str) -> Column:
    """The order of an integer key, a null first: its 64 bits above the least long."""
    shifted = F.col(key).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.coalesce(F.lpad(F.lower(F.hex(shifted)), 16, "0"), F.lit(""))


def _prefixes(codes: DataFrame, start: str, ranks: Sequence[int], held: int) -> list[tuple[str, int]]:
    """For each rank a prefix with at most ``held`` rows, and the rank among them."""
    known: dict[str, list] = {}

    def counts(prefix: str) -> list:
        if prefix not in known:
            rows = codes.where(F.col("__code").startswith(prefix)) if prefix else codes
            part = F.substring("__code", 1, len(prefix) + DIGITS).alias("p")
            known[prefix] = sorted(rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
        return known[prefix]

    def narrowed(prefix: str, rank: int) -> tuple[str, int]:
        for part, n in counts(prefix):
            if rank < n:
                break
            rank -= n
        if n <= held:
            return part, rank
        if part == prefix:
            raise ValueError("the keys do not identify a row")
        return narrowed(part, rank)

    return [narrowed(start, rank) for rank in ranks]


def _rows_at(codes: DataFrame, keys: Sequence[str], start: str, ranks: Sequence[int], held: int) -> list:
    """(code, *keys) of the rows with these ranks, from 0."""
    found = _prefixes(codes, start, ranks, held)
    near = codes.where(F.substring("__code", 1, len(found[0][0])) == found[0][0])
    for prefix, _ in found[1:]:
        near = near.unionAll(codes.where(F.substring("__code", 1, len(prefix)) == prefix))
    # At most ``held`` rows for each rank. A null sorts before every value.
    rows = sorted(set(near.select("__code", *keys).collect()), key=lambda r: [(v is not None, v) for v in r])
    return [[r for r in rows if r["__code"].startswith(prefix)][rank] for prefix, rank in found]


def between(codes: DataFrame, keys: Sequence[str], skip: int, n: int, held: int = HELD) -> Column | None:
    """A condition on ``__code`` and ``keys`` that holds for ranks ``skip`` to ``skip + n - 1``; null if there are none.

    ``codes`` has ``__code`` and the keys, which together identify a row, and should be materialised.
    """
    ends = codes.agg(F.count(F.lit(1)).alias("n"), F.min("__code").alias("a"), F.max("__code").alias("b")).first()
    if n <= 0 or skip >= ends["n"]:
        return None
    ranks = ([skip] if skip > 0 else []) + ([skip + n - 1] if skip + n < ends["n"] else [])
    if not ranks:
        return F.lit(True)
    # Digits that all codes share tell nothing apart.
    rows = _rows_at(codes, keys, os.path.commonprefix([ends["a"], ends["b"]]), ranks, held)
    place = F.struct("__code", *keys)
    kinds = codes.select(place.alias("p")).schema["p"].dataType

    def literal(row) -> Column:
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields])

    condition = F.lit(True)
    if skip > 0:
        condition = condition & (F.col("__code") >= rows[0]["__code"]) & (place >= literal(rows[0]))
    if skip + n < ends["n"]:
        condition = condition & (F.col("__code") <= rows[-1]["__code"]) & (place <= literal(rows[-1]))
    return condition


def take_ranks(
    df: DataFrame, code: Column, keys: Sequence[str], n: int, skip: int = 0, fitting: Column | None = None, held: int = HELD
) -> DataFrame:
    """Rows of ``df`` that fit with ranks ``skip`` to ``skip + n - 1`` among those, or as many as there are.

    ``keys`` identify a row. ``df`` is read twice: for the narrow codes of the rows that
    fit, and for the rows that are taken, where the rank is tested before the fit.
    """
    fit = F.lit(True) if fitting is None else fitting
    codes = materialise(df.where(fit).select(code.alias("__code"), *keys), "codes")
    condition = between(codes, keys, skip, n, held)
    if condition is None:
        return df.where(F.lit(False))
    return df.withColumn("__code", code).where(condition & fit).drop("__code")


def sample_rows(
    df: DataFrame, keys: Sequence[str], seed: int | str, n: int, skip: int = 0, fitting: Column | None = None
) -> DataFrame:
    """``n`` rows in a seeded random order, after ``skip`` rows of that order."""
    return take_ranks(df, hash_code(seed, keys), keys, n, skip, fitting)


def first_rows(df: DataFrame, key: str, n: int, skip: int = 0, fitting: Column | None = None) -> DataFrame:
    """``n`` rows in the order of a unique integer key, after ``skip`` rows."""
    return take_ranks(df, natural_code(key), [key], n, skip, fitting)
