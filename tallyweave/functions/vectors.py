"""Row-local vector expressions: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row; inside a lambda it would run per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(v: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(v, lambda x: x.cast("double") / F.lit(float(temperature)))

    def minus_norm(y: Column) -> Column:
        norm = F.ln(F.aggregate(y, F.lit(0.0), lambda acc, x: acc + F.exp(x)))
        return _bind(norm, lambda n: F.transform(y, lambda x: x - n))

    def minus_top(s: Column) -> Column:
        return _bind(F.array_max(s), lambda top: F.transform(s, lambda x: x - top))

    return _bind(_bind(scaled, minus_top), minus_norm)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(v, temperature), lambda x: F.exp(x))


def masked_sequence_mean(values: Column, mask: Column) -> Column:
    """``sum(values[t] * mask[t + 1])`` over the sequence's length, last position out.

    With per-position divergences as values this is the length-normalised, masked
    form of a row's divergence.
    """
    last = F.greatest(F.size(values) - 1, F.lit(0))
    products = F.zip_with(
        F.slice(values, F.lit(1), last), F.slice(mask, F.lit(2), last), lambda v, m: v.cast("double") * m
    )
    return _total(products) / F.size(values)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(_total(squares))
