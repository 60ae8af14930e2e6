"""Integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Integral quotient as bigint; ``floor(a / b)`` would go through a double."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint") if isinstance(b, int) else b.cast("bigint"))
