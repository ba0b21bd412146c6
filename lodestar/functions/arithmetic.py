"""Integer arithmetic with stated meaning: no silent wrap-around, truncating division, sums that start at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def mul(a: Column | str | int, b: Column | str | int) -> Column:
    """Product in 64 bits; overflow beyond raises under ANSI rules."""
    return _col(a).cast("long") * _col(b)


def div(a: Column | str, b: Column | str) -> Column:
    """Quotient truncated toward zero; division by zero raises under ANSI rules."""
    return F.call_function("div", _col(a), _col(b))


def sum0(c: Column | str) -> Column:
    """SUM that is 0, not NULL, over no rows."""
    return F.coalesce(F.sum(_col(c)), F.lit(0).cast("long"))
