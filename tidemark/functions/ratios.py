"""Shares that are unknown, not zero, when nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """A double (below 2^36, not negative) rounded at `places` by its exact binary value; only exact halves go to even.

    Rounding the printed decimal instead moves values such as 1/160, whose double lies above its print.
    The double is cut in three parts that multiply without a rounding error, so the side of the half
    it lies on is known exactly.
    """
    scale = 2 * 10**places
    halves = F.rint(value * scale)
    high = F.floor(value * 2.0**26) / F.lit(2.0**26)
    mid = F.floor((value - high) * 2.0**50) / F.lit(2.0**50)
    low = value - high - mid
    beyond = (high * scale - halves) + mid * scale + low * scale
    whole = (
        F.when(halves % 2 == 0, halves / 2)
        .when(beyond > 0, (halves + 1) / 2)
        .when(beyond < 0, (halves - 1) / 2)
        .otherwise(F.rint(halves / 2))
    )
    return whole / F.lit(float(10**places))


def share(part: Column | str, whole: Column | str, places: int = 4) -> Column:
    """part / whole rounded at `places`; NULL where `whole` is 0."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return rounded(F.try_divide(part.cast("double"), whole.cast("double")), places)
