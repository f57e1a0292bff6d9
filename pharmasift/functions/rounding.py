"""Decimal rounding of doubles, ties decided on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def half_even(c: Column, digits: int) -> Column:
    """Round to `digits` decimals the way a correctly rounded decimal conversion does.

    Spark's `round` works on the shortest decimal text of a double, so 0.22415 goes
    up although its binary value lies below the tie. Here x*10**d is compared with
    the tie k + 1/2 without rounding error: x is split into two halves whose
    products with 2*10**d are exact. Exact ties go to the even neighbour.
    """
    x = c.cast("double")
    scale = float(10**digits)
    twice = 2.0 * scale
    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    low = x - high
    k = F.floor(x * F.lit(scale)).cast("double")
    beyond_tie = (high * F.lit(twice) - (k * F.lit(2.0) + F.lit(1.0))) + low * F.lit(twice)
    even_step = F.pmod(k, F.lit(2.0))
    step = F.when(beyond_tie > 0, F.lit(1.0)).when(beyond_tie < 0, F.lit(0.0)).otherwise(even_step)
    rounded = (k + step) / F.lit(scale)
    # beyond this the spacing of doubles is wider than the last digit asked for
    return F.when(F.abs(x * F.lit(scale)) >= float(2**53), x).otherwise(rounded)
