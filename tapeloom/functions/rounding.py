"""Rounding and division that agree with IEEE doubles read exactly, not with their printed digits.

``round``/``bround`` work on the shortest decimal text of a double, so 0.505 is a tie for them although
the stored number is slightly above it. Prices times 1.01 hit such ties often, hence the exact form.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def round_exact(x: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits to the stored double; half-even only on a true tie."""
    scale = float(10 ** digits)
    double_scale = 2.0 * scale
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    low = x - high
    product = x * F.lit(double_scale)
    error = (high * F.lit(double_scale) - product) + low * F.lit(double_scale)
    whole = F.floor(product)
    on_tie = (product == whole) & (F.pmod(whole, F.lit(2)) == 1)
    down = F.floor(product / 2)
    up = down + 1
    even = F.when(F.pmod(down, F.lit(2)) == 0, down).otherwise(up)
    tie = F.when(error > 0, up).when(error < 0, down).otherwise(even)
    return F.when(on_tie, tie).otherwise(F.floor((product + 1) / 2)).cast("double") / F.lit(scale)


def floor_div(a: Column, b: Column) -> Column:
    """Largest whole number of times b fits into a, by remainder (a/b may round up to a whole number)."""
    return F.round((a - a % b) / b).cast("bigint")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def truthy(x: Column) -> Column:
    """Zero counts as missing."""
    return F.when(x != 0, x)
