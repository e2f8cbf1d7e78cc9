"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float((1 << 27) + 1)


def fixed(c: Column, digits: int) -> Column:
    """c with that many digits after the point, rounded from its exact binary value, true ties to even.

    The product with 10**digits is kept as a double and its exact error, so that what only looks like a tie in decimal
    (0.265) goes to its side, and what is one (0.125) goes to the even digit. For sizes under 2**53 / 10**digits.
    """
    scale = 10.0**digits
    if digits > 7:
        raise ValueError("at most 7 digits")
    x = F.abs(c.cast("double"))

    def units(x: Column) -> Column:
        product = x * scale
        big = x * _SPLIT - (x * _SPLIT - x)
        error = (big * scale - product) + (x - big) * scale
        whole = F.floor(product).cast("bigint")
        part = product - whole.cast("double")
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return whole + F.when(up, 1).otherwise(0)

    n = F.transform(F.array(x), units)[0]
    unit = F.lit(10**digits).cast("bigint")
    rest = n % unit
    shown = F.floor(n / unit).cast("bigint").cast("string") if digits else n.cast("string")
    whole = F.concat(shown, F.lit("."), F.lpad(rest.cast("string"), digits, "0")) if digits else shown
    return F.when(c < 0, F.concat(F.lit("-"), whole)).otherwise(whole)
