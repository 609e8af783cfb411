"""Rounding to two places by the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1, which splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def round2(value: Column) -> Column:
    """Round to two decimals the way Python's ``round(x, 2)`` does.

    Spark's ``round`` looks at the shortest decimal text, so 0.835 (in binary a
    little below the tie) goes up to 0.84; here it goes down to 0.83. The tie
    is decided from the error-free product ``x * 1000 = product + error``.
    """
    size = F.abs(value)
    product = size * 1000.0
    scaled = size * _SPLIT
    high = scaled - (scaled - size)
    low = size - high
    error = (high * 1000.0 - product) + low * 1000.0
    nearest = F.rint(product)
    beyond = (product - nearest) + error
    floor = F.floor(nearest / 10)
    tie = (
        F.when(beyond > 0, floor + 1)
        .when(beyond < 0, floor)
        .otherwise(floor + F.pmod(floor, F.lit(2)))
        / 100.0
    )
    return F.signum(value) * F.when(F.pmod(nearest, F.lit(10)) == 5, tie).otherwise(
        F.round(size, 2)
    )


def float_text(value: Column) -> Column:
    """A double as Python prints it.

    The digits are Spark's; a decimal point is always there from 1e-4 to below
    1e16, and the exponent outside has a sign and two digits.
    """
    java = F.abs(value).cast("string")
    mantissa = F.substring_index(java, "E", 1)
    written = F.when(F.contains(java, F.lit("E")), F.substring_index(java, "E", -1).try_cast("int")).otherwise(0)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    first, rest = F.left(digits, F.lit(1)), F.substr(digits, F.lit(2))
    size = F.length(digits)
    whole = F.when(size <= written + 1, F.concat(F.rpad(digits, written + 1, F.lit("0")), F.lit(".0"))).otherwise(
        F.concat(F.left(digits, written + 1), F.lit("."), F.substr(digits, written + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -written - 1), digits)
    exponent = F.concat(
        F.lit("e"), F.when(written < 0, "-").otherwise("+"),
        F.lpad(F.abs(written).cast("string"), F.greatest(F.lit(2), F.length(F.abs(written).cast("string"))), F.lit("0")),
    )
    apart = F.concat(first, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), exponent)
    text = (
        F.when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), "inf")
        .when(~F.contains(java, F.lit("E")), java)
        .when((written >= 0) & (written < 16), whole)
        .when((written < 0) & (written >= -4), small)
        .otherwise(apart)
    )
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def percent(value: Column) -> Column:
    """``0.915`` to ``92%``; halves go up."""
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))
