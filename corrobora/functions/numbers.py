"""Column functions over numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coverage levels from least to most.
LEVELS = ["none", "partial", "substantial", "full"]
GAPS = ["none", "partial"]


def clamp(c: Column, low: float, high: float) -> Column:
    """``c`` within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clamp_int(c: Column, low: int, high: int) -> Column:
    """Truncates towards zero, takes what is no finite number for ``low``, then clamps."""
    number = c.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(bad, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), whole))).cast("int")


def half_up(c: Column, scale: int = 0) -> Column:
    """floor(x * 10^scale + 1/2) / 10^scale on doubles."""
    factor = float(10**scale)
    return F.floor(c * factor + 0.5) / factor if scale else F.floor(c + 0.5)


def to_fixed(c: Column, scale: int = 2) -> Column:
    """The nearest multiple of 10^-scale to the double's exact value, halves up, for values that are not negative.

    Rounding in decimal notation goes by the shortest decimal, and x * 10^scale is rounded itself: both give 0.73
    for 0.725, whose double lies below. So the product is taken with its error, which is exact: the halves of x
    have at most 27 digits each, and so do their products with 10^scale.
    """
    if not 0 <= scale <= 7:
        raise ValueError("scale must be 0 to 7")
    factor = F.lit(float(10**scale))
    x = c.cast("double")
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * factor
    error = (high * factor - product) + (x - high) * factor
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & (error >= 0))
    return (whole + F.when(up, 1).otherwise(0)) / factor


def percent(part: Column, total: Column) -> Column:
    """A whole percentage, halves up; 0 of nothing."""
    return F.when(total > 0, half_up(part / total * 100)).otherwise(F.lit(0)).cast("int")


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_normalised(v: Column) -> Column:
    """Unit length in 32-bit floats; a zero or non-finite norm gives zeros."""
    norm = F.sqrt(squares(v))
    good = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(good, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(F.transform(v, lambda x: F.lit(0.0).cast("float")))


def is_gap(coverage: Column) -> Column:
    return F.coalesce(coverage.isin(*GAPS), F.lit(False))


def level(coverage: Column) -> Column:
    """The coverage's place among the levels; unknown ones count as 0."""
    place = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), coverage)
    return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")
