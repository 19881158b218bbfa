"""Exact sums, rounding, ratios, bands.

Money is summed in ten-thousandths as integers. The total then does not depend on the
order in which partitions arrive, so a retried task or another partition count cannot move
a customer across a rank or a threshold. Rows are added in two long columns, millions of units
and the rest, inside whole-stage codegen; only the finished totals become decimals, so no total
of rows that fit a double overflows.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 10_000
PART = 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(c) -> Column:
    """A double as a whole number of ten-thousandths."""
    return F.floor(_col(c) * F.lit(float(UNIT)) + F.lit(0.5)).cast("bigint")


def sum_units(c) -> Column:
    """Exact total of a double column in ten-thousandths, as decimal(38,0)."""
    amount = units(c)
    rest = F.pmod(amount, F.lit(PART))
    millions = F.sum(F.call_function("div", amount - rest, F.lit(PART)))
    return (millions.cast("decimal(28,0)") * F.lit(Decimal(PART)) + F.sum(rest).cast("decimal(19,0)")).cast("decimal(38,0)")


def from_units(c) -> Column:
    return _col(c).cast("double") / F.lit(float(UNIT))


def exact_sum(c) -> Column:
    return from_units(sum_units(c))


def half_up(c, digits: int) -> Column:
    """Round half away from zero with plain double arithmetic."""
    c = _col(c)
    scale = F.lit(float(10**digits))
    return F.signum(c) * F.floor(F.abs(c) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def ratio(numerator, denominator) -> Column:
    """Division giving NULL for a zero or missing divisor."""
    return F.try_divide(
        _col(numerator).cast("double"), _col(denominator).cast("double")
    )


def percent(numerator, denominator, digits: int | None = 1) -> Column:
    value = ratio(numerator, denominator) * F.lit(100.0)
    return value if digits is None else half_up(value, digits)


def growth(now, before, digits: int | None = 1) -> Column:
    """Change against an earlier value in percent; NULL when there is no earlier value."""
    return percent(_col(now) - _col(before), before, digits)


def band(c, cuts, labels, closed: str = "left") -> Column:
    """Label of the interval a value falls in.

    ``cuts`` ascend and ``labels`` has one more entry. With ``closed="left"`` a value equal
    to a cut belongs to the upper interval, with ``"right"`` to the lower one.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("one more label than cuts is needed")
    c = _col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        below = c < F.lit(cut) if closed == "left" else c <= F.lit(cut)
        out = out.when(below, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def band_between(c, low, high, labels) -> Column:
    """Three labels for below ``low``, between both bounds (inclusive), above ``high``."""
    c = _col(c)
    return (
        F.when(c < F.lit(low), F.lit(labels[0]))
        .when(c <= F.lit(high), F.lit(labels[1]))
        .when(c > F.lit(high), F.lit(labels[2]))
    )
