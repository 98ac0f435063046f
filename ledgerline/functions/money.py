"""Exact money aggregates.

Double sums depend on addition order, which a distributed engine does not fix.
Every amount is cut, without loss, into three integers: its whole part and two
52-bit parts behind the point. Their decimal sums are exact in any order, and
the whole sum is rounded once, to the nearest double (ties to even): the value
that ``math.fsum`` gives. Amounts beyond that grid (from 2^63 up, below 2^-52, or
not finite) go through a plain double sum beside it: none is rejected or lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An amount lies on the grid if it is 0 or its size is from GRID_FROM to below GRID_BELOW.
GRID_FROM, GRID_BELOW = 2.0 ** -52, 2.0 ** 63
PART = 2 ** 52
#: Doubles below this hold every integer.
INTEGERS = 2 ** 53
#: The parts of an amount; their sums are decimal(38,0), room for 10^19 rows of any size.
PART_TYPE = "decimal(28,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _nearest(whole: Column, upper: Column, lower: Column) -> Column:
    """whole + upper / 2^52 + lower / 2^104 (integers of any sign) as the nearest double."""
    up = upper + _div(lower, PART)
    integer = whole + _div(up, PART)
    w = integer.cast("double")
    u = (up % F.lit(PART)).cast("double") / F.lit(float(PART))
    low = (lower % F.lit(PART)).cast("double") / F.lit(float(PART) ** 2)
    s = w + u
    # what the addition lost: a multiple of 2^-52, as every point half-way between two doubles then is, so
    # of the last part, smaller than that, only the sign decides
    lost = u - (s - w)
    tail = F.when(lost == 0, low).otherwise(lost + F.signum(low) * F.lit(2.0 ** -53))
    beyond = (integer + (F.signum(u + low) * F.lit(0.5)).cast("decimal(2,1)")).cast("double")
    return F.when(F.abs(integer) >= INTEGERS, beyond).when(lower == 0, s).otherwise(s + tail)


def exact_sum(c) -> Column:
    x = _c(c).cast("double")
    on_grid = (x == 0) | ((F.abs(x) >= GRID_FROM) & (F.abs(x) < GRID_BELOW))
    whole = F.when(on_grid, x).try_cast("long")
    behind = (x - whole) * F.lit(float(PART))
    upper = behind.try_cast("long")
    lower = ((behind - upper) * F.lit(float(PART))).try_cast("long")
    exact = _nearest(*[F.sum(p.cast(PART_TYPE)) for p in (whole, upper, lower)])
    rest = F.sum(F.when(~on_grid, x))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def exact_avg(c) -> Column:
    """Exact sum divided by the row count, in double."""
    return exact_sum(c) / F.count(F.lit(1))
