"""Wage annualisation and plausibility bounds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingscope.spec import WAGE_HIGH, WAGE_LOW

# Pay unit -> periods per year.
PAY_UNIT_MULTIPLIERS = {
    "Hour": 2080,
    "Week": 52,
    "Bi-Weekly": 26,
    "Month": 12,
    "Year": 1,
}


def _unit_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(PAY_UNIT_MULTIPLIERS.items())])


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def annual_wage(amount, unit) -> Column:
    """amount x periods-per-year; an unknown unit yields null."""
    return _c(amount).cast("double") * F.try_element_at(_unit_map(), _c(unit))


def bounded(col, lo: float = WAGE_LOW, hi: float = WAGE_HIGH) -> Column:
    """Keep values strictly inside (lo, hi); others become null."""
    c = _c(col)
    return F.when((c > F.lit(lo)) & (c < F.lit(hi)), c)


def round_half_up(col, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain double arithmetic.

    Used for every presented rounding so that two engines given the same
    double produce the same rounded double (decimal-string rounding and
    scaled-double rounding disagree on ties).
    """
    scale = float(10 ** digits)
    return F.floor(_c(col) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
