"""Date parsing for raw exports and the federal fiscal calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col) -> Column:
    """M/d/yy, then M/d/yyyy, then ISO; anything else is null.

    Two-digit years pivot like C's strptime: 69-99 -> 19xx, 00-68 -> 20xx.  A text is parsed by the one format that its
    separators allow (a failed parse costs many times a good one), a two-digit year after its century is put before it.
    """
    s = F.trim(_c(col).cast("string"))
    year = F.right(s, F.lit(2))
    whole = F.concat(F.substring(s, F.lit(1), F.length(s) - 2), F.when(year >= "69", F.lit("19")).otherwise(F.lit("20")), year)
    slashes = F.when(F.substring(s, -3, 1) == "/", whole).otherwise(s)
    return F.when(F.contains(s, F.lit("/")), F.try_to_date(slashes, "M/d/yyyy")).otherwise(F.try_to_date(s, "yyyy-MM-dd"))


def iso_date(col) -> Column:
    return F.try_to_date(_c(col).cast("string"), "yyyy-MM-dd")


def fiscal_basis(decision, received) -> Column:
    return F.coalesce(_c(decision), _c(received))


def fiscal_year(d) -> Column:
    """Fiscal year starting Oct 1: the calendar year of d + 3 months."""
    return F.year(F.add_months(_c(d), 3)).cast("int")


def fiscal_quarter(d) -> Column:
    return F.quarter(F.add_months(_c(d), 3)).cast("int")
