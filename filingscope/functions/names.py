"""Employer-name normalisation as native Column expressions (no UDF).

``clean_name``: upper-case, comma -> space, drop . ' " ( ), collapse
whitespace, trim.  ``core_key``: drop a leading THE when more tokens follow,
then strip trailing legal-suffix tokens while more than one token remains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-entity suffix tokens stripped from the end of a name.
LEGAL_SUFFIX_TOKENS = (
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP",
    "CORPORATION", "CO", "COMPANY", "PLLC", "PC", "PA", "PLC",
)

SUFFIX_PATTERN = "( (" + "|".join(LEGAL_SUFFIX_TOKENS) + "))+$"
LEADING_THE_PATTERN = "^THE (.)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Strip leading/trailing Unicode whitespace (not just the space char)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def clean_name(col) -> Column:
    c = F.upper(_c(col))
    c = F.regexp_replace(c, ",", " ")
    c = F.regexp_replace(c, "[.'\"()]", "")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(c)


def core_key_of_clean(cleaned) -> Column:
    c = F.regexp_replace(_c(cleaned), LEADING_THE_PATTERN, "$1")
    return F.regexp_replace(c, SUFFIX_PATTERN, "")


def core_key(col) -> Column:
    """core_key(clean_name(col)) — the grouping key used for every name match."""
    return core_key_of_clean(clean_name(col))


def is_all_caps(col) -> Column:
    return _c(col) == F.upper(_c(col))
