"""Text cleanup on raw export cells and keyword matching on titles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens a CSV loader treats as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Fixed value: a cell that a spreadsheet marks as text.
EXCEL_TEXT_WRAP = r'^="(.*)"$'


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unwrap_text(col) -> Column:
    """Whole-cell ``="value"`` -> ``value``; inner '=' untouched.  The pattern runs only on cells that begin like one."""
    c = _c(col)
    return F.when(F.startswith(c, F.lit('="')), F.regexp_replace(c, EXCEL_TEXT_WRAP, "$1")).otherwise(c)


def null_token(col, tokens=NULL_TOKENS) -> Column:
    c = _c(col)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def keyword_pattern(keywords) -> str:
    """A pattern that finds any of the keywords, each a regular expression of its own.

    A keyword is taken word by word: whatever white space stands between its words, any stands between them in a
    title, and white space around it is ignored.  A keyword's own alternatives stay inside it.  Keywords without a
    word are left out; none at all give the empty pattern, which every title holds.
    """
    whole = []
    for keyword in keywords:
        words = keyword.split()
        if words:
            whole.append("(?:" + r"\s+".join(words) + ")")
    return "|".join(whole)


def keyword_match(keywords, cols, available=None) -> Column:
    """Any keyword (regex, case-insensitive) in any of ``cols``.

    An empty keyword list matches every row; columns missing from
    ``available`` are skipped.
    """
    cols = [c for c in cols if available is None or c in available]
    if not cols:
        return F.lit(False)
    pattern = "(?i)" + keyword_pattern(keywords)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).rlike(pattern) for c in cols])


def literal_contains(col, text: str) -> Column:
    """Case-insensitive literal substring test; null -> False."""
    return F.coalesce(F.lower(_c(col)).contains(text.lower()), F.lit(False))
