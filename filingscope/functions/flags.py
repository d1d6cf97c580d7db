"""Boolean and label columns derived from filing fields (never null)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position-count columns behind the three hire definitions.
NEW_HIRE_COLUMNS = ("NEW_EMPLOYMENT", "CHANGE_EMPLOYER", "NEW_CONCURRENT_EMPLOYMENT")
NEW_OR_TRANSFER_COLUMNS = ("NEW_EMPLOYMENT", "CHANGE_EMPLOYER")
NEW_ONLY_COLUMNS = ("NEW_EMPLOYMENT",)

# Web search link format for the leaderboard.
SEARCH_URL_PREFIX = "https://www.google.com/search?q="


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def positions_sum(*cols) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])


def new_hire_flag(*cols) -> Column:
    return positions_sum(*(cols or NEW_HIRE_COLUMNS)) > 0


def yes_flag(col, value: str = "Y") -> Column:
    """col == value, with null treated as False."""
    return F.coalesce(_c(col) == F.lit(value), F.lit(False))


def external_hire_flag(col="OTHER_REQ_IS_FW_CURRENTLY_WRK") -> Column:
    return yes_flag(col, "N")


def decided(status, statuses) -> Column:
    return F.coalesce(_c(status).isin(*statuses), F.lit(False))


def certified(status, statuses, denied: str = "Denied") -> Column:
    return decided(status, statuses) & ~_c(status).eqNullSafe(F.lit(denied))


def not_denied(status, denied: str = "Denied") -> Column:
    """Null-safe ``status != denied`` (null counts as not denied)."""
    return ~_c(status).eqNullSafe(F.lit(denied))


def yes_label(flag) -> Column:
    return F.when(_c(flag), F.lit("Yes")).otherwise(F.lit(""))


def url_quote_plus(col) -> Column:
    """Form-style URL encoding: space -> '+', '~' kept, '*' escaped."""
    enc = F.url_encode(_c(col))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_link(employer, roles) -> Column:
    text = F.concat_ws(" ", _c(employer), _c(roles), F.lit("careers"))
    return F.concat(F.lit(SEARCH_URL_PREFIX), url_quote_plus(text))
