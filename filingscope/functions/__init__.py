"""Column-level functions: all native Spark expressions, no Python UDFs."""

from filingscope.functions.classify import bucket_other, mba_tier, naics_sector
from filingscope.functions.dates import fiscal_quarter, fiscal_year, iso_date, parse_date
from filingscope.functions.flags import (
    certified,
    decided,
    external_hire_flag,
    new_hire_flag,
    not_denied,
    positions_sum,
    search_link,
    yes_flag,
    yes_label,
)
from filingscope.functions.names import clean_name, core_key, strip_ws
from filingscope.functions.text import keyword_match, null_token, unwrap_text
from filingscope.functions.wages import annual_wage, bounded

__all__ = [
    "annual_wage", "bounded", "bucket_other", "certified", "clean_name", "core_key", "decided",
    "external_hire_flag", "fiscal_quarter", "fiscal_year", "iso_date", "keyword_match", "mba_tier",
    "naics_sector", "new_hire_flag", "not_denied", "null_token", "parse_date", "positions_sum",
    "search_link", "strip_ws", "unwrap_text", "yes_flag", "yes_label",
]
