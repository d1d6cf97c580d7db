"""Occupation tier and industry sector classification (Column expressions)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingscope.functions.names import strip_ws

# SOC major groups that make an occupation "core".
CORE_SOC_MAJOR_GROUPS = ("11", "13")

# Title patterns for the "adjacent" tier (case-insensitive regex,
# only the project-management pattern is anchored) and the exclusions.
ADJACENT_TITLE_PATTERNS = (
    "business intelligence analyst",
    "information technology project manager",
    "^project management specialist",
    "operations research analyst",
    "product manager",
    "technical program manager",
    "sales engineer",
    "market research analyst",
    "public relations specialist",
    "technical writer",
)
ADJACENT_EXCLUSIONS = (
    "research scientist",
    "data scientist",
)

ADJACENT_REGEX = "|".join(ADJACENT_TITLE_PATTERNS)
EXCLUSION_REGEX = "|".join(ADJACENT_EXCLUSIONS)

# NAICS 2-digit prefix -> sector name.
NAICS_SECTOR_NAMES = {
    "11": "Agriculture, Forestry, Fishing and Hunting",
    "21": "Mining, Quarrying, and Oil and Gas Extraction",
    "22": "Utilities",
    "23": "Construction",
    "31": "Manufacturing",
    "32": "Manufacturing",
    "33": "Manufacturing",
    "42": "Wholesale Trade",
    "44": "Retail Trade",
    "45": "Retail Trade",
    "48": "Transportation and Warehousing",
    "49": "Transportation and Warehousing",
    "51": "Information",
    "52": "Finance and Insurance",
    "53": "Real Estate and Rental and Leasing",
    "54": "Professional, Scientific, and Technical Services",
    "55": "Management of Companies and Enterprises",
    "56": "Administrative and Support and Waste Management Services",
    "61": "Educational Services",
    "62": "Health Care and Social Assistance",
    "71": "Arts, Entertainment, and Recreation",
    "72": "Accommodation and Food Services",
    "81": "Other Services (except Public Administration)",
    "92": "Public Administration",
}
UNKNOWN_SECTOR = "Unknown / Unclassified"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mba_tier(code, title) -> Column:
    """core (SOC prefix 11/13) > adjacent (title pattern, no exclusion) > excluded."""
    major = F.substring(_c(code), 1, 2)
    t = F.coalesce(_c(title), F.lit(""))
    is_core = major.isin(*CORE_SOC_MAJOR_GROUPS)
    is_adjacent = t.rlike("(?i)" + ADJACENT_REGEX) & ~t.rlike("(?i)" + EXCLUSION_REGEX)
    return F.when(is_core, "core").when(is_adjacent, "adjacent").otherwise("excluded")


def _sector_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(NAICS_SECTOR_NAMES.items())])


def naics_sector(code) -> Column:
    prefix = F.substring(strip_ws(_c(code)), 1, 2)
    return F.coalesce(F.try_element_at(_sector_map(), prefix), F.lit(UNKNOWN_SECTOR))


def bucket_other(col, allowed) -> Column:
    """Values outside ``allowed`` (including null) become 'Other'."""
    return F.when(F.coalesce(_c(col).isin(*allowed), F.lit(False)), _c(col)).otherwise(F.lit("Other"))
