"""Column bindings and business constants for the two filing datasets.

Every operator takes a ``FilingsSpec`` instead of hard-coded column names, so
the same code runs on LCA-shaped and PERM-shaped tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FilingsSpec:
    name: str
    case_col: str
    status_col: str
    employer_col: str
    soc_code_col: str
    occupation_col: str
    naics_col: str
    state_col: str
    wage_amount_col: str
    wage_unit_col: str
    decided_statuses: tuple[str, ...]
    denied_status: str = "Denied"
    hire_flag_col: str = "IS_NEW_HIRE"
    title_cols: tuple[str, ...] = field(default=())


# Fixed values that must equal the source application's definitions.
DECIDED_LCA = ("Certified", "Certified - Withdrawn", "Denied")
DECIDED_PERM = ("Certified", "Certified - Expired", "Denied")
WAGE_LEVELS = ("I", "II", "III", "IV", "Unspecified")
TIERS = ("core", "adjacent", "excluded")
WAGE_LOW = 20_000
WAGE_HIGH = 500_000

LCA = FilingsSpec(
    name="lca",
    case_col="CASE_NUMBER",
    status_col="CASE_STATUS",
    employer_col="EMPLOYER_NAME",
    soc_code_col="SOC_CODE",
    occupation_col="SOC_TITLE",
    naics_col="NAICS_CODE",
    state_col="WORKSITE_STATE",
    wage_amount_col="WAGE_RATE_OF_PAY_FROM",
    wage_unit_col="WAGE_UNIT_OF_PAY",
    decided_statuses=DECIDED_LCA,
    hire_flag_col="HAS_NEW_OR_TRANSFER_POSITION",
    title_cols=("SOC_TITLE", "JOB_TITLE"),
)

PERM = FilingsSpec(
    name="perm",
    case_col="CASE_NUMBER",
    status_col="CASE_STATUS",
    employer_col="EMP_BUSINESS_NAME",
    soc_code_col="PWD_SOC_CODE",
    occupation_col="PWD_SOC_TITLE",
    naics_col="EMP_NAICS",
    state_col="PRIMARY_WORKSITE_STATE",
    wage_amount_col="JOB_OPP_WAGE_FROM",
    wage_unit_col="JOB_OPP_WAGE_PER",
    decided_statuses=DECIDED_PERM,
    hire_flag_col="IS_EXTERNAL_HIRE",
    title_cols=("PWD_SOC_TITLE", "JOB_TITLE"),
)
