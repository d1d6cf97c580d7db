"""DuckDB SQL for the independent correctness oracle.

The fragments below restate each Column function in portable SQL (DuckDB
dialect: RE2 regex, ``'g'`` flag for global replace, ``\\1`` group
references).  ``ctes()`` yields the master and enriched views every oracle
query starts from.
"""

from __future__ import annotations

from filingscope.functions.classify import (
    ADJACENT_REGEX,
    CORE_SOC_MAJOR_GROUPS,
    EXCLUSION_REGEX,
    NAICS_SECTOR_NAMES,
    UNKNOWN_SECTOR,
)
from filingscope.functions.names import LEGAL_SUFFIX_TOKENS
from filingscope.functions.wages import PAY_UNIT_MULTIPLIERS
from filingscope.operators.entities import brand_variants
from filingscope.sources.testbind import LCA_RAW_SQL, PERM_RAW_SQL
from filingscope.spec import DECIDED_LCA, DECIDED_PERM, WAGE_HIGH, WAGE_LOW


def round_sql(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def pct_from_list_sql(lst: str, p: float) -> str:
    """Linear-interpolated percentile over a sorted list, written with the
    same arithmetic as Spark's exact ``percentile``."""
    n = f"len({lst})"
    pos = f"(CAST({n} - 1 AS DOUBLE) * {p})"
    lo = f"CAST(floor({pos}) AS BIGINT)"
    hi = f"CAST(ceil({pos}) AS BIGINT)"
    return (f"CASE WHEN {n} = 0 THEN NULL WHEN {lo} = {hi} OR {lst}[{lo} + 1] = {lst}[{hi} + 1] THEN {lst}[{lo} + 1] "
            f"ELSE ({hi} - {pos}) * {lst}[{lo} + 1] + ({pos} - {lo}) * {lst}[{hi} + 1] END")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(upper({x}), ',', ' '), '[.''\"()]', '', 'g'), "
            f"'\\s+', ' ', 'g'))")


def core_sql(x: str) -> str:
    suffix = "( (" + "|".join(LEGAL_SUFFIX_TOKENS) + "))+$"
    return f"regexp_replace(regexp_replace({clean_sql(x)}, '^THE (.)', '\\1'), {q(suffix)}, '')"


def tier_sql(code: str, title: str) -> str:
    t = f"coalesce({title}, '')"
    return (f"CASE WHEN substring({code}, 1, 2) IN {in_list(CORE_SOC_MAJOR_GROUPS)} THEN 'core' "
            f"WHEN regexp_matches({t}, {q(ADJACENT_REGEX)}, 'i') AND NOT regexp_matches({t}, {q(EXCLUSION_REGEX)}, 'i') "
            f"THEN 'adjacent' ELSE 'excluded' END")


def sector_sql(code: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in NAICS_SECTOR_NAMES.items())
    return f"coalesce(CASE substring({strip_sql(code)}, 1, 2) {whens} END, {q(UNKNOWN_SECTOR)})"


def annual_sql(amount: str, unit: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in PAY_UNIT_MULTIPLIERS.items())
    return f"(CAST({amount} AS DOUBLE) * CASE {unit} {whens} END)"


def bounded_sql(x: str) -> str:
    return f"CASE WHEN {x} > {WAGE_LOW} AND {x} < {WAGE_HIGH} THEN {x} END"


def decided_sql(status: str, statuses) -> str:
    return f"coalesce({status} IN {in_list(statuses)}, false)"


def certified_sql(status: str, statuses) -> str:
    return f"({decided_sql(status, statuses)} AND {status} IS DISTINCT FROM 'Denied')"


def pos_sum_sql(*cols) -> str:
    return "(" + " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in cols) + ")"


def fiscal_sql(prefix: str = "") -> str:
    d = f"coalesce({prefix}DECISION_DATE, {prefix}RECEIVED_DATE)"
    return (f"CAST(year({d} + INTERVAL 3 MONTH) AS INTEGER) AS FISCAL_YEAR, "
            f"CAST(quarter({d} + INTERVAL 3 MONTH) AS INTEGER) AS FISCAL_QUARTER")


def brand_values_sql() -> str:
    rows = ", ".join(f"({q(b)}, {q(v)})" for b, v in brand_variants())
    return f"(VALUES {rows}) AS bv(brand, variant)"


def ctes(lca_where: str | None = None) -> str:
    """Base views: lca / perm (master), name_map, lca_e / perm_e (enriched),
    lca_mba / perm_mba."""
    lw = f" WHERE {lca_where}" if lca_where else ""
    aw_l = annual_sql("WAGE_RATE_OF_PAY_FROM", "WAGE_UNIT_OF_PAY")
    aw_p = annual_sql("JOB_OPP_WAGE_FROM", "JOB_OPP_WAGE_PER")
    return f"""
lca_raw AS ({LCA_RAW_SQL}),
lca_fy AS (SELECT *, {fiscal_sql()} FROM lca_raw),
lca AS (SELECT * FROM lca_fy QUALIFY SOURCE_ORD = max(SOURCE_ORD) OVER (PARTITION BY CASE_NUMBER)),
lca_sel AS (SELECT * FROM lca{lw}),
perm_raw AS ({PERM_RAW_SQL}),
perm AS (SELECT *, {fiscal_sql()} FROM perm_raw),
names AS (
  SELECT {strip_sql('EMPLOYER_NAME')} AS raw_name FROM lca_sel WHERE EMPLOYER_NAME IS NOT NULL
  UNION ALL
  SELECT {strip_sql('EMP_BUSINESS_NAME')} AS raw_name FROM perm WHERE EMP_BUSINESS_NAME IS NOT NULL),
name_counts AS (
  SELECT raw_name, count(*) AS n, {core_sql('raw_name')} AS core, raw_name = upper(raw_name) AS is_caps
  FROM names GROUP BY raw_name),
canon AS (
  SELECT core, raw_name AS canonical_name FROM name_counts
  QUALIFY row_number() OVER (PARTITION BY core ORDER BY n DESC, is_caps, raw_name) = 1),
brand_map AS (SELECT DISTINCT {core_sql('variant')} AS core, brand FROM {brand_values_sql()}),
name_map AS (
  SELECT nc.raw_name, nc.core, c.canonical_name, coalesce(b.brand, c.canonical_name) AS EMPLOYER_CANONICAL
  FROM name_counts nc JOIN canon c ON c.core = nc.core LEFT JOIN brand_map b ON b.core = nc.core),
lca_e AS (
  SELECT m.*,
    {tier_sql('m.SOC_CODE', 'm.SOC_TITLE')} AS MBA_TIER,
    {sector_sql('m.NAICS_CODE')} AS NAICS_SECTOR,
    {aw_l} AS ANNUAL_WAGE_FROM,
    {bounded_sql(aw_l)} AS ANNUAL_WAGE,
    {decided_sql('m.CASE_STATUS', DECIDED_LCA)} AS DECIDED,
    {certified_sql('m.CASE_STATUS', DECIDED_LCA)} AS CERTIFIED,
    {pos_sum_sql('NEW_EMPLOYMENT', 'CHANGE_EMPLOYER', 'NEW_CONCURRENT_EMPLOYMENT')} > 0 AS IS_NEW_HIRE,
    {pos_sum_sql('NEW_EMPLOYMENT', 'CHANGE_EMPLOYER')} > 0 AS HAS_NEW_OR_TRANSFER_POSITION,
    {pos_sum_sql('NEW_EMPLOYMENT', 'CHANGE_EMPLOYER')} AS NEW_OR_TRANSFER_POSITIONS,
    {pos_sum_sql('NEW_EMPLOYMENT')} > 0 AS IS_NEW_EMPLOYMENT,
    coalesce(m.PW_WAGE_LEVEL, 'Unspecified') AS WAGE_LEVEL,
    nm.canonical_name AS CANONICAL_NAME,
    nm.EMPLOYER_CANONICAL
  FROM lca_sel m LEFT JOIN name_map nm ON nm.raw_name = {strip_sql('m.EMPLOYER_NAME')}),
perm_e AS (
  SELECT m.*,
    {tier_sql('m.PWD_SOC_CODE', 'm.PWD_SOC_TITLE')} AS MBA_TIER,
    {sector_sql('m.EMP_NAICS')} AS NAICS_SECTOR,
    {aw_p} AS ANNUAL_WAGE_FROM,
    {bounded_sql(aw_p)} AS ANNUAL_WAGE,
    {decided_sql('m.CASE_STATUS', DECIDED_PERM)} AS DECIDED,
    {certified_sql('m.CASE_STATUS', DECIDED_PERM)} AS CERTIFIED,
    coalesce(m.OTHER_REQ_IS_FW_CURRENTLY_WRK = 'N', false) AS IS_EXTERNAL_HIRE,
    nm.canonical_name AS CANONICAL_NAME,
    nm.EMPLOYER_CANONICAL
  FROM perm m LEFT JOIN name_map nm ON nm.raw_name = {strip_sql('m.EMP_BUSINESS_NAME')}),
lca_mba AS (SELECT * FROM lca_e WHERE MBA_TIER <> 'excluded'),
perm_mba AS (SELECT * FROM perm_e WHERE MBA_TIER <> 'excluded')"""


def with_ctes(body: str, lca_where: str | None = None) -> str:
    return "WITH " + ctes(lca_where).strip() + "\n" + body.strip()
