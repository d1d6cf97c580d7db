"""Registered aggregation queries (A1-A29) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import stats
from filingscope.plans.enrich import Datasets
from filingscope.plans.oracle_base import pct_from_list_sql, round_sql
from filingscope.plans.registry import register

BASE_FY, NEXT_FY = 1998, 1999


def _ds(spark, sf_dir) -> Datasets:
    return Datasets(spark, sf_dir)


# -- A4 / A5 scorecards ---------------------------------------------------------

@register("a4_sector_scorecard_lca", """
SELECT NAICS_SECTOR, count(*) AS filings,
       CAST(count(*) FILTER (WHERE CERTIFIED) AS DOUBLE) / nullif(count(*) FILTER (WHERE DECIDED), 0) AS cert_rate,
       median(ANNUAL_WAGE) AS median_annual_wage
FROM lca_mba WHERE NAICS_SECTOR IS NOT NULL GROUP BY NAICS_SECTOR""")
def a4_sector_scorecard_lca(spark, sf_dir):
    return stats.scorecard(_ds(spark, sf_dir).lca_mba(), "NAICS_SECTOR").orderBy(F.desc("filings"), "NAICS_SECTOR")


@register("a4_sector_scorecard_perm", """
SELECT NAICS_SECTOR, count(*) AS filings,
       CAST(count(*) FILTER (WHERE CERTIFIED) AS DOUBLE) / nullif(count(*) FILTER (WHERE DECIDED), 0) AS cert_rate
FROM perm_mba WHERE NAICS_SECTOR IS NOT NULL GROUP BY NAICS_SECTOR""")
def a4_sector_scorecard_perm(spark, sf_dir):
    return stats.scorecard(_ds(spark, sf_dir).perm_mba(), "NAICS_SECTOR", wage=None)


@register("a5_geo_scorecard_lca", """
SELECT WORKSITE_STATE, count(*) AS filings, median(ANNUAL_WAGE) AS median_annual_wage
FROM lca_mba WHERE WORKSITE_STATE IS NOT NULL GROUP BY WORKSITE_STATE""")
def a5_geo_scorecard_lca(spark, sf_dir):
    return stats.scorecard(_ds(spark, sf_dir).lca_mba(), "WORKSITE_STATE", cert=False)


@register("a5_geo_scorecard_perm", """
SELECT PRIMARY_WORKSITE_STATE, count(*) AS filings
FROM perm_mba WHERE PRIMARY_WORKSITE_STATE IS NOT NULL GROUP BY PRIMARY_WORKSITE_STATE""")
def a5_geo_scorecard_perm(spark, sf_dir):
    return stats.scorecard(_ds(spark, sf_dir).perm_mba(), "PRIMARY_WORKSITE_STATE", wage=None, cert=False)


def _app(spark, sf_dir) -> Datasets:
    """The explorer's view: LCA restricted to H-1B before names are resolved."""
    from filingscope.plans.enrich import lca_master
    return Datasets(spark, sf_dir, lca=lca_master(spark, sf_dir).where(F.col("VISA_CLASS") == "H-1B"))


APP_LCA = "VISA_CLASS = 'H-1B'"
CERT_RATE_SQL = ("CAST(count(*) FILTER (WHERE CERTIFIED) AS DOUBLE) / "
                 "nullif(count(*) FILTER (WHERE DECIDED), 0)")

# -- A1 value counts --------------------------------------------------------------


@register("a1_status_lca", "SELECT CASE_STATUS, count(*) AS filings FROM lca_e WHERE CASE_STATUS IS NOT NULL GROUP BY 1")
def a1_status_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca, "CASE_STATUS")


@register("a1_status_perm_with_null", "SELECT CASE_STATUS, count(*) AS filings FROM perm_e GROUP BY 1")
def a1_status_perm_with_null(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).perm, "CASE_STATUS", keep_null=True)


@register("a1_visa_class", "SELECT VISA_CLASS, count(*) AS filings FROM lca_e WHERE VISA_CLASS IS NOT NULL GROUP BY 1")
def a1_visa_class(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca, "VISA_CLASS")


@register("a1_top_occupations_lca", """
SELECT SOC_TITLE, count(*) AS filings FROM lca_e WHERE SOC_TITLE IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, SOC_TITLE LIMIT 20""")
def a1_top_occupations_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca, "SOC_TITLE", k=20)


@register("a1_occupations_perm", """
SELECT PWD_SOC_TITLE, count(*) AS filings FROM perm_e WHERE PWD_SOC_TITLE IS NOT NULL GROUP BY 1""")
def a1_occupations_perm(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).perm, "PWD_SOC_TITLE")


@register("a1_top_employers_lca", """
SELECT EMPLOYER_CANONICAL, count(*) AS filings FROM lca_e WHERE EMPLOYER_CANONICAL IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, EMPLOYER_CANONICAL LIMIT 200""")
def a1_top_employers_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca, "EMPLOYER_CANONICAL", k=200)


@register("a1_top_employers_perm", """
SELECT EMPLOYER_CANONICAL, count(*) AS filings FROM perm_e WHERE EMPLOYER_CANONICAL IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, EMPLOYER_CANONICAL LIMIT 200""")
def a1_top_employers_perm(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).perm, "EMPLOYER_CANONICAL", k=200)


@register("a1_top_states_lca", """
SELECT WORKSITE_STATE, count(*) AS filings FROM lca_e WHERE WORKSITE_STATE IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, WORKSITE_STATE LIMIT 15""")
def a1_top_states_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca, "WORKSITE_STATE", k=15)


@register("a1_mba_states_lca", """
SELECT WORKSITE_STATE, count(*) AS filings FROM lca_mba WHERE WORKSITE_STATE IS NOT NULL GROUP BY 1""")
def a1_mba_states_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca_mba(), "WORKSITE_STATE")


@register("a1_mba_occupations_lca", """
SELECT SOC_TITLE, count(*) AS filings FROM lca_mba WHERE SOC_TITLE IS NOT NULL GROUP BY 1""")
def a1_mba_occupations_lca(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).lca_mba(), "SOC_TITLE")


@register("a1_mba_sectors_perm", """
SELECT NAICS_SECTOR, count(*) AS filings FROM perm_mba WHERE NAICS_SECTOR IS NOT NULL GROUP BY 1""")
def a1_mba_sectors_perm(spark, sf_dir):
    return stats.value_counts(_ds(spark, sf_dir).perm_mba(), "NAICS_SECTOR")


# -- A2 / A3 certification rates ------------------------------------------------------


@register("a2_cert_rate_lca", f"""
SELECT count(*) FILTER (WHERE DECIDED) AS decided, count(*) FILTER (WHERE CERTIFIED) AS certified,
       {CERT_RATE_SQL} AS cert_rate FROM lca_e""")
def a2_cert_rate_lca(spark, sf_dir):
    return stats.cert_rate(_ds(spark, sf_dir).lca)


@register("a2_cert_rate_perm", f"""
SELECT count(*) FILTER (WHERE DECIDED) AS decided, count(*) FILTER (WHERE CERTIFIED) AS certified,
       {CERT_RATE_SQL} AS cert_rate FROM perm_e""")
def a2_cert_rate_perm(spark, sf_dir):
    return stats.cert_rate(_ds(spark, sf_dir).perm)


@register("a3_cert_rate_by_tier_lca", f"""
SELECT MBA_TIER, count(*) FILTER (WHERE DECIDED) AS decided, count(*) FILTER (WHERE CERTIFIED) AS certified,
       {CERT_RATE_SQL} AS cert_rate FROM lca_e WHERE MBA_TIER IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE DECIDED) > 0""")
def a3_cert_rate_by_tier_lca(spark, sf_dir):
    return stats.cert_rate(_ds(spark, sf_dir).lca, ["MBA_TIER"]).where(F.col("decided") > 0)


@register("a3_cert_rate_by_tier_perm", f"""
SELECT MBA_TIER, count(*) FILTER (WHERE DECIDED) AS decided, count(*) FILTER (WHERE CERTIFIED) AS certified,
       {CERT_RATE_SQL} AS cert_rate FROM perm_e WHERE MBA_TIER IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE DECIDED) > 0""")
def a3_cert_rate_by_tier_perm(spark, sf_dir):
    return stats.cert_rate(_ds(spark, sf_dir).perm, ["MBA_TIER"]).where(F.col("decided") > 0)


# -- A6 - A8 employer mix and scorecards ---------------------------------------------

MIX_SQL = """
SELECT EMPLOYER_CANONICAL, count(MBA_TIER) AS total,
       count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS mba_relevant,
       CAST(count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS DOUBLE) / nullif(count(MBA_TIER), 0) AS mba_share
FROM {t} WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1 HAVING count(MBA_TIER) >= 10"""


@register("a6_employer_mix_lca", MIX_SQL.format(t="lca_e"))
def a6_employer_mix_lca(spark, sf_dir):
    return stats.employer_mix(_ds(spark, sf_dir).lca).orderBy(
        F.desc("mba_share"), F.desc("total"), "EMPLOYER_CANONICAL")


@register("a6_employer_mix_perm", MIX_SQL.format(t="perm_e"))
def a6_employer_mix_perm(spark, sf_dir):
    return stats.employer_mix(_ds(spark, sf_dir).perm).orderBy(
        F.desc("mba_share"), F.desc("total"), "EMPLOYER_CANONICAL")


@register("a7_employer_scorecard_lca", """
SELECT EMPLOYER_CANONICAL, count(MBA_TIER) AS total_filings,
       count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS mba_relevant_filings,
       avg(CASE WHEN CASE_STATUS IS DISTINCT FROM 'Denied' THEN 1.0 ELSE 0.0 END) AS certified,
       avg(CAST(IS_NEW_HIRE AS DOUBLE)) AS new_position_share,
       median(ANNUAL_WAGE_FROM) AS median_annual_wage,
       bool_or(coalesce(WILLFUL_VIOLATOR = 'Y', false)) AS any_willful_violator,
       bool_or(coalesce(H_1B_DEPENDENT = 'Y', false)) AS any_h1b_dependent,
       CAST(count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS DOUBLE) / nullif(count(MBA_TIER), 0) AS mba_share
FROM lca_e WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE MBA_TIER <> 'excluded') >= 10""")
def a7_employer_scorecard_lca(spark, sf_dir):
    return stats.employer_scorecard_lca(_ds(spark, sf_dir).lca).orderBy(
        F.desc("mba_share"), F.desc("mba_relevant_filings"), "EMPLOYER_CANONICAL")


@register("a8_employer_scorecard_perm", """
SELECT EMPLOYER_CANONICAL, count(MBA_TIER) AS total_filings,
       count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS mba_relevant_filings,
       avg(CASE WHEN CASE_STATUS IS DISTINCT FROM 'Denied' THEN 1.0 ELSE 0.0 END) AS certified,
       avg(CASE WHEN OTHER_REQ_IS_FW_CURRENTLY_WRK = 'N' THEN 1.0 ELSE 0.0 END) AS external_hire_share,
       median(EMP_NUM_PAYROLL) AS median_company_payroll,
       CAST(count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS DOUBLE) / nullif(count(MBA_TIER), 0) AS mba_share
FROM perm_e WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE MBA_TIER <> 'excluded') >= 5""")
def a8_employer_scorecard_perm(spark, sf_dir):
    return stats.employer_scorecard_perm(_ds(spark, sf_dir).perm).orderBy(
        F.desc("mba_share"), F.desc("mba_relevant_filings"), "EMPLOYER_CANONICAL")


# -- A9 / A10 explorer leaderboard and KPIs ---------------------------------------------

LINK_SQL = "'https://www.google.com/search?q=' || replace(url_encode(g.EMPLOYER_CANONICAL || ' MBA careers'), '%20', '+')"

BOARD_SQL = """
, filt AS (SELECT * FROM {t} WHERE MBA_TIER IN ('core', 'adjacent')),
g AS (
  SELECT EMPLOYER_CANONICAL, count(*) AS filings,
         count(*) FILTER (WHERE CERTIFIED) AS c, count(*) FILTER (WHERE DECIDED) AS d,
         avg(CAST({flag} AS DOUBLE)) AS sig, median(ANNUAL_WAGE) AS median_wage
         {extra}
  FROM filt WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
tot AS (SELECT EMPLOYER_CANONICAL, count(*) AS total, count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS mba
        FROM {t} WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1),
oth AS (SELECT DISTINCT EMPLOYER_CANONICAL FROM {o} WHERE EMPLOYER_CANONICAL IS NOT NULL)
SELECT g.EMPLOYER_CANONICAL, g.filings,
       CASE WHEN tot.mba > 0 THEN CAST(tot.mba AS DOUBLE) / tot.total END * 100 AS mba_mix_pct,
       CAST(g.c AS DOUBLE) / nullif(g.d, 0) * 100 AS cert_rate_pct,
       g.sig * 100 AS signal_pct, g.median_wage,
       CASE WHEN oth.EMPLOYER_CANONICAL IS NOT NULL THEN 'Yes' ELSE '' END AS other_history,
       {link} AS search_link {extra_cols}
FROM g LEFT JOIN tot USING (EMPLOYER_CANONICAL) LEFT JOIN oth ON oth.EMPLOYER_CANONICAL = g.EMPLOYER_CANONICAL
ORDER BY g.filings DESC, g.EMPLOYER_CANONICAL LIMIT 300"""

LCA_FLAG_AGGS = (", bool_or(coalesce(WILLFUL_VIOLATOR = 'Y', false)) AS wv, "
                 "bool_or(coalesce(H_1B_DEPENDENT = 'Y', false)) AS dep")
LCA_FLAG_COLS = (", CASE WHEN g.wv THEN 'Yes' ELSE '' END AS willful_violator, "
                 "CASE WHEN g.dep THEN 'Yes' ELSE '' END AS h1b_dependent")


@register("a9_leaderboard_lca", BOARD_SQL.format(t="lca_e", o="perm_e", flag="HAS_NEW_OR_TRANSFER_POSITION",
                                                   extra=LCA_FLAG_AGGS, extra_cols=LCA_FLAG_COLS, link=LINK_SQL),
          lca_where=APP_LCA)
def a9_leaderboard_lca(spark, sf_dir):
    from filingscope.operators.search import Facets, facet_condition
    from filingscope.spec import LCA
    ds = _app(spark, sf_dir)
    lca = ds.lca
    return stats.leaderboard(lca, ds.perm, "HAS_NEW_OR_TRANSFER_POSITION", facet_condition(lca.columns, LCA, Facets()))


@register("a9_leaderboard_perm", BOARD_SQL.format(t="perm_e", o="lca_e", flag="IS_EXTERNAL_HIRE",
                                                    extra="", extra_cols="", link=LINK_SQL),
          lca_where=APP_LCA)
def a9_leaderboard_perm(spark, sf_dir):
    from filingscope.operators.search import Facets, facet_condition
    from filingscope.spec import PERM
    ds = _app(spark, sf_dir)
    perm = ds.perm
    return stats.leaderboard(perm, ds.lca, "IS_EXTERNAL_HIRE", facet_condition(perm.columns, PERM, Facets()), lca_flags=False)


KPI_SQL = f"""
SELECT count(*) AS matched, count(*) FILTER (WHERE DECIDED) AS decided, {CERT_RATE_SQL} AS cert_rate,
       median(ANNUAL_WAGE) AS median_wage, count(ANNUAL_WAGE) AS wage_n, avg(CAST({{flag}} AS DOUBLE)) AS signal_share
FROM {{t}} WHERE MBA_TIER IN ('core', 'adjacent')"""


@register("a10_kpis_lca", KPI_SQL.format(t="lca_e", flag="HAS_NEW_OR_TRANSFER_POSITION"), lca_where=APP_LCA)
def a10_kpis_lca(spark, sf_dir):
    from filingscope.operators.search import Facets, faceted_filter
    from filingscope.spec import LCA
    return stats.kpis(faceted_filter(_app(spark, sf_dir).lca, LCA, Facets()), "HAS_NEW_OR_TRANSFER_POSITION")


@register("a10_kpis_perm", KPI_SQL.format(t="perm_e", flag="IS_EXTERNAL_HIRE"), lca_where=APP_LCA)
def a10_kpis_perm(spark, sf_dir):
    from filingscope.operators.search import Facets, faceted_filter
    from filingscope.spec import PERM
    return stats.kpis(faceted_filter(_app(spark, sf_dir).perm, PERM, Facets()), "IS_EXTERNAL_HIRE")


# -- A11 - A13 fiscal comparisons ----------------------------------------------------------

YOYQ_SQL = f"""
, g AS (SELECT FISCAL_QUARTER, count(*) FILTER (WHERE FISCAL_YEAR = {BASE_FY}) AS base_filings,
               count(*) FILTER (WHERE FISCAL_YEAR = {NEXT_FY}) AS next_filings
        FROM {{t}} WHERE FISCAL_QUARTER <= 3 GROUP BY 1)
SELECT *, (CAST(sum(next_filings) OVER () AS DOUBLE) / nullif(sum(base_filings) OVER (), 0) - 1) * 100 AS pct_change_total
FROM g WHERE base_filings > 0 OR next_filings > 0"""


@register("a11_yoy_by_quarter_lca", YOYQ_SQL.format(t="lca_e"))
def a11_yoy_by_quarter_lca(spark, sf_dir):
    return stats.yoy_by_quarter(_ds(spark, sf_dir).lca, BASE_FY, NEXT_FY)


@register("a11_yoy_by_quarter_perm", YOYQ_SQL.format(t="perm_e"))
def a11_yoy_by_quarter_perm(spark, sf_dir):
    return stats.yoy_by_quarter(_ds(spark, sf_dir).perm, BASE_FY, NEXT_FY)


YOYT_SQL = f"""
, g AS (SELECT MBA_TIER, count(*) FILTER (WHERE FISCAL_YEAR = {BASE_FY}) AS base_filings,
               count(*) FILTER (WHERE FISCAL_YEAR = {NEXT_FY}) AS next_filings
        FROM {{t}} WHERE FISCAL_QUARTER <= 3 GROUP BY 1),
h AS (SELECT *, sum(base_filings) OVER () > 0 AND sum(next_filings) OVER () > 0 AS both_years FROM g)
SELECT MBA_TIER, base_filings, next_filings, (CAST(next_filings AS DOUBLE) / base_filings - 1) * 100 AS pct_change
FROM h WHERE MBA_TIER IN {{tiers}} AND both_years AND base_filings > 0"""


@register("a12_yoy_by_tier_lca", YOYT_SQL.format(t="lca_e", tiers="('core', 'adjacent', 'excluded')"))
def a12_yoy_by_tier_lca(spark, sf_dir):
    return stats.yoy_by_tier(_ds(spark, sf_dir).lca, BASE_FY, NEXT_FY)


@register("a12_yoy_by_tier_perm", YOYT_SQL.format(t="perm_e", tiers="('core', 'adjacent', 'excluded')"))
def a12_yoy_by_tier_perm(spark, sf_dir):
    return stats.yoy_by_tier(_ds(spark, sf_dir).perm, BASE_FY, NEXT_FY)


COVERAGE_SQL = """
SELECT FISCAL_YEAR, count(*) FILTER (WHERE FISCAL_QUARTER = 1) AS Q1, count(*) FILTER (WHERE FISCAL_QUARTER = 2) AS Q2,
       count(*) FILTER (WHERE FISCAL_QUARTER = 3) AS Q3, count(*) FILTER (WHERE FISCAL_QUARTER = 4) AS Q4
FROM {t} WHERE FISCAL_YEAR IS NOT NULL AND FISCAL_QUARTER IS NOT NULL GROUP BY 1"""


@register("a13_fiscal_coverage_lca", COVERAGE_SQL.format(t="lca_e"))
def a13_fiscal_coverage_lca(spark, sf_dir):
    return stats.fiscal_coverage(_ds(spark, sf_dir).lca_master)


@register("a13_fiscal_coverage_perm", COVERAGE_SQL.format(t="perm_e"))
def a13_fiscal_coverage_perm(spark, sf_dir):
    return stats.fiscal_coverage(_ds(spark, sf_dir).perm_master)


# -- A14 / A15 time series ----------------------------------------------------------------

MONTHLY_SQL = """
, c AS (SELECT last_day(RECEIVED_DATE) AS month_end, count(*) AS filings FROM {t} WHERE RECEIVED_DATE IS NOT NULL GROUP BY 1),
b AS (SELECT min(month_end) AS lo, max(month_end) AS hi FROM c),
m AS (SELECT last_day(CAST(gs AS DATE)) AS month_end
      FROM b, generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH) t(gs))
SELECT m.month_end, coalesce(c.filings, 0) AS filings FROM m LEFT JOIN c ON c.month_end = m.month_end"""


@register("a14_monthly_series_lca", MONTHLY_SQL.format(t="lca_e"))
def a14_monthly_series_lca(spark, sf_dir):
    return stats.monthly_series(_ds(spark, sf_dir).lca_master)


@register("a14_monthly_series_perm", MONTHLY_SQL.format(t="perm_e"))
def a14_monthly_series_perm(spark, sf_dir):
    return stats.monthly_series(_ds(spark, sf_dir).perm_master)


SEASON_SQL = """
, c AS (SELECT CAST(month(RECEIVED_DATE) AS INTEGER) AS month, count(*) AS filings FROM {t} WHERE RECEIVED_DATE IS NOT NULL GROUP BY 1)
SELECT CAST(r.m AS INTEGER) AS month, coalesce(c.filings, 0) AS filings
FROM range(1, 13) r(m) LEFT JOIN c ON c.month = r.m"""


@register("a15_seasonality_lca", SEASON_SQL.format(t="lca_e"))
def a15_seasonality_lca(spark, sf_dir):
    return stats.seasonality(_ds(spark, sf_dir).lca_master)


@register("a15_seasonality_perm", SEASON_SQL.format(t="perm_e"))
def a15_seasonality_perm(spark, sf_dir):
    return stats.seasonality(_ds(spark, sf_dir).perm_master)


# -- A16 / A17 column profiles ---------------------------------------------------------------

# Columns of the consolidated LCA master and their Spark types.
LCA_MASTER_TYPES = {
    "CASE_NUMBER": "string", "SOURCE_FILE": "string", "SOURCE_ORD": "int", "CASE_STATUS": "string",
    "RECEIVED_DATE": "date", "DECISION_DATE": "date", "VISA_CLASS": "string", "SOC_CODE": "string",
    "SOC_TITLE": "string", "JOB_TITLE": "string", "EMPLOYER_NAME": "string", "NAICS_CODE": "string",
    "WORKSITE_STATE": "string", "WAGE_RATE_OF_PAY_FROM": "double", "WAGE_UNIT_OF_PAY": "string",
    "PW_WAGE_LEVEL": "string", "NEW_EMPLOYMENT": "int", "CHANGE_EMPLOYER": "int",
    "NEW_CONCURRENT_EMPLOYMENT": "int", "H_1B_DEPENDENT": "string", "WILLFUL_VIOLATOR": "string",
    "FISCAL_YEAR": "int", "FISCAL_QUARTER": "int",
}

MISSING_SQL = ("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, "
    f"floor((2000 * (count(*) - count({c})) + count(*)) // (2 * count(*))) / 10 AS pct_missing FROM lca"
    for c in LCA_MASTER_TYPES) + ") WHERE nulls > 0 ORDER BY nulls DESC, column_name")
MISSING_SQL = MISSING_SQL.replace("SELECT * FROM", "SELECT column_name, pct_missing FROM", 1)

PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype FROM lca"
    for c, t in LCA_MASTER_TYPES.items())


@register("a16_missingness_lca", MISSING_SQL)
def a16_missingness_lca(spark, sf_dir):
    return stats.missingness(_ds(spark, sf_dir).lca_master)


@register("a17_column_profile_lca", PROFILE_SQL)
def a17_column_profile_lca(spark, sf_dir):
    return stats.column_profile(_ds(spark, sf_dir).lca_master)


# -- A18 - A21 distributions ----------------------------------------------------------------

DESCRIBE_COLS = (f"count(x) AS count, {round_sql('avg(x)', 4)} AS mean, {round_sql('stddev_samp(x)', 4)} AS std, "
                 f"min(x) AS min, {pct_from_list_sql('list_sort(list(x))', 0.25)} AS p25, median(x) AS p50, "
                 f"{pct_from_list_sql('list_sort(list(x))', 0.75)} AS p75, max(x) AS max")


@register("a18_describe_wage_lca", f"""
, s AS (SELECT ANNUAL_WAGE AS x FROM lca_e WHERE ANNUAL_WAGE IS NOT NULL)
SELECT {DESCRIBE_COLS} FROM s""")
def a18_describe_wage_lca(spark, sf_dir):
    return stats.describe(_ds(spark, sf_dir).lca, "ANNUAL_WAGE")


@register("a18_describe_wage_by_tier_lca", f"""
, s AS (SELECT MBA_TIER, ANNUAL_WAGE AS x FROM lca_e WHERE ANNUAL_WAGE IS NOT NULL AND MBA_TIER IS NOT NULL)
SELECT MBA_TIER, {DESCRIBE_COLS} FROM s GROUP BY MBA_TIER""")
def a18_describe_wage_by_tier_lca(spark, sf_dir):
    return stats.describe(_ds(spark, sf_dir).lca, "ANNUAL_WAGE", by=["MBA_TIER"])


HIST_SQL = """
, v AS (SELECT {expr} AS v FROM {t} WHERE {where}),
b AS (SELECT min(v) AS mn, max(v) AS mx FROM v),
c AS (SELECT CAST(CASE WHEN mx - mn = 0 THEN 1 ELSE least(floor((v - mn) * ({bins}.0 / (mx - mn))) + 1, {bins}) END AS INTEGER) AS bin,
             count(*) AS filings FROM v, b GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin, mn, mx FROM b, range(1, {bins} + 1) t(i))
SELECT e.bin, floor((mn + (mx - mn) * (e.bin - 1) / {bins}) * 10000.0 + 0.5) / 10000.0 AS bin_lo,
       floor((mn + (mx - mn) * e.bin / {bins}) * 10000.0 + 0.5) / 10000.0 AS bin_hi,
       coalesce(c.filings, 0) AS filings
FROM e LEFT JOIN c ON c.bin = e.bin"""


@register("a19_wage_histogram_lca", HIST_SQL.format(expr="ANNUAL_WAGE", t="lca_e", where="ANNUAL_WAGE IS NOT NULL", bins=60))
def a19_wage_histogram_lca(spark, sf_dir):
    return stats.histogram(_ds(spark, sf_dir).lca, "ANNUAL_WAGE", 60)


@register("a20_payroll_log_histogram_perm", HIST_SQL.format(
    expr="log10(EMP_NUM_PAYROLL)", t="perm_mba",
    where="EMP_NUM_PAYROLL IS NOT NULL AND EMP_NUM_PAYROLL > 0 AND EMP_NUM_PAYROLL < 2000000", bins=50))
def a20_payroll_log_histogram_perm(spark, sf_dir):
    return stats.histogram(_ds(spark, sf_dir).perm_mba(), "EMP_NUM_PAYROLL", 50, log10=True, lo=0, hi=2_000_000)


@register("a21_wage_box_stats_lca", """
, s AS (SELECT MBA_TIER, ANNUAL_WAGE AS x FROM lca_e WHERE ANNUAL_WAGE IS NOT NULL AND MBA_TIER IS NOT NULL),
q AS (SELECT MBA_TIER, """ + pct_from_list_sql("list_sort(list(x))", 0.25) + """ AS q1, median(x) AS median,
             """ + pct_from_list_sql("list_sort(list(x))", 0.75) + """ AS q3 FROM s GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.MBA_TIER, q1, median, q3, iqr,
       min(x) FILTER (WHERE x >= lo_fence AND x <= hi_fence) AS whisker_low,
       max(x) FILTER (WHERE x >= lo_fence AND x <= hi_fence) AS whisker_high,
       count(*) FILTER (WHERE NOT (x >= lo_fence AND x <= hi_fence)) AS outliers
FROM s JOIN f ON f.MBA_TIER = s.MBA_TIER GROUP BY f.MBA_TIER, q1, median, q3, iqr""")
def a21_wage_box_stats_lca(spark, sf_dir):
    return stats.box_stats(_ds(spark, sf_dir).lca, "ANNUAL_WAGE", "MBA_TIER")


# -- A22 - A24 cross tabulations -------------------------------------------------------------


@register("a22_crosstab_top_lca", """
, tr AS (SELECT SOC_TITLE, CAST(row_number() OVER (ORDER BY count(*) DESC, SOC_TITLE) AS INTEGER) AS row_rank
         FROM lca_mba WHERE SOC_TITLE IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, SOC_TITLE LIMIT 15),
cells AS (SELECT m.SOC_TITLE, tr.row_rank, m.NAICS_SECTOR, count(*) AS filings
          FROM lca_mba m JOIN tr ON tr.SOC_TITLE = m.SOC_TITLE WHERE m.NAICS_SECTOR IS NOT NULL GROUP BY 1, 2, 3),
tc AS (SELECT NAICS_SECTOR, CAST(row_number() OVER (ORDER BY sum(filings) DESC, NAICS_SECTOR) AS INTEGER) AS col_rank
       FROM cells GROUP BY 1 ORDER BY sum(filings) DESC, NAICS_SECTOR LIMIT 8)
SELECT cells.SOC_TITLE, cells.row_rank, cells.NAICS_SECTOR, cells.filings, tc.col_rank
FROM cells JOIN tc ON tc.NAICS_SECTOR = cells.NAICS_SECTOR""")
def a22_crosstab_top_lca(spark, sf_dir):
    return stats.crosstab_top(_ds(spark, sf_dir).lca_mba(), "SOC_TITLE", "NAICS_SECTOR", 15, 8)


LEVEL_COUNTS = ", ".join(f"count(*) FILTER (WHERE PW_WAGE_LEVEL = '{lv}') AS \"{lv}\"" for lv in ("I", "II", "III", "IV"))


@register("a23_wage_level_pivot_lca", f"""
SELECT SOC_TITLE, {LEVEL_COUNTS}, count(*) FILTER (WHERE PW_WAGE_LEVEL IN ('I', 'II', 'III', 'IV')) AS total
FROM lca_mba WHERE SOC_TITLE IS NOT NULL AND PW_WAGE_LEVEL IS NOT NULL GROUP BY 1""")
def a23_wage_level_pivot_lca(spark, sf_dir):
    return stats.level_pivot(_ds(spark, sf_dir).lca_mba()).orderBy(F.desc("total"), "SOC_TITLE")


@register("a24_wage_level_share_lca", f"""
, p AS (SELECT SOC_TITLE, {LEVEL_COUNTS}, count(*) FILTER (WHERE PW_WAGE_LEVEL IN ('I', 'II', 'III', 'IV')) AS total
        FROM lca_mba WHERE SOC_TITLE IS NOT NULL AND PW_WAGE_LEVEL IS NOT NULL GROUP BY 1
        ORDER BY total DESC, SOC_TITLE LIMIT 15)
SELECT SOC_TITLE, CAST("I" AS DOUBLE) / total AS share_I, CAST("II" AS DOUBLE) / total AS share_II,
       CAST("III" AS DOUBLE) / total AS share_III, CAST("IV" AS DOUBLE) / total AS share_IV, total FROM p""")
def a24_wage_level_share_lca(spark, sf_dir):
    return stats.level_share(_ds(spark, sf_dir).lca_mba())


# -- A25 - A29 shares and domain tables -----------------------------------------------------


@register("a25_share_table_perm", """
SELECT OTHER_REQ_IS_FW_CURRENTLY_WRK, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM perm_mba GROUP BY 1""")
def a25_share_table_perm(spark, sf_dir):
    return stats.share_table(_ds(spark, sf_dir).perm_mba(), "OTHER_REQ_IS_FW_CURRENTLY_WRK", keep_null=True)


@register("a26_wage_level_mix_lca", """
, c AS (SELECT WAGE_LEVEL, count(*) AS filings FROM lca_mba GROUP BY 1)
SELECT d.WAGE_LEVEL, coalesce(c.filings, 0) AS filings
FROM (VALUES ('I'), ('II'), ('III'), ('IV'), ('Unspecified')) d(WAGE_LEVEL) LEFT JOIN c ON c.WAGE_LEVEL = d.WAGE_LEVEL""")
def a26_wage_level_mix_lca(spark, sf_dir):
    return stats.wage_level_mix(_ds(spark, sf_dir).lca_mba())


@register("a27_hire_split_perm", """
SELECT CASE WHEN IS_EXTERNAL_HIRE THEN 'External hire' ELSE 'Already employed there' END AS hire_type,
       count(*) AS filings FROM perm_mba GROUP BY 1""")
def a27_hire_split_perm(spark, sf_dir):
    return stats.hire_split(_ds(spark, sf_dir).perm_mba(), "IS_EXTERNAL_HIRE", "External hire", "Already employed there")


@register("a28_flag_shares", """
SELECT 'lca_new_hire_share' AS metric, avg(CAST(IS_NEW_HIRE AS DOUBLE)) AS value FROM lca_mba
UNION ALL SELECT 'perm_external_hire_share', avg(CAST(IS_EXTERNAL_HIRE AS DOUBLE)) FROM perm_mba
UNION ALL SELECT 'lca_mba_share_of_all', avg(CASE WHEN MBA_TIER <> 'excluded' THEN 1.0 ELSE 0.0 END) FROM lca_e
UNION ALL SELECT 'perm_mba_share_of_all', avg(CASE WHEN MBA_TIER <> 'excluded' THEN 1.0 ELSE 0.0 END) FROM perm_e""")
def a28_flag_shares(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    mba = F.col("MBA_TIER") != "excluded"
    parts = [
        ds.lca_mba().agg(stats.share("IS_NEW_HIRE").alias("value")).select(F.lit("lca_new_hire_share").alias("metric"), "value"),
        ds.perm_mba().agg(stats.share("IS_EXTERNAL_HIRE").alias("value")).select(F.lit("perm_external_hire_share").alias("metric"), "value"),
        ds.lca.agg(stats.share(mba).alias("value")).select(F.lit("lca_mba_share_of_all").alias("metric"), "value"),
        ds.perm.agg(stats.share(mba).alias("value")).select(F.lit("perm_mba_share_of_all").alias("metric"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TIER_SQL = """
SELECT MBA_TIER, count(*) AS filings, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100 AS pct_of_total
FROM {t} WHERE MBA_TIER IS NOT NULL GROUP BY 1"""


@register("a29_tier_counts_lca", TIER_SQL.format(t="lca_e"))
def a29_tier_counts_lca(spark, sf_dir):
    return stats.tier_counts(_ds(spark, sf_dir).lca)


@register("a29_tier_counts_perm", TIER_SQL.format(t="perm_e"))
def a29_tier_counts_perm(spark, sf_dir):
    return stats.tier_counts(_ds(spark, sf_dir).perm)
