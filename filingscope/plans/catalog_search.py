"""Registered search, facet and persona queries (Q1-Q9) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import search
from filingscope.operators.distribution import stored
from filingscope.operators.search import PERSONA_KEYWORDS, Facets
from filingscope.plans.catalog_stats import _ds
from filingscope.plans.oracle_base import in_list, pct_from_list_sql, q
from filingscope.plans.registry import register
from filingscope.session import delete_path, scratch_path
from filingscope.spec import LCA, PERM
from filingscope.functions.text import keyword_pattern

FINANCE = "finance_risk_fintech"
LCA_TITLES = ("SOC_TITLE", "JOB_TITLE")

LCA_FACETS = Facets(
    tiers=("core", "adjacent"), hire_only=True, states=("NATION_1", "NATION_2", "NATION_3", "NATION_7"),
    sectors=("Finance and Insurance", "Professional, Scientific, and Technical Services"), wage_levels=("I", "II"))
PERM_FACETS = Facets(tiers=("core", "adjacent"), hire_only=True,
                     titles=("Management Analysts", "Operations Research Analysts"))


def match_sql(keywords, cols=LCA_TITLES) -> str:
    pat = keyword_pattern(keywords)
    return "(" + " OR ".join(f"regexp_matches(coalesce({c}, ''), {q(pat)}, 'i')" for c in cols) + ")"


PERSONA_ROWS_SQL = ", pm AS (" + "\n  UNION ALL ".join(
    f"SELECT {q(p)} AS persona, * FROM lca_e WHERE {match_sql(k)}" for p, k in PERSONA_KEYWORDS.items()) + ")"


def _matched(spark, sf_dir):
    return search.persona_matches(_ds(spark, sf_dir).lca, LCA_TITLES)


# -- Q1 - Q5 ----------------------------------------------------------------------------


@register("q1_keyword_search_lca", f"""
SELECT SOC_TITLE, JOB_TITLE, count(*) AS filings FROM lca_e WHERE {match_sql(PERSONA_KEYWORDS[FINANCE])} GROUP BY 1, 2""")
def q1_keyword_search_lca(spark, sf_dir):
    hit = search.keyword_search(_ds(spark, sf_dir).lca, PERSONA_KEYWORDS[FINANCE], LCA_TITLES)
    return hit.groupBy("SOC_TITLE", "JOB_TITLE").agg(F.count(F.lit(1)).alias("filings"))


@register("q1_keyword_search_perm", f"""
SELECT PWD_SOC_TITLE, count(*) AS filings FROM perm_e
WHERE {match_sql(PERSONA_KEYWORDS['supply_chain_ops'], ('PWD_SOC_TITLE', 'JOB_TITLE'))} GROUP BY 1""")
def q1_keyword_search_perm(spark, sf_dir):
    hit = search.keyword_search(_ds(spark, sf_dir).perm, PERSONA_KEYWORDS["supply_chain_ops"], PERM.title_cols)
    return hit.groupBy("PWD_SOC_TITLE").agg(F.count(F.lit(1)).alias("filings"))


SUGGEST_SQL = """
SELECT SOC_TITLE, count(*) AS filings FROM lca_e
WHERE (coalesce(contains(lower(SOC_TITLE), 'anvil'), false) OR coalesce(contains(lower(JOB_TITLE), 'anvil'), false))
  AND SOC_TITLE IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, SOC_TITLE LIMIT 25"""


@register("q2_title_suggest_lca", SUGGEST_SQL)
def q2_title_suggest_lca(spark, sf_dir):
    return search.title_suggest(_ds(spark, sf_dir).lca, LCA, "anvil")


@register("q2_title_index_lca", SUGGEST_SQL)
def q2_title_index_lca(spark, sf_dir):
    """The titles' gram index is written, the suggestion looked up in it; the index goes once the result is stored."""
    path = scratch_path(spark, "title-index")
    search.write_title_index(_ds(spark, sf_dir).lca, LCA, path)
    out = stored(search.indexed_suggest(spark, path, LCA, "anvil"))
    delete_path(spark, path)
    return out


@register("q2_title_suggest_small_ring_lca", """
SELECT SOC_TITLE, count(*) AS filings FROM lca_e
WHERE (coalesce(contains(lower(SOC_TITLE), 'small ring'), false) OR coalesce(contains(lower(JOB_TITLE), 'small ring'), false))
  AND SOC_TITLE IS NOT NULL
GROUP BY 1 ORDER BY filings DESC, SOC_TITLE LIMIT 25""")
def q2_title_suggest_small_ring_lca(spark, sf_dir):
    return search.title_suggest(_ds(spark, sf_dir).lca, LCA, "Small Ring")


@register("q3_search_summary_lca", f"""
, t AS (SELECT MBA_TIER AS tier, count(*) FILTER (WHERE {match_sql(PERSONA_KEYWORDS[FINANCE])}) AS tier_filings,
               count(*) AS n FROM lca_e GROUP BY 1)
SELECT tier, tier_filings, CAST(sum(tier_filings) OVER () AS BIGINT) AS matched_filings,
       CAST(sum(tier_filings) OVER () AS DOUBLE) / sum(n) OVER () AS share_of_total
FROM t QUALIFY tier_filings > 0 AND tier IS NOT NULL""")
def q3_search_summary_lca(spark, sf_dir):
    return search.search_summary(_ds(spark, sf_dir).lca, PERSONA_KEYWORDS[FINANCE], LCA_TITLES)


@register("q3_no_match_lca", """
SELECT CAST(NULL AS VARCHAR) AS tier, CAST(0 AS BIGINT) AS tier_filings, CAST(0 AS BIGINT) AS matched_filings,
       CAST(0 AS DOUBLE) AS share_of_total
WHERE NOT EXISTS (SELECT 1 FROM lca_e WHERE SOC_TITLE LIKE '%no such occupation%')""")
def q3_no_match_lca(spark, sf_dir):
    return search.search_summary(_ds(spark, sf_dir).lca, ("no such occupation",), LCA_TITLES)


@register("q4_faceted_filter_lca", f"""
SELECT CASE_NUMBER, SOURCE_FILE, SOC_TITLE, WORKSITE_STATE, NAICS_SECTOR, WAGE_LEVEL FROM lca_e
WHERE MBA_TIER IN {in_list(LCA_FACETS.tiers)} AND HAS_NEW_OR_TRANSFER_POSITION
  AND WORKSITE_STATE IN {in_list(LCA_FACETS.states)} AND NAICS_SECTOR IN {in_list(LCA_FACETS.sectors)}
  AND WAGE_LEVEL IN {in_list(LCA_FACETS.wage_levels)}""")
def q4_faceted_filter_lca(spark, sf_dir):
    f = search.faceted_filter(_ds(spark, sf_dir).lca, LCA, LCA_FACETS)
    return f.select("CASE_NUMBER", "SOURCE_FILE", "SOC_TITLE", "WORKSITE_STATE", "NAICS_SECTOR", "WAGE_LEVEL")


@register("q4_faceted_filter_perm", f"""
SELECT CASE_NUMBER, PWD_SOC_TITLE, PRIMARY_WORKSITE_STATE, NAICS_SECTOR FROM perm_e
WHERE MBA_TIER IN {in_list(PERM_FACETS.tiers)} AND IS_EXTERNAL_HIRE AND PWD_SOC_TITLE IN {in_list(PERM_FACETS.titles)}""")
def q4_faceted_filter_perm(spark, sf_dir):
    f = search.faceted_filter(_ds(spark, sf_dir).perm, PERM, PERM_FACETS)
    return f.select("CASE_NUMBER", "PWD_SOC_TITLE", "PRIMARY_WORKSITE_STATE", "NAICS_SECTOR")


@register("q5_facet_values_lca", """
SELECT DISTINCT facet, value FROM (
  SELECT 'state' AS facet, WORKSITE_STATE AS value FROM lca_e
  UNION ALL SELECT 'sector', NAICS_SECTOR FROM lca_e
  UNION ALL SELECT 'wage_level', WAGE_LEVEL FROM lca_e) WHERE value IS NOT NULL""")
def q5_facet_values_lca(spark, sf_dir):
    return search.facet_values(_ds(spark, sf_dir).lca, LCA)


@register("q5_facet_values_perm", """
SELECT DISTINCT facet, value FROM (
  SELECT 'state' AS facet, PRIMARY_WORKSITE_STATE AS value FROM perm_e
  UNION ALL SELECT 'sector', NAICS_SECTOR FROM perm_e) WHERE value IS NOT NULL""")
def q5_facet_values_perm(spark, sf_dir):
    return search.facet_values(_ds(spark, sf_dir).perm, PERM)


# -- Q6 - Q9 personas ----------------------------------------------------------------------

CATALOG_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {q(p)} AS persona, count(*) FILTER (WHERE {match_sql(k)}) AS matched_filings, "
    f"CAST(count(*) FILTER (WHERE {match_sql(k)}) AS DOUBLE) / count(*) AS share_of_total FROM lca_e"
    for p, k in PERSONA_KEYWORDS.items()) + ")"


@register("q6_persona_catalog_lca", CATALOG_SQL)
def q6_persona_catalog_lca(spark, sf_dir):
    return search.persona_catalog(_ds(spark, sf_dir).lca, LCA_TITLES)


@register("q7_persona_tiers_lca", PERSONA_ROWS_SQL + "\nSELECT persona, MBA_TIER, count(*) AS filings FROM pm GROUP BY 1, 2")
def q7_persona_tiers_lca(spark, sf_dir):
    return _matched(spark, sf_dir).groupBy("persona", "MBA_TIER").agg(F.count(F.lit(1)).alias("filings"))


@register("q7_persona_fiscal_years_lca", PERSONA_ROWS_SQL + """
SELECT persona, FISCAL_YEAR, count(*) AS filings FROM pm WHERE FISCAL_QUARTER <= 3 AND FISCAL_YEAR IS NOT NULL GROUP BY 1, 2""")
def q7_persona_fiscal_years_lca(spark, sf_dir):
    return search.persona_fy_counts(_matched(spark, sf_dir))


def _top_sql(col: str, k: int, min_count: int = 1) -> str:
    having = f" HAVING count(*) >= {min_count}" if min_count > 1 else ""
    return PERSONA_ROWS_SQL + f"""
, c AS (SELECT persona, {col}, count(*) AS filings FROM pm WHERE {col} IS NOT NULL GROUP BY 1, 2{having})
SELECT persona, {col}, filings, CAST(row_number() OVER (PARTITION BY persona ORDER BY filings DESC, {col}) AS INTEGER) AS rank
FROM c QUALIFY rank <= {k}"""


@register("q7_persona_top_occupations_lca", _top_sql("SOC_TITLE", 10))
def q7_persona_top_occupations_lca(spark, sf_dir):
    return search.top_per_persona(_matched(spark, sf_dir), "SOC_TITLE", 10)


@register("q7_persona_top_sectors_lca", _top_sql("NAICS_SECTOR", 8))
def q7_persona_top_sectors_lca(spark, sf_dir):
    return search.top_per_persona(_matched(spark, sf_dir), "NAICS_SECTOR", 8)


@register("q7_persona_top_employers_lca", _top_sql("EMPLOYER_CANONICAL", 15, min_count=3))
def q7_persona_top_employers_lca(spark, sf_dir):
    return search.top_per_persona(_matched(spark, sf_dir), "EMPLOYER_CANONICAL", 15, min_count=3)


@register("q7_persona_top_states_lca", _top_sql("WORKSITE_STATE", 10))
def q7_persona_top_states_lca(spark, sf_dir):
    return search.top_per_persona(_matched(spark, sf_dir), "WORKSITE_STATE", 10)


@register("q7_persona_wages_lca", PERSONA_ROWS_SQL + """
SELECT persona, count(ANNUAL_WAGE) AS wage_n, """ + pct_from_list_sql("list_sort(list(ANNUAL_WAGE))", 0.25) + """ AS p25,
       median(ANNUAL_WAGE) AS median, """ + pct_from_list_sql("list_sort(list(ANNUAL_WAGE))", 0.75) + """ AS p75
FROM pm WHERE ANNUAL_WAGE IS NOT NULL GROUP BY 1""")
def q7_persona_wages_lca(spark, sf_dir):
    return search.persona_wages(_matched(spark, sf_dir))


@register("q7_persona_wage_levels_lca", PERSONA_ROWS_SQL + """
, c AS (SELECT persona, PW_WAGE_LEVEL, count(*) AS n FROM pm WHERE PW_WAGE_LEVEL IS NOT NULL GROUP BY 1, 2)
SELECT persona, PW_WAGE_LEVEL, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY persona) AS share FROM c""")
def q7_persona_wage_levels_lca(spark, sf_dir):
    return search.persona_level_shares(_matched(spark, sf_dir))


@register("q7_persona_new_share_lca", PERSONA_ROWS_SQL + """
SELECT persona, avg(CAST(IS_NEW_EMPLOYMENT AS DOUBLE)) AS new_share FROM pm GROUP BY 1""")
def q7_persona_new_share_lca(spark, sf_dir):
    return search.persona_flag_share(_matched(spark, sf_dir), "IS_NEW_EMPLOYMENT")


@register("q8_persona_shortlist_lca", PERSONA_ROWS_SQL + """
SELECT persona, EMPLOYER_CANONICAL, count(*) AS matched_filings, median(ANNUAL_WAGE_FROM) AS median_wage
FROM pm WHERE PW_WAGE_LEVEL IN ('II', 'III') AND EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def q8_persona_shortlist_lca(spark, sf_dir):
    return search.persona_shortlist(_matched(spark, sf_dir))


@register("q9_persona_dominant_lca", PERSONA_ROWS_SQL + """
, s AS (SELECT persona, NAICS_SECTOR AS top_sector FROM pm WHERE NAICS_SECTOR IS NOT NULL GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY persona ORDER BY count(*) DESC, NAICS_SECTOR) = 1),
o AS (SELECT persona, SOC_TITLE AS top_occupation FROM pm WHERE SOC_TITLE IS NOT NULL GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY persona ORDER BY count(*) DESC, SOC_TITLE) = 1)
SELECT coalesce(s.persona, o.persona) AS persona, top_sector, top_occupation FROM s FULL OUTER JOIN o ON s.persona = o.persona""")
def q9_persona_dominant_lca(spark, sf_dir):
    return search.persona_dominant(_matched(spark, sf_dir))
