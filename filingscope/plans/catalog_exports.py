"""The 18 dashboard exports (S6), written as files from one pass over each dataset and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.operators.exports import export_tables
from filingscope.plans.catalog_entities import MATCH_SQL
from filingscope.plans.catalog_search import FINANCE, PERSONA_ROWS_SQL
from filingscope.plans.catalog_stats import CERT_RATE_SQL, LEVEL_COUNTS, MIX_SQL, _ds
from filingscope.plans.registry import register
from filingscope.session import delete_path, scratch_path
from filingscope.sources.sinks import read_export, write_exports

COUNT_SQL = "SELECT {c}, count(*) AS filings FROM {t} WHERE {c} IS NOT NULL GROUP BY 1"
RELEVANT = "count(*) FILTER (WHERE MBA_TIER <> 'excluded')"
EMPLOYER_SQL = f"""
SELECT EMPLOYER_CANONICAL, count(MBA_TIER) AS total_filings, {RELEVANT} AS mba_relevant_filings,
       avg(CASE WHEN CASE_STATUS IS DISTINCT FROM 'Denied' THEN 1.0 ELSE 0.0 END) AS certified, {{extra}},
       CAST({RELEVANT} AS DOUBLE) / nullif(count(MBA_TIER), 0) AS mba_share
FROM {{t}} WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1 HAVING {RELEVANT} >= {{least}}"""
LCA_EXTRA = """avg(CAST(IS_NEW_HIRE AS DOUBLE)) AS new_position_share, median(ANNUAL_WAGE_FROM) AS median_annual_wage,
       bool_or(coalesce(WILLFUL_VIOLATOR = 'Y', false)) AS any_willful_violator,
       bool_or(coalesce(H_1B_DEPENDENT = 'Y', false)) AS any_h1b_dependent"""
PERM_EXTRA = """avg(CASE WHEN OTHER_REQ_IS_FW_CURRENTLY_WRK = 'N' THEN 1.0 ELSE 0.0 END) AS external_hire_share,
       median(EMP_NUM_PAYROLL) AS median_company_payroll"""
LCA_MEASURES = ["total_filings", "mba_relevant_filings", "certified", "new_position_share", "median_annual_wage",
                "any_willful_violator", "any_h1b_dependent", "mba_share"]
PERM_MEASURES = ["total_filings", "mba_relevant_filings", "certified", "external_hire_share", "median_company_payroll", "mba_share"]


def _score(t: str, by: str, cert: bool, median: bool) -> str:
    return (f"SELECT {by}, count(*) AS filings" + f", {CERT_RATE_SQL} AS cert_rate" * cert
            + ", median(ANNUAL_WAGE) AS median_annual_wage" * median + f" FROM {t} WHERE {by} IS NOT NULL GROUP BY 1")


def _top(c: str, t: str) -> str:
    return COUNT_SQL.format(c=c, t=t) + f" ORDER BY filings DESC, {c} LIMIT 200"


E = "EMPLOYER_CANONICAL"
# export -> (SQL, key column, measures)
EXPORTS = {
    "lca_top_occupations": (COUNT_SQL.format(c="SOC_TITLE", t="lca_e"), "SOC_TITLE", ["filings"]),
    "perm_top_occupations": (COUNT_SQL.format(c="PWD_SOC_TITLE", t="perm_e"), "PWD_SOC_TITLE", ["filings"]),
    "lca_top_employers": (_top(E, "lca_e"), E, ["filings"]),
    "perm_top_employers": (_top(E, "perm_e"), E, ["filings"]),
    "lca_employer_mba_mix": (MIX_SQL.format(t="lca_e"), E, ["total", "mba_relevant", "mba_share"]),
    "perm_employer_mba_mix": (MIX_SQL.format(t="perm_e"), E, ["total", "mba_relevant", "mba_share"]),
    "lca_mba_occupations": (COUNT_SQL.format(c="SOC_TITLE", t="lca_mba"), "SOC_TITLE", ["filings"]),
    "perm_mba_occupations": (COUNT_SQL.format(c="PWD_SOC_TITLE", t="perm_mba"), "PWD_SOC_TITLE", ["filings"]),
    "lca_mba_states": (COUNT_SQL.format(c="WORKSITE_STATE", t="lca_mba"), "WORKSITE_STATE", ["filings"]),
    "lca_sector_scorecard": (_score("lca_mba", "NAICS_SECTOR", True, True), "NAICS_SECTOR", ["filings", "cert_rate", "median_annual_wage"]),
    "perm_sector_scorecard": (_score("perm_mba", "NAICS_SECTOR", True, False), "NAICS_SECTOR", ["filings", "cert_rate"]),
    "lca_state_scorecard": (_score("lca_mba", "WORKSITE_STATE", False, True), "WORKSITE_STATE", ["filings", "median_annual_wage"]),
    "perm_state_scorecard": (_score("perm_mba", "PRIMARY_WORKSITE_STATE", False, False), "PRIMARY_WORKSITE_STATE", ["filings"]),
    "lca_wage_level_by_occupation": (
        f"SELECT SOC_TITLE, {LEVEL_COUNTS}, count(*) FILTER (WHERE PW_WAGE_LEVEL IN ('I', 'II', 'III', 'IV')) AS total "
        "FROM lca_mba WHERE SOC_TITLE IS NOT NULL AND PW_WAGE_LEVEL IS NOT NULL GROUP BY 1", "SOC_TITLE", ["I", "II", "III", "IV", "total"]),
    "lca_employer_scorecard": (EMPLOYER_SQL.format(t="lca_e", extra=LCA_EXTRA, least=10), E, LCA_MEASURES),
    "perm_employer_scorecard": (EMPLOYER_SQL.format(t="perm_e", extra=PERM_EXTRA, least=5), E, PERM_MEASURES),
    "employer_lca_perm_pipeline": ("SELECT * FROM mm", "employer_core_key", ["lca_filings", "perm_filings", "sponsors_both"]),
    "persona_finance_risk_shortlist": (
        f"SELECT {E}, count(*) AS matched_filings, median(ANNUAL_WAGE_FROM) AS median_wage FROM pm WHERE persona = '{FINANCE}' "
        f"AND PW_WAGE_LEVEL IN ('II', 'III') AND {E} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2", E, ["matched_filings", "median_wage"]),
}
NAMES = ["lca_canonical_name", "perm_canonical_name"]  # the texts of the pipeline export


def _long_sql(name: str) -> str:
    body, key, measures = EXPORTS[name]
    texts = NAMES if name == "employer_lca_perm_pipeline" else []
    values = [f'CAST("{m}" AS DOUBLE)' for m in measures] + ["CAST(NULL AS DOUBLE)"] * len(texts)
    words = ["CAST(NULL AS VARCHAR)"] * len(measures) + texts
    return (f"SELECT '{name}' AS export, {key} AS key, unnest([{', '.join(repr(m) for m in measures + texts)}]) AS measure, "
            f"unnest([{', '.join(values)}]) AS value, unnest([{', '.join(words)}]) AS words FROM ({body}) {name}")


def _long(name: str, df: DataFrame) -> DataFrame:
    _, key, measures = EXPORTS[name]
    rows = [F.struct(F.lit(c).alias("measure"), (F.lit(None) if c in NAMES else F.col(c)).cast("double").alias("value"),
                     (F.col(c) if c in NAMES else F.lit(None)).cast("string").alias("words")) for c in df.columns if c != key]
    return df.select(F.lit(name).alias("export"), F.col(key).alias("key"), F.explode(F.array(*rows)).alias("x")).select("export", "key", "x.*")


@register("s6_all_exports", PERSONA_ROWS_SQL + MATCH_SQL + "\n" + "\nUNION ALL ".join(_long_sql(n) for n in EXPORTS))
def s6_all_exports(spark, sf_dir):
    """Every export is written as CSV files and read back: (export, key, measure, value, words) of all their cells."""
    ds = _ds(spark, sf_dir)
    path = scratch_path(spark, "exports")
    tables = export_tables(ds.lca, ds.perm)
    write_exports(tables, path)
    read = [_long(name, read_export(spark, path, name, df.schema)) for name, df in tables.items()]
    out = reduce(lambda a, b: a.unionByName(b), read)
    from filingscope.operators.distribution import stored
    result = stored(out)  # the files are no longer needed
    delete_path(spark, path)
    return result
