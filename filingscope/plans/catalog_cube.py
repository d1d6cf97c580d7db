"""Registered cube queries (K1-K7) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import cube, cube_refresh, ingest, stats
from filingscope.plans.catalog_stats import BASE_FY, NEXT_FY, _ds
from filingscope.plans.oracle_base import core_sql
from filingscope.plans.enrich import shared_employer_map
from filingscope.plans.registry import register
from filingscope.session import discard, scratch_path
from filingscope.sources import testbind
from filingscope.spec import LCA, PERM

SLICE_SECTORS = ("Finance and Insurance", "Professional, Scientific, and Technical Services")


def cube_sql(p: str, src: str, occ: str, state: str, flag: str, wage_level: bool) -> str:
    """CTEs {p}_occ, {p}_emp, {p}_st, {p}_sec, {p}_cube for one dataset."""
    wl_key = ", WAGE_LEVEL" if wage_level else ""
    wl_col = ("CAST(coalesce(list_position(['I', 'II', 'III', 'IV', 'Unspecified'], WAGE_LEVEL) - 1, 4) AS INTEGER) "
              "AS wage_level, ") if wage_level else ""
    flag_name = "new_hire" if wage_level else "external_hire"
    return f"""
, {p}_occ_all AS (SELECT {occ} AS OCC_TITLE, count(*) AS filings FROM {src} WHERE {occ} IS NOT NULL GROUP BY 1),
{p}_occ0 AS (SELECT OCC_TITLE, filings, CAST(row_number() OVER (ORDER BY filings DESC, OCC_TITLE) - 1 AS INTEGER) AS occ_idx
             FROM {p}_occ_all ORDER BY filings DESC, OCC_TITLE LIMIT 150),
{p}_tier AS (SELECT {occ} AS OCC_TITLE, MBA_TIER AS tier FROM {src} WHERE {occ} IS NOT NULL GROUP BY 1, 2
             QUALIFY row_number() OVER (PARTITION BY {occ} ORDER BY count(*) DESC, MBA_TIER) = 1),
{p}_occ AS (SELECT o.*, coalesce(t.tier, 'adjacent') AS tier FROM {p}_occ0 o LEFT JOIN {p}_tier t ON t.OCC_TITLE = o.OCC_TITLE),
{p}_emp AS (SELECT EMPLOYER_CANONICAL, count(*) AS filings,
                   CAST(row_number() OVER (ORDER BY count(*) DESC, EMPLOYER_CANONICAL) - 1 AS INTEGER) AS emp_idx
            FROM {src} WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
{p}_st AS (SELECT STATE, CAST(row_number() OVER (ORDER BY STATE) - 1 AS INTEGER) AS state_idx
           FROM (SELECT DISTINCT {state} AS STATE FROM {src} WHERE {state} IS NOT NULL)),
{p}_sec AS (SELECT NAICS_SECTOR, CAST(row_number() OVER (ORDER BY NAICS_SECTOR) - 1 AS INTEGER) AS sector_idx
            FROM (SELECT DISTINCT NAICS_SECTOR FROM {src} WHERE NAICS_SECTOR IS NOT NULL)),
{p}_cells AS (SELECT {occ} AS OCC_TITLE, EMPLOYER_CANONICAL, {state} AS STATE, NAICS_SECTOR{wl_key}, {flag} AS flag,
                     count(*) AS filings, count(*) FILTER (WHERE CERTIFIED) AS certified,
                     count(*) FILTER (WHERE DECIDED) AS decided,
                     floor(coalesce(sum(ANNUAL_WAGE), 0.0) * 100.0 + 0.5) / 100.0 AS wage_sum,
                     count(ANNUAL_WAGE) AS wage_n
              FROM {src} WHERE {state} IS NOT NULL AND EMPLOYER_CANONICAL IS NOT NULL
                AND {occ} IN (SELECT OCC_TITLE FROM {p}_occ0)
              GROUP BY ALL),
{p}_cube AS (SELECT o.occ_idx AS occ, e.emp_idx AS emp, coalesce(s.state_idx, -1) AS state,
                    coalesce(x.sector_idx, -1) AS sector, {wl_col}CAST(c.flag AS INTEGER) AS {flag_name},
                    c.filings, c.certified, c.decided, c.wage_sum, c.wage_n
             FROM {p}_cells c JOIN {p}_emp e ON e.EMPLOYER_CANONICAL = c.EMPLOYER_CANONICAL
             JOIN {p}_occ0 o ON o.OCC_TITLE = c.OCC_TITLE
             LEFT JOIN {p}_st s ON s.STATE = c.STATE LEFT JOIN {p}_sec x ON x.NAICS_SECTOR = c.NAICS_SECTOR)"""


LCA_CUBE = cube_sql("l", "lca_mba", "SOC_TITLE", "WORKSITE_STATE", "IS_NEW_HIRE", True)
PERM_CUBE = cube_sql("p", "perm_mba", "PWD_SOC_TITLE", "PRIMARY_WORKSITE_STATE", "IS_EXTERNAL_HIRE", False)
CUBE_COLS = "occ, emp, state, sector, {x}, filings, certified, decided, wage_sum, wage_n"


def _lca_cube(ds):
    return cube.build_cube(ds.lca_mba(), LCA, with_wage_level=True)


def _perm_cube(ds):
    return cube.build_cube(ds.perm_mba(), PERM, with_wage_level=False)


@register("k1_occupation_dim_lca", LCA_CUBE + "\nSELECT OCC_TITLE, filings, occ_idx, tier FROM l_occ")
def k1_occupation_dim_lca(spark, sf_dir):
    return cube.cube_dims(_ds(spark, sf_dir).lca_mba(), LCA).occupations


@register("k1_employer_dim_lca", LCA_CUBE + "\nSELECT EMPLOYER_CANONICAL, filings, emp_idx FROM l_emp")
def k1_employer_dim_lca(spark, sf_dir):
    return cube.cube_dims(_ds(spark, sf_dir).lca_mba(), LCA).employers


@register("k1_employer_dim_perm", PERM_CUBE + "\nSELECT EMPLOYER_CANONICAL, filings, emp_idx FROM p_emp")
def k1_employer_dim_perm(spark, sf_dir):
    return cube.cube_dims(_ds(spark, sf_dir).perm_mba(), PERM).employers


@register("k1_state_sector_dims_lca", LCA_CUBE + """
SELECT 'state' AS dim, STATE AS value, state_idx AS idx FROM l_st
UNION ALL SELECT 'sector', NAICS_SECTOR, sector_idx FROM l_sec""")
def k1_state_sector_dims_lca(spark, sf_dir):
    d = cube.cube_dims(_ds(spark, sf_dir).lca_mba(), LCA)
    return d.states.select(F.lit("state").alias("dim"), F.col("STATE").alias("value"), F.col("state_idx").alias("idx")) \
        .unionByName(d.sectors.select(F.lit("sector").alias("dim"), F.col("NAICS_SECTOR").alias("value"),
                                      F.col("sector_idx").alias("idx")))


@register("k2_lca_cube", LCA_CUBE + "\nSELECT " + CUBE_COLS.format(x="wage_level, new_hire") + " FROM l_cube")
def k2_lca_cube(spark, sf_dir):
    return _lca_cube(_ds(spark, sf_dir))[1]


@register("k3_perm_cube", PERM_CUBE + "\nSELECT " + CUBE_COLS.format(x="external_hire") + " FROM p_cube")
def k3_perm_cube(spark, sf_dir):
    return _perm_cube(_ds(spark, sf_dir))[1]


@register("k2_incremental_lca", LCA_CUBE + "\nSELECT " + CUBE_COLS.format(x="wage_level, new_hire") + " FROM l_cube")
def k2_incremental_lca(spark, sf_dir):
    """The cube after the LCA exports came one by one, oldest first, the last one twice."""
    master, cells = scratch_path(spark, "cube-master"), scratch_path(spark, "cube-cells")
    raw = testbind.lca_raw(spark, sf_dir)
    rows = ingest.add_fiscal_calendar(raw)
    orders = sorted(r[0] for r in rows.select("SOURCE_ORD").distinct().collect())  # one a listed export
    for number, order in [*enumerate(orders), (len(orders) - 1, orders[-1])]:
        cube_refresh.take_export(spark, rows.where(F.col("SOURCE_ORD") == order), master, cells, number, LCA, here=True)
    discard(raw)
    names = shared_employer_map(spark, spark.read.parquet(master), _ds(spark, sf_dir).perm_master)
    return cube_refresh.refreshed_cube(spark, cells, names)[1]


@register("k4_cube_coverage", LCA_CUBE + PERM_CUBE + """
SELECT 'lca' AS dataset, (SELECT count(*) FROM lca_mba) AS mba_total, CAST(sum(filings) AS BIGINT) AS cube_filings,
       CAST(sum(filings) AS DOUBLE) / (SELECT count(*) FROM lca_mba) AS coverage FROM l_cube
UNION ALL
SELECT 'perm', (SELECT count(*) FROM perm_mba), CAST(sum(filings) AS BIGINT),
       CAST(sum(filings) AS DOUBLE) / (SELECT count(*) FROM perm_mba) FROM p_cube""")
def k4_cube_coverage(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    lca = cube.cube_coverage(_lca_cube(ds)[1], ds.unnamed_mba(LCA), "lca")
    perm = cube.cube_coverage(_perm_cube(ds)[1], ds.unnamed_mba(PERM), "perm")
    return lca.unionByName(perm)


@register("k5_employer_meta", LCA_CUBE + PERM_CUBE + """
, m_n AS (SELECT EMPLOYER_CANONICAL AS name, count(*) AS n, side FROM (
            SELECT EMPLOYER_CANONICAL, 'l' AS side FROM lca_mba UNION ALL SELECT EMPLOYER_CANONICAL, 'p' FROM perm_mba)
          WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1, 3),
m_k AS (SELECT *, """ + core_sql("name") + """ AS k FROM m_n),
m_best AS (SELECT side, k, name FROM m_k QUALIFY row_number() OVER (PARTITION BY side, k ORDER BY n DESC, name) = 1),
m_both_keys AS (SELECT k FROM m_k GROUP BY k HAVING count(DISTINCT side) = 2),
both_names AS (SELECT DISTINCT name FROM m_best JOIN m_both_keys USING (k)),
emps AS (SELECT EMPLOYER_CANONICAL FROM l_emp UNION SELECT EMPLOYER_CANONICAL FROM p_emp),
ls AS (SELECT EMPLOYER_CANONICAL, count(*) AS lt, count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS lm,
              bool_or(coalesce(WILLFUL_VIOLATOR = 'Y', false)) AS wv, bool_or(coalesce(H_1B_DEPENDENT = 'Y', false)) AS dep
       FROM lca_e WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1),
ps AS (SELECT EMPLOYER_CANONICAL, count(*) AS pt, count(*) FILTER (WHERE MBA_TIER <> 'excluded') AS pm,
              median(EMP_NUM_PAYROLL) AS pay FROM perm_e WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1)
SELECT e.EMPLOYER_CANONICAL, b.name IS NOT NULL AS both_pipelines, coalesce(ls.wv, false) AS willful_violator,
       coalesce(ls.dep, false) AS h1b_dependent, CAST(trunc(ps.pay) AS BIGINT) AS median_payroll,
       CAST(ls.lm AS DOUBLE) / ls.lt AS lca_mba_share, CAST(ps.pm AS DOUBLE) / ps.pt AS perm_mba_share
FROM emps e LEFT JOIN ls ON ls.EMPLOYER_CANONICAL = e.EMPLOYER_CANONICAL
LEFT JOIN ps ON ps.EMPLOYER_CANONICAL = e.EMPLOYER_CANONICAL LEFT JOIN both_names b ON b.name = e.EMPLOYER_CANONICAL""")
def k5_employer_meta(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return cube.employer_meta(ds.lca, ds.perm)


K6_SQL = f"""
, g AS (SELECT ds, MBA_TIER, count(*) FILTER (WHERE FISCAL_YEAR = {BASE_FY}) AS base_filings,
               count(*) FILTER (WHERE FISCAL_YEAR = {NEXT_FY}) AS next_filings
        FROM (SELECT 'lca' AS ds, MBA_TIER, FISCAL_YEAR, FISCAL_QUARTER FROM lca_mba
              UNION ALL SELECT 'perm', MBA_TIER, FISCAL_YEAR, FISCAL_QUARTER FROM perm_mba)
        WHERE FISCAL_QUARTER <= 3 GROUP BY 1, 2),
h AS (SELECT *, sum(base_filings) OVER (PARTITION BY ds) > 0 AND sum(next_filings) OVER (PARTITION BY ds) > 0 AS both_years FROM g)
SELECT ds AS dataset, MBA_TIER, base_filings, next_filings, (CAST(next_filings AS DOUBLE) / base_filings - 1) * 100 AS pct_change
FROM h WHERE MBA_TIER IN ('core', 'adjacent') AND both_years AND base_filings > 0"""


@register("k6_cube_yoy", K6_SQL)
def k6_cube_yoy(spark, sf_dir):
    return cube_yoy(_ds(spark, sf_dir))


def cube_yoy(ds):
    a = stats.yoy_by_tier(ds.unnamed_mba(LCA), BASE_FY, NEXT_FY, tiers=("core", "adjacent"))
    b = stats.yoy_by_tier(ds.unnamed_mba(PERM), BASE_FY, NEXT_FY, tiers=("core", "adjacent"))
    return a.select(F.lit("lca").alias("dataset"), "*").unionByName(b.select(F.lit("perm").alias("dataset"), "*"))


@register("k7_cube_slice_lca", LCA_CUBE + f"""
, sl AS (SELECT c.* FROM l_cube c JOIN l_sec s ON s.sector_idx = c.sector
         WHERE s.NAICS_SECTOR IN ('Finance and Insurance', 'Professional, Scientific, and Technical Services')
           AND c.wage_level IN (0, 1))
SELECT sl.emp, e.EMPLOYER_CANONICAL, CAST(sum(sl.filings) AS BIGINT) AS filings,
       CAST(sum(certified) AS DOUBLE) / nullif(sum(decided), 0) AS cert_rate,
       CAST(sum(CASE WHEN new_hire = 1 THEN sl.filings ELSE 0 END) AS DOUBLE) / nullif(sum(sl.filings), 0) AS flag_share,
       CAST(sum(floor(wage_sum * 100 + 0.5)) AS DOUBLE) / nullif(sum(wage_n), 0) / 100 AS mean_wage
FROM sl JOIN l_emp e ON e.emp_idx = sl.emp GROUP BY 1, 2""")
def k7_cube_slice_lca(spark, sf_dir):
    dims, facts = _lca_cube(_ds(spark, sf_dir))
    sector_idx = dims.sectors.where(F.col("NAICS_SECTOR").isin(*SLICE_SECTORS)).select("sector_idx")
    sliced = facts.join(F.broadcast(sector_idx.withColumnRenamed("sector_idx", "sector")), "sector", "left_semi")
    return cube.cube_slice(sliced, dims.employers, wage_levels=(0, 1))
