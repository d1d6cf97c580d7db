"""Registered classification (D1-D13) and entity-resolution (E1-E9) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.functions.classify import bucket_other
from filingscope.functions.flags import search_link, yes_label
from filingscope.functions.wages import round_half_up
from filingscope.operators import entities, name_map
from filingscope.plans.catalog_stats import APP_LCA, LINK_SQL, _app, _ds
from filingscope.plans.oracle_base import clean_sql, core_sql, strip_sql
from filingscope.plans.registry import register
from filingscope.session import landed, scratch_path

# Allow-list used to exercise the "bucket everything else as Other" operator.
BUCKET_STATES = ("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5")


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("filings"))


# -- D classification ------------------------------------------------------------------


@register("d1_mba_tier_lca", "SELECT SOC_CODE, SOC_TITLE, MBA_TIER, count(*) AS filings FROM lca_e GROUP BY 1, 2, 3")
def d1_mba_tier_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "SOC_CODE", "SOC_TITLE", "MBA_TIER")


@register("d1_mba_tier_perm", "SELECT PWD_SOC_CODE, PWD_SOC_TITLE, MBA_TIER, count(*) AS filings FROM perm_e GROUP BY 1, 2, 3")
def d1_mba_tier_perm(spark, sf_dir):
    return _count(_ds(spark, sf_dir).perm, "PWD_SOC_CODE", "PWD_SOC_TITLE", "MBA_TIER")


@register("d2_naics_sector_lca", "SELECT NAICS_CODE, NAICS_SECTOR, count(*) AS filings FROM lca_e GROUP BY 1, 2")
def d2_naics_sector_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "NAICS_CODE", "NAICS_SECTOR")


@register("d2_naics_sector_perm", "SELECT EMP_NAICS, NAICS_SECTOR, count(*) AS filings FROM perm_e GROUP BY 1, 2")
def d2_naics_sector_perm(spark, sf_dir):
    return _count(_ds(spark, sf_dir).perm, "EMP_NAICS", "NAICS_SECTOR")


@register("d3_annual_wage_lca", """
SELECT WAGE_UNIT_OF_PAY, count(*) AS filings, count(ANNUAL_WAGE_FROM) AS annualized,
       floor(sum(ANNUAL_WAGE_FROM) * 100.0 + 0.5) / 100.0 AS annual_sum, min(ANNUAL_WAGE_FROM) AS annual_min, max(ANNUAL_WAGE_FROM) AS annual_max
FROM lca_e GROUP BY 1""")
def d3_annual_wage_lca(spark, sf_dir):
    return _ds(spark, sf_dir).lca.groupBy("WAGE_UNIT_OF_PAY").agg(
        F.count(F.lit(1)).alias("filings"), F.count("ANNUAL_WAGE_FROM").alias("annualized"),
        round_half_up(F.sum("ANNUAL_WAGE_FROM"), 2).alias("annual_sum"),
        F.min("ANNUAL_WAGE_FROM").alias("annual_min"), F.max("ANNUAL_WAGE_FROM").alias("annual_max"))


@register("d4_wage_bounds_lca", """
SELECT WAGE_UNIT_OF_PAY, count(ANNUAL_WAGE) AS kept, count(ANNUAL_WAGE_FROM) - count(ANNUAL_WAGE) AS out_of_bounds,
       min(ANNUAL_WAGE) AS kept_min, max(ANNUAL_WAGE) AS kept_max
FROM lca_e GROUP BY 1""")
def d4_wage_bounds_lca(spark, sf_dir):
    return _ds(spark, sf_dir).lca.groupBy("WAGE_UNIT_OF_PAY").agg(
        F.count("ANNUAL_WAGE").alias("kept"),
        (F.count("ANNUAL_WAGE_FROM") - F.count("ANNUAL_WAGE")).alias("out_of_bounds"),
        F.min("ANNUAL_WAGE").alias("kept_min"), F.max("ANNUAL_WAGE").alias("kept_max"))


@register("d4_wage_bounds_perm", """
SELECT JOB_OPP_WAGE_PER, count(ANNUAL_WAGE) AS kept, count(ANNUAL_WAGE_FROM) - count(ANNUAL_WAGE) AS out_of_bounds,
       min(ANNUAL_WAGE) AS kept_min, max(ANNUAL_WAGE) AS kept_max
FROM perm_e GROUP BY 1""")
def d4_wage_bounds_perm(spark, sf_dir):
    return _ds(spark, sf_dir).perm.groupBy("JOB_OPP_WAGE_PER").agg(
        F.count("ANNUAL_WAGE").alias("kept"),
        (F.count("ANNUAL_WAGE_FROM") - F.count("ANNUAL_WAGE")).alias("out_of_bounds"),
        F.min("ANNUAL_WAGE").alias("kept_min"), F.max("ANNUAL_WAGE").alias("kept_max"))


@register("d5_new_hire_flags_lca", """
SELECT NEW_EMPLOYMENT, CHANGE_EMPLOYER, NEW_CONCURRENT_EMPLOYMENT, IS_NEW_HIRE, HAS_NEW_OR_TRANSFER_POSITION,
       IS_NEW_EMPLOYMENT, count(*) AS filings FROM lca_e GROUP BY ALL""")
def d5_new_hire_flags_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "NEW_EMPLOYMENT", "CHANGE_EMPLOYER", "NEW_CONCURRENT_EMPLOYMENT",
                  "IS_NEW_HIRE", "HAS_NEW_OR_TRANSFER_POSITION", "IS_NEW_EMPLOYMENT")


@register("d6_new_or_transfer_positions_lca",
          "SELECT NEW_OR_TRANSFER_POSITIONS, count(*) AS filings FROM lca_e GROUP BY 1")
def d6_new_or_transfer_positions_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "NEW_OR_TRANSFER_POSITIONS")


@register("d7_external_hire_perm",
          "SELECT OTHER_REQ_IS_FW_CURRENTLY_WRK, IS_EXTERNAL_HIRE, count(*) AS filings FROM perm_e GROUP BY 1, 2")
def d7_external_hire_perm(spark, sf_dir):
    return _count(_ds(spark, sf_dir).perm, "OTHER_REQ_IS_FW_CURRENTLY_WRK", "IS_EXTERNAL_HIRE")


@register("d8_decided_certified_lca", "SELECT CASE_STATUS, DECIDED, CERTIFIED, count(*) AS filings FROM lca_e GROUP BY 1, 2, 3")
def d8_decided_certified_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "CASE_STATUS", "DECIDED", "CERTIFIED")


@register("d8_decided_certified_perm", "SELECT CASE_STATUS, DECIDED, CERTIFIED, count(*) AS filings FROM perm_e GROUP BY 1, 2, 3")
def d8_decided_certified_perm(spark, sf_dir):
    return _count(_ds(spark, sf_dir).perm, "CASE_STATUS", "DECIDED", "CERTIFIED")


@register("d9_wage_level_default_lca", "SELECT PW_WAGE_LEVEL, WAGE_LEVEL, count(*) AS filings FROM lca_e GROUP BY 1, 2")
def d9_wage_level_default_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca, "PW_WAGE_LEVEL", "WAGE_LEVEL")


@register("d10_visa_class_filter_lca", """
SELECT FISCAL_YEAR, count(*) AS filings FROM lca_e WHERE VISA_CLASS = 'H-1B' GROUP BY 1""")
def d10_visa_class_filter_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca_master.where(F.col("VISA_CLASS") == "H-1B"), "FISCAL_YEAR")


@register("d11_bucket_other_lca", f"""
SELECT CASE WHEN coalesce(WORKSITE_STATE IN {BUCKET_STATES}, false) THEN WORKSITE_STATE ELSE 'Other' END AS state_bucket,
       count(*) AS filings FROM lca_e GROUP BY 1""")
def d11_bucket_other_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca.select(bucket_other("WORKSITE_STATE", BUCKET_STATES).alias("state_bucket")),
                  "state_bucket")


@register("d12_search_link_lca", f"""
SELECT DISTINCT g.EMPLOYER_CANONICAL, {LINK_SQL} AS search_link
FROM lca_e g WHERE g.EMPLOYER_CANONICAL IS NOT NULL""", lca_where=APP_LCA)
def d12_search_link_lca(spark, sf_dir):
    emps = _app(spark, sf_dir).lca.select("EMPLOYER_CANONICAL").where(F.col("EMPLOYER_CANONICAL").isNotNull()).distinct()
    return emps.select("EMPLOYER_CANONICAL", search_link(F.col("EMPLOYER_CANONICAL"), F.lit("MBA")).alias("search_link"))


@register("d13_percent_and_flag_labels_lca", """
SELECT EMPLOYER_CANONICAL, avg(CAST(HAS_NEW_OR_TRANSFER_POSITION AS DOUBLE)) * 100 AS signal_pct,
       CASE WHEN bool_or(coalesce(WILLFUL_VIOLATOR = 'Y', false)) THEN 'Yes' ELSE '' END AS willful_violator,
       CASE WHEN bool_or(coalesce(H_1B_DEPENDENT = 'Y', false)) THEN 'Yes' ELSE '' END AS h1b_dependent
FROM lca_e WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1""")
def d13_percent_and_flag_labels_lca(spark, sf_dir):
    from filingscope.functions.flags import yes_flag
    g = _ds(spark, sf_dir).lca.where(F.col("EMPLOYER_CANONICAL").isNotNull()).groupBy("EMPLOYER_CANONICAL").agg(
        (F.avg(F.col("HAS_NEW_OR_TRANSFER_POSITION").cast("double")) * 100).alias("signal_pct"),
        F.bool_or(yes_flag("WILLFUL_VIOLATOR")).alias("_wv"),
        F.bool_or(yes_flag("H_1B_DEPENDENT")).alias("_dep"))
    return g.select("EMPLOYER_CANONICAL", "signal_pct", yes_label("_wv").alias("willful_violator"),
                    yes_label("_dep").alias("h1b_dependent"))


# -- E entity resolution ---------------------------------------------------------------

RAW_NAMES_SQL = """
, raw AS (SELECT EMPLOYER_NAME AS raw_name FROM lca WHERE EMPLOYER_NAME IS NOT NULL
          UNION ALL SELECT EMP_BUSINESS_NAME FROM perm WHERE EMP_BUSINESS_NAME IS NOT NULL)"""


def _raw_names(ds):
    return ds.lca_master.select(F.col("EMPLOYER_NAME").alias("name")).unionByName(
        ds.perm_master.select(F.col("EMP_BUSINESS_NAME").alias("name")))


@register("e1_clean_name", RAW_NAMES_SQL + f"""
SELECT raw_name, {clean_sql('raw_name')} AS cleaned, count(*) AS n FROM raw GROUP BY 1""")
def e1_clean_name(spark, sf_dir):
    d = entities.clean_and_core(_raw_names(_ds(spark, sf_dir)), "name")
    return d.select("raw_name", "cleaned", "n")


@register("e2_core_key", RAW_NAMES_SQL + f"""
SELECT raw_name, {core_sql('raw_name')} AS core, count(*) AS n FROM raw GROUP BY 1""")
def e2_core_key(spark, sf_dir):
    d = entities.clean_and_core(_raw_names(_ds(spark, sf_dir)), "name")
    return d.select("raw_name", "core", "n")


@register("e3_canonical_map", "SELECT raw_name, core, canonical_name, n FROM name_counts JOIN canon USING (core)")
def e3_canonical_map(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return entities.canonical_map((ds.lca_master, "EMPLOYER_NAME"), (ds.perm_master, "EMP_BUSINESS_NAME"))


def _by_source(ds):
    """The LCA filings in batches, by the export they come from."""
    rows = landed(ds.lca_master.select("CASE_NUMBER", "EMPLOYER_NAME", "SOURCE_FILE"), "batches")  # read by each batch
    files = sorted(r[0] for r in rows.select("SOURCE_FILE").distinct().collect())  # one a listed export
    return [rows.where(F.col("SOURCE_FILE") == f) for f in files]


@register("e3_incremental_map", "SELECT raw_name, core, canonical_name, n FROM name_counts JOIN canon USING (core)")
def e3_incremental_map(spark, sf_dir):
    """The map kept batch by batch: each LCA export, then PERM, whose delivery is repeated."""
    ds, path = _ds(spark, sf_dir), scratch_path(spark, "name-map")
    sources = [(df, "EMPLOYER_NAME") for df in _by_source(ds)] + [(ds.perm_master, "EMP_BUSINESS_NAME")]
    for number, source in [*enumerate(sources), (len(sources) - 1, sources[-1])]:
        name_map.add_spellings(spark, path, number, entities.spelling_counts(source))
    return name_map.name_map(spark, path)


E4_SQL = """
SELECT CANONICAL_NAME, count(*) AS filings FROM lca_e WHERE CANONICAL_NAME IS NOT NULL GROUP BY 1"""


@register("e4_incremental_labels_lca", E4_SQL)
def e4_incremental_labels_lca(spark, sf_dir):
    """LCA exports labelled as they come; PERM's spellings then rename the stored filings of some core keys."""
    ds, path = _ds(spark, sf_dir), scratch_path(spark, "labelled")
    batches = _by_source(ds)
    for number, filings in enumerate(batches):
        name_map.add_filings(spark, path, number, filings.select("CASE_NUMBER", "EMPLOYER_NAME"), "EMPLOYER_NAME")
    perm = entities.spelling_counts((ds.perm_master, "EMP_BUSINESS_NAME"))
    name_map.relabel(spark, path, name_map.add_spellings(spark, path, len(batches), perm), len(batches))
    return _count(spark.read.parquet(f"{path}/filings").where(F.col("CANONICAL_NAME").isNotNull()), "CANONICAL_NAME")


@register("e4_apply_canonical_lca", E4_SQL)
def e4_apply_canonical_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca.where(F.col("CANONICAL_NAME").isNotNull()), "CANONICAL_NAME")


@register("e5_brand_rollup_lca", """
SELECT CANONICAL_NAME, EMPLOYER_CANONICAL, count(*) AS filings FROM lca_e
WHERE CANONICAL_NAME IS NOT NULL GROUP BY 1, 2""")
def e5_brand_rollup_lca(spark, sf_dir):
    return _count(_ds(spark, sf_dir).lca.where(F.col("CANONICAL_NAME").isNotNull()), "CANONICAL_NAME", "EMPLOYER_CANONICAL")


@register("e5_brand_rollup_standalone", f"""
, d AS (SELECT DISTINCT CANONICAL_NAME AS name FROM lca_e WHERE CANONICAL_NAME IS NOT NULL)
SELECT d.name AS CANONICAL_NAME, coalesce(b.brand, d.name) AS brand_label
FROM d LEFT JOIN brand_map b ON b.core = {core_sql('d.name')}""")
def e5_brand_rollup_standalone(spark, sf_dir):
    names = _ds(spark, sf_dir).lca.select("CANONICAL_NAME").where(F.col("CANONICAL_NAME").isNotNull()).distinct()
    return entities.brand_rollup(names, "CANONICAL_NAME", "brand_label")


MATCH_SIDE_SQL = """
{p}_n AS (SELECT {core} AS employer_core_key, EMPLOYER_CANONICAL AS name, count(*) AS n
          FROM {t} WHERE EMPLOYER_CANONICAL IS NOT NULL GROUP BY 1, 2),
{p}_s AS (SELECT employer_core_key, sum(n) AS filings,
                 arg_min(name, struct_pack(a := -n, b := name)) AS canonical_name
          FROM {p}_n GROUP BY 1)"""

MATCH_SQL = (", " + MATCH_SIDE_SQL.format(p="l", core=core_sql("EMPLOYER_CANONICAL"), t="lca_mba") + ",\n"
             + MATCH_SIDE_SQL.format(p="r", core=core_sql("EMPLOYER_CANONICAL"), t="perm_mba") + """,
m AS (SELECT coalesce(l_s.employer_core_key, r_s.employer_core_key) AS employer_core_key,
             l_s.canonical_name AS lca_canonical_name, CAST(coalesce(l_s.filings, 0) AS BIGINT) AS lca_filings,
             r_s.canonical_name AS perm_canonical_name, CAST(coalesce(r_s.filings, 0) AS BIGINT) AS perm_filings
      FROM l_s FULL OUTER JOIN r_s ON l_s.employer_core_key = r_s.employer_core_key),
mm AS (SELECT *, lca_filings > 0 AND perm_filings > 0 AS sponsors_both FROM m)""")


@register("e6_match_datasets", MATCH_SQL + "\nSELECT * FROM mm")
def e6_match_datasets(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return entities.match_datasets(ds.lca_mba(), ds.perm_mba())


@register("e7_both_datasets", MATCH_SQL + "\nSELECT * FROM mm WHERE sponsors_both")
def e7_both_datasets(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return entities.both_datasets(entities.match_datasets(ds.lca_mba(), ds.perm_mba()))


@register("e7_left_only", MATCH_SQL + "\nSELECT * FROM mm WHERE lca_filings > 0 AND perm_filings = 0")
def e7_left_only(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return entities.left_only(entities.match_datasets(ds.lca_mba(), ds.perm_mba()))


@register("e8_dedupe_effect", """
SELECT 'lca' AS dataset, count(DISTINCT EMPLOYER_NAME) AS raw_names, count(DISTINCT EMPLOYER_CANONICAL) AS canonical_names FROM lca_e
UNION ALL
SELECT 'perm', count(DISTINCT EMP_BUSINESS_NAME), count(DISTINCT EMPLOYER_CANONICAL) FROM perm_e""")
def e8_dedupe_effect(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    a = entities.dedupe_effect(ds.lca, "EMPLOYER_NAME").select(F.lit("lca").alias("dataset"), "*")
    b = entities.dedupe_effect(ds.perm, "EMP_BUSINESS_NAME").select(F.lit("perm").alias("dataset"), "*")
    return a.unionByName(b)


@register("e9_history_flag_lca", """
, o AS (SELECT DISTINCT EMPLOYER_CANONICAL FROM perm_e WHERE EMPLOYER_CANONICAL IS NOT NULL),
d AS (SELECT DISTINCT EMPLOYER_CANONICAL FROM lca_e WHERE EMPLOYER_CANONICAL IS NOT NULL)
SELECT d.EMPLOYER_CANONICAL, o.EMPLOYER_CANONICAL IS NOT NULL AS perm_history
FROM d LEFT JOIN o ON o.EMPLOYER_CANONICAL = d.EMPLOYER_CANONICAL""", lca_where=APP_LCA)
def e9_history_flag_lca(spark, sf_dir):
    ds = _app(spark, sf_dir)
    d = ds.lca.select("EMPLOYER_CANONICAL").where(F.col("EMPLOYER_CANONICAL").isNotNull()).distinct()
    return entities.history_flag(d, ds.perm, "EMPLOYER_CANONICAL", "perm_history")


@register("e1_strip_raw_names", RAW_NAMES_SQL + f"""
SELECT {strip_sql('raw_name')} AS stripped, count(*) AS n FROM raw GROUP BY 1""")
def e1_strip_raw_names(spark, sf_dir):
    from filingscope.functions.names import strip_ws
    return _count(_raw_names(_ds(spark, sf_dir)).where(F.col("name").isNotNull())
                  .select(strip_ws("name").alias("stripped")), "stripped").withColumnRenamed("filings", "n")
