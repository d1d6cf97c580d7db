"""Registered ingest (C1-C12) and source/sink (S1-S7) queries.

Ingest queries render the LCA binding as three raw text exports (different
date formats, ``="..."`` wrapped codes, N/A tokens, an old header spelling,
a missing column, blank template rows) and consolidate them back; the
oracle is the consolidated master computed directly in SQL.  Source/sink
queries additionally round-trip through files in a fresh folder under the
session's shared checkpoint location.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from filingscope.operators import cube, ingest, stats
from filingscope.operators.distribution import stored
from filingscope.plans.catalog_cube import CUBE_COLS, K6_SQL, LCA_CUBE, PERM_CUBE, cube_yoy
from filingscope.plans.catalog_stats import _ds
from filingscope.plans.oracle_base import fiscal_sql
from filingscope.plans.registry import register
from filingscope.session import discard, scratch_path
from filingscope.sources import master as master_io
from filingscope.sources import raw as raw_io
from filingscope.sources import sinks, staging, testbind
from filingscope.spec import LCA, PERM

CONSOLIDATED_COLS = (
    "CASE_NUMBER", "SOURCE_FILE", "CASE_STATUS", "RECEIVED_DATE", "DECISION_DATE", "FISCAL_YEAR", "FISCAL_QUARTER",
    "NAICS_CODE", "SOC_CODE", "H_1B_DEPENDENT", "EMPLOYER_NAME", "WAGE_RATE_OF_PAY_FROM", "NEW_EMPLOYMENT",
    "NEW_CONCURRENT_EMPLOYMENT",
)

CONSOLIDATED_SQL = """
SELECT CASE_NUMBER, SOURCE_FILE, CASE_STATUS, RECEIVED_DATE, DECISION_DATE, FISCAL_YEAR, FISCAL_QUARTER,
       NAICS_CODE, SOC_CODE, H_1B_DEPENDENT, EMPLOYER_NAME, CAST(WAGE_RATE_OF_PAY_FROM AS DOUBLE) AS WAGE_RATE_OF_PAY_FROM,
       CAST(NEW_EMPLOYMENT AS DOUBLE) AS NEW_EMPLOYMENT,
       CASE WHEN SOURCE_ORD = 2 THEN NULL ELSE CAST(NEW_CONCURRENT_EMPLOYMENT AS DOUBLE) END AS NEW_CONCURRENT_EMPLOYMENT
FROM lca"""


def _frames(spark, sf_dir):
    out = []
    for name, order, df in testbind.render_raw_sources(spark, sf_dir):
        out.append(df.withColumns({"SOURCE_FILE": F.lit(name), "SOURCE_ORD": F.lit(order)}))
    return out


def _consolidated(spark, sf_dir):
    return ingest.consolidate(_frames(spark, sf_dir), numeric_cols=testbind.LCA_NUMERIC_TEXT)


@register("c_consolidate_lca", CONSOLIDATED_SQL)
def c_consolidate_lca(spark, sf_dir):
    """C1 rename, C2 unwrap, C3 blanks, C4 union by name, C5 dates, C6 fiscal,
    C7 latest source, C10 NA tokens, C11 numbers."""
    return _consolidated(spark, sf_dir).select(*CONSOLIDATED_COLS)


@register("c6_fiscal_calendar_lca", """
SELECT FISCAL_YEAR, FISCAL_QUARTER, DECISION_DATE IS NULL AS from_received, count(*) AS filings FROM lca GROUP BY 1, 2, 3""")
def c6_fiscal_calendar_lca(spark, sf_dir):
    df = _consolidated(spark, sf_dir)
    return df.groupBy("FISCAL_YEAR", "FISCAL_QUARTER", F.col("DECISION_DATE").isNull().alias("from_received")) \
        .agg(F.count(F.lit(1)).alias("filings"))


@register("c7_latest_source_wins_lca", """
SELECT SOURCE_FILE, count(*) AS rows_kept, count(DISTINCT CASE_NUMBER) AS cases FROM lca GROUP BY 1""")
def c7_latest_source_wins_lca(spark, sf_dir):
    return _consolidated(spark, sf_dir).groupBy("SOURCE_FILE").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("CASE_NUMBER").alias("cases"))


@register("c7_incremental_lca", CONSOLIDATED_SQL)
def c7_incremental_lca(spark, sf_dir):
    """The oldest export lands as the master, each later one replaces only the periods it touches; the last comes twice."""
    path = scratch_path(spark, "refreshed-master")
    exports = [ingest.clean_rows([f], numeric_cols=testbind.LCA_NUMERIC_TEXT) for f in _frames(spark, sf_dir)]
    first = master_io.newest_rows(exports[0])
    master_io.write_master(first, path, rebalance=False)
    discard(first)
    for new in [*exports[1:], exports[-1]]:
        master_io.refresh_master(spark, new, path)
    return spark.read.option("mergeSchema", True).parquet(path).select(*CONSOLIDATED_COLS)


C9_SQL = """
, w AS (SELECT CASE_NUMBER, max(SOURCE_ORD) AS win FROM lca_fy GROUP BY 1),
r AS (SELECT f.SOURCE_FILE, count(*) AS n, count(*) FILTER (WHERE f.SOURCE_ORD <> w.win) AS stale,
             count(*) FILTER (WHERE f.SOURCE_ORD = w.win AND coalesce(f.DECISION_DATE, f.RECEIVED_DATE) IS NULL) AS nodate
      FROM lca_fy f JOIN w ON w.CASE_NUMBER = f.CASE_NUMBER GROUP BY 1),
b AS (SELECT count(*) AS blanks FROM nation)
SELECT SOURCE_FILE, n + blanks AS rows_read, blanks AS blank_rows, stale AS stale_duplicates, n - stale AS rows_written,
       nodate AS no_fiscal_date FROM r, b"""


@register("c9_ingest_report_lca", C9_SQL)
def c9_ingest_report_lca(spark, sf_dir):
    raw = ingest.prepare_raw(_frames(spark, sf_dir), numeric_cols=testbind.LCA_NUMERIC_TEXT)
    return ingest.ingest_report(raw)


def _staged(spark, sf_dir, read):
    """What ``read`` makes of the staged exports; the stage goes once that is stored."""
    stage = staging.stage_exports(spark, _frames(spark, sf_dir), numeric_cols=testbind.LCA_NUMERIC_TEXT)
    out = stored(read(spark, stage))
    staging.drop_stage(spark, stage)
    return out


@register("c7_staged_lca", CONSOLIDATED_SQL)
def c7_staged_lca(spark, sf_dir):
    """Exports parsed once into a stage bucketed by case, consolidated from it without an exchange."""
    return _staged(spark, sf_dir, staging.consolidate_stage).select(*CONSOLIDATED_COLS)


@register("c9_staged_report_lca", C9_SQL)
def c9_staged_report_lca(spark, sf_dir):
    return _staged(spark, sf_dir, staging.stage_report)


@register("c9_observed_report_lca", C9_SQL)
def c9_observed_report_lca(spark, sf_dir):
    """The report counted while the master is written; nothing is read for it."""
    names = [f"src_{order}" for order in testbind.SOURCE_DATE_FORMATS]  # the manifest
    return staging.consolidate_observed(spark, _frames(spark, sf_dir), names, scratch_path(spark, "observed-master"),
                                        testbind.LCA_NUMERIC_TEXT)


@register("c12_coerce_types_lca", """
SELECT CASE_NUMBER, SOURCE_FILE,
       CASE WHEN CASE_STATUS = 'Withdrawn' THEN NULL ELSE RECEIVED_DATE END AS RECEIVED_DATE,
       CASE WHEN CASE_STATUS = 'Denied' THEN NULL ELSE CAST(WAGE_RATE_OF_PAY_FROM AS DOUBLE) END AS WAGE_RATE_OF_PAY_FROM
FROM lca""")
def c12_coerce_types_lca(spark, sf_dir):
    """Text master on disk -> typed frame (C11 numbers, C12 ISO dates); bad cells become null."""
    path = scratch_path(spark, "text-master")
    bad_date, bad_wage = F.col("CASE_STATUS") == "Withdrawn", F.col("CASE_STATUS") == "Denied"
    text = _consolidated(spark, sf_dir).select(
        "CASE_NUMBER", "SOURCE_FILE",
        F.when(bad_date, F.concat(F.date_format("RECEIVED_DATE", "yyyy-MM"), F.lit("-40")))
        .otherwise(F.date_format("RECEIVED_DATE", "yyyy-MM-dd")).alias("RECEIVED_DATE"),
        F.when(bad_wage, F.lit("$ not stated")).otherwise(F.col("WAGE_RATE_OF_PAY_FROM").cast("string"))
        .alias("WAGE_RATE_OF_PAY_FROM"), "FISCAL_YEAR", "FISCAL_QUARTER")
    text.write.mode("overwrite").parquet(path)
    typed = master_io.load_filings(spark, path, LCA)
    return typed.select("CASE_NUMBER", "SOURCE_FILE", "RECEIVED_DATE", "WAGE_RATE_OF_PAY_FROM")


# -- S sources and sinks ------------------------------------------------------------------------


def _write_raw_csv(spark, sf_dir) -> list[raw_io.Source]:
    base = scratch_path(spark, "raw-exports")
    sources = []
    for name, order, df in testbind.render_raw_sources(spark, sf_dir):
        path = f"{base}/{name}"
        (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        sources.append(raw_io.Source(name=name, path=path, order=order))
    return sources


@register("s1_csv_scan_consolidate_lca", CONSOLIDATED_SQL)
def s1_csv_scan_consolidate_lca(spark, sf_dir):
    """S1 CSV scan + S2 ordered source list + C8 provenance, through real files."""
    sources = _write_raw_csv(spark, sf_dir)
    df = raw_io.consolidate_sources(spark, sources, numeric_cols=testbind.LCA_NUMERIC_TEXT)
    return df.select(*CONSOLIDATED_COLS)


def _write_master(spark, sf_dir) -> str:
    path = scratch_path(spark, "lca-master")
    master_io.write_master(_ds(spark, sf_dir).lca_master, path)
    return path


@register("s5_master_sink_lca", "SELECT FISCAL_YEAR, FISCAL_QUARTER, count(*) AS filings FROM lca GROUP BY 1, 2")
def s5_master_sink_lca(spark, sf_dir):
    path = _write_master(spark, sf_dir)
    return master_io.read_master(spark, path).groupBy("FISCAL_YEAR", "FISCAL_QUARTER") \
        .agg(F.count(F.lit(1)).alias("filings"))


@register("s3_master_scan_lca", """
SELECT FISCAL_QUARTER, CASE_STATUS, count(*) AS filings, count(WAGE_RATE_OF_PAY_FROM) AS with_wage
FROM lca WHERE FISCAL_YEAR = 1998 GROUP BY 1, 2""")
def s3_master_scan_lca(spark, sf_dir):
    """S3/S4: projected, partition-pruned load of the written master."""
    path = _write_master(spark, sf_dir)
    df = master_io.load_filings(spark, path, LCA, ["CASE_STATUS", "WAGE_RATE_OF_PAY_FROM", "FISCAL_YEAR", "FISCAL_QUARTER"])
    return df.where(F.col("FISCAL_YEAR") == 1998).groupBy("FISCAL_QUARTER", "CASE_STATUS").agg(
        F.count(F.lit(1)).alias("filings"), F.count("WAGE_RATE_OF_PAY_FROM").alias("with_wage"))


@register("s6_aggregate_sink_lca", """
SELECT NAICS_SECTOR, count(*) AS filings,
       CAST(count(*) FILTER (WHERE CERTIFIED) AS DOUBLE) / nullif(count(*) FILTER (WHERE DECIDED), 0) AS cert_rate,
       median(ANNUAL_WAGE) AS median_annual_wage
FROM lca_mba WHERE NAICS_SECTOR IS NOT NULL GROUP BY NAICS_SECTOR""")
def s6_aggregate_sink_lca(spark, sf_dir):
    path = scratch_path(spark, "sector-scorecard")
    sinks.write_aggregate(stats.scorecard(_ds(spark, sf_dir).lca_mba(), "NAICS_SECTOR"), path)
    schema = "NAICS_SECTOR string, filings long, cert_rate double, median_annual_wage double"
    return spark.read.option("header", True).schema(schema).csv(path)


@register("s7_cube_sink_lca", LCA_CUBE + "\nSELECT " + CUBE_COLS.format(x="wage_level, new_hire") + " FROM l_cube")
def s7_cube_sink_lca(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    lca_mba, perm_mba = ds.lca_mba(), ds.perm_mba()
    dims, facts = cube.build_cube(lca_mba, LCA)
    meta = cube.employer_meta(ds.lca, ds.perm)
    path = scratch_path(spark, "cube")
    sinks.write_cube(facts, dims, meta, path)
    return spark.read.parquet(f"{path}/facts")


PARTS = "".join(f"""
SELECT '{d}/{part}' AS part, count(*) AS n, CAST(coalesce(sum({col}), 0) AS BIGINT) AS total FROM {p}_{t} UNION ALL"""
                for d, p in (("lca", "l"), ("perm", "p"))
                for part, t, col in (("facts", "cube", "filings"), ("occupations", "occ", "filings"),
                                     ("employers", "emp", "filings"), ("states", "st", "state_idx"),
                                     ("sectors", "sec", "sector_idx")))


@register("s7_cube_document", LCA_CUBE + PERM_CUBE + K6_SQL.split("SELECT ds AS dataset")[0] + PARTS + """
SELECT 'coverage', 2, CAST((SELECT sum(filings) FROM l_cube) + (SELECT sum(filings) FROM p_cube) AS BIGINT) UNION ALL
SELECT 'yoy', count(*), CAST(sum(base_filings) AS BIGINT) FROM h
WHERE MBA_TIER IN ('core', 'adjacent') AND both_years AND base_filings > 0 UNION ALL
SELECT 'employer_meta', count(*), 0 FROM (SELECT EMPLOYER_CANONICAL FROM l_emp UNION SELECT EMPLOYER_CANONICAL FROM p_emp)""")
def s7_cube_document(spark, sf_dir):
    """Both datasets' lookups and facts, coverage, year over year and employer metadata, written and read back."""
    ds = _ds(spark, sf_dir)
    lca_mba, perm_mba = ds.lca_mba(), ds.perm_mba()
    cubes = {"lca": cube.build_cube(lca_mba, LCA), "perm": cube.build_cube(perm_mba, PERM, with_wage_level=False)}
    coverage = cube.cube_coverage(cubes["lca"][1], ds.unnamed_mba(LCA), "lca").unionByName(
        cube.cube_coverage(cubes["perm"][1], ds.unnamed_mba(PERM), "perm"))
    meta = cube.employer_meta(ds.lca, ds.perm)
    path = scratch_path(spark, "cube-document")
    sinks.write_cube_document(cubes, coverage, cube_yoy(ds), meta, path)
    read = [(f"{d}/{part}", spark.read.parquet(f"{path}/{d}/{part}"), col) for d in cubes for part, col in (
        ("facts", "filings"), ("occupations", "filings"), ("employers", "filings"), ("states", "state_idx"),
        ("sectors", "sector_idx"))]
    read += [("coverage", spark.read.json(f"{path}/coverage"), "cube_filings"),
             ("yoy", spark.read.json(f"{path}/yoy"), "base_filings"),
             ("employer_meta", spark.read.json(f"{path}/employer_meta").withColumn("none", F.lit(0)), "none")]
    parts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(col).cast("long"), F.lit(0)).cast("long").alias("total")) for name, df, col in read]
    return reduce(lambda a, b: a.unionByName(b), parts)


# lines 5 to 7 of an order come in files without SOC_CODE and with the other columns in another order
MIXED_SQL = CONSOLIDATED_SQL.replace(
    " SOC_CODE,", " CASE WHEN right(CASE_NUMBER, 1) IN ('5', '6', '7') THEN NULL ELSE SOC_CODE END AS SOC_CODE,")


def _write_mixed_headers(spark, sf_dir, base) -> list[raw_io.Source]:
    """Every source folder holds files of two layouts: columns in another order, one of them missing."""
    sources = []
    for name, order, df in testbind.render_raw_sources(spark, sf_dir):
        other = F.right("CASE_NUMBER", F.lit(1)).isin("5", "6", "7")
        turned = df.where(other).select(*[c for c in reversed(df.columns) if c != "SOC_CODE"])
        for part, mode in ((df.where(~other), "overwrite"), (turned, "append")):
            (part.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}"))
        sources.append(raw_io.Source(name=name, path=f"{base}/{name}", order=order))
    return sources


@register("s1_mixed_headers_lca", MIXED_SQL)
def s1_mixed_headers_lca(spark, sf_dir):
    """Files of one source folder with different headers are bound by column name."""
    sources = _write_mixed_headers(spark, sf_dir, scratch_path(spark, "mixed-exports"))
    df = raw_io.consolidate_sources(spark, sources, numeric_cols=testbind.LCA_NUMERIC_TEXT)
    return df.select(*CONSOLIDATED_COLS)


@register("s1_many_files_lca", MIXED_SQL.replace("FROM lca", ", left(md5(CASE_NUMBER), 1) AS LOT FROM lca"))
def s1_many_files_lca(spark, sf_dir):
    """Folders of many small files in two layouts: headers from one job a source, each row's lot from its own file's path."""
    base, sources = scratch_path(spark, "many-exports"), []
    for name, order, df in testbind.render_raw_sources(spark, sf_dir):
        other = F.right("CASE_NUMBER", F.lit(1)).isin("5", "6", "7")
        lots = df.withColumn("LOT", F.left(F.md5(F.col("CASE_NUMBER").cast("binary")), F.lit(1)))
        turned = lots.where(other).select(*[c for c in reversed(lots.columns) if c != "SOC_CODE"])
        for part, mode in ((lots.where(~other | F.col("CASE_NUMBER").isNull()), "overwrite"), (turned, "append")):
            (part.write.mode(mode).partitionBy("LOT").option("header", True).option("quote", '"').option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}"))
        sources.append(raw_io.Source(name=name, path=f"{base}/{name}", order=order))
    df = raw_io.consolidate_sources(spark, sources, numeric_cols=testbind.LCA_NUMERIC_TEXT, file_column="SOURCE_PATH")
    return df.select(*CONSOLIDATED_COLS, F.regexp_extract("SOURCE_PATH", "/LOT=([0-9a-f])/", 1).alias("LOT"))


@register("s8_stream_ingest_lca", MIXED_SQL)
def s8_stream_ingest_lca(spark, sf_dir):
    """Raw exports landing in per-source folders -> file stream -> appended
    table -> latest source wins on read."""
    from filingscope.streaming.incremental import read_consolidated, start_ingest

    base = scratch_path(spark, "stream")
    sources = _write_mixed_headers(spark, sf_dir, f"{base}/landing")
    q = start_ingest(spark, f"{base}/landing", {s.name: s.order for s in sources}, f"{base}/table",
                     f"{base}/checkpoint", numeric_cols=testbind.LCA_NUMERIC_TEXT)
    q.awaitTermination()  # availableNow ends by itself
    return read_consolidated(spark, f"{base}/table").select(*CONSOLIDATED_COLS)


# -- PERM ingest ----------------------------------------------------------------------------------

PERM_COLS = ("CASE_NUMBER", "SOURCE_FILE", "CASE_STATUS", "RECEIVED_DATE", "DECISION_DATE", "ORIGINAL_CERT_DATE",
             "FISCAL_YEAR", "FISCAL_QUARTER", "EMP_BUSINESS_NAME", "EMP_NUM_PAYROLL", "JOB_OPP_WAGE_FROM")
PERM_CONSOLIDATED = f"""
WITH x AS ({testbind.PERM_EXPORT_SQL}),
y AS (SELECT CASE_NUMBER, SOURCE_FILE, SOURCE_ORD, CASE_STATUS, RECEIVED_DATE,
             CASE WHEN BAD_DATE THEN NULL ELSE DECISION_DATE END AS DECISION_DATE, ORIGINAL_CERT_DATE, EMP_BUSINESS_NAME,
             CASE WHEN BAD_NUMBER THEN NULL ELSE CAST(EMP_NUM_PAYROLL AS DOUBLE) END AS EMP_NUM_PAYROLL,
             CAST(JOB_OPP_WAGE_FROM AS DOUBLE) AS JOB_OPP_WAGE_FROM FROM x),
f AS (SELECT *, {fiscal_sql()} FROM y),
w AS (SELECT CASE_NUMBER AS k, max(SOURCE_ORD) AS o FROM f GROUP BY 1),
m AS (SELECT f.* FROM f JOIN w ON k = CASE_NUMBER AND o = SOURCE_ORD)"""


def _perm_consolidated(spark, sf_dir):
    frames = [df.withColumns({"SOURCE_FILE": F.lit(name), "SOURCE_ORD": F.lit(order)})
              for name, order, df in testbind.render_perm_sources(spark, sf_dir)]
    return ingest.consolidate(frames, numeric_cols=testbind.PERM_NUMERIC_TEXT)


@register("c_consolidate_perm", f"{PERM_CONSOLIDATED} SELECT {', '.join(PERM_COLS)} FROM m", raw_sql=True)
def c_consolidate_perm(spark, sf_dir):
    """C3-C7, C10, C11 on PERM exports: unreadable dates and numbers become null."""
    return _perm_consolidated(spark, sf_dir).select(*PERM_COLS)


@register("c7_latest_source_wins_perm", f"""{PERM_CONSOLIDATED}
SELECT SOURCE_FILE, count(*) AS rows_kept, count(DISTINCT CASE_NUMBER) AS cases FROM m GROUP BY 1""", raw_sql=True)
def c7_latest_source_wins_perm(spark, sf_dir):
    return _perm_consolidated(spark, sf_dir).groupBy("SOURCE_FILE").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("CASE_NUMBER").alias("cases"))


@register("s4_load_perm", f"""{PERM_CONSOLIDATED}
SELECT CASE_NUMBER, SOURCE_FILE, RECEIVED_DATE, DECISION_DATE, EMP_NUM_PAYROLL, JOB_OPP_WAGE_FROM FROM m""", raw_sql=True)
def s4_load_perm(spark, sf_dir):
    """Text PERM master on disk -> load with numeric and date coercion."""
    path = scratch_path(spark, "perm-master")
    frames = [df.withColumns({"SOURCE_FILE": F.lit(name), "SOURCE_ORD": F.lit(order)})
              for name, order, df in testbind.render_perm_sources(spark, sf_dir)]
    master = ingest.consolidate(frames)  # numbers stay text in the stored master
    for c in master_io.DATE_COLS:
        master = master.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    master_io.write_master(master, path)
    return master_io.load_filings(spark, path, PERM).select(
        "CASE_NUMBER", "SOURCE_FILE", "RECEIVED_DATE", "DECISION_DATE", "EMP_NUM_PAYROLL", "JOB_OPP_WAGE_FROM")
