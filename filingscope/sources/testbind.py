"""Binding of the two filing schemas onto the driver's TPC-H-shaped tables.

The projections are plain SQL expressions over the joined tables so the
same text serves the Spark build and the DuckDB oracle.  The joins are
equi-joins that Spark plans itself: nation (25 rows, fixed domain) is the
only explicit broadcast; customer / part / orders are left to the planner's
size-checked broadcast threshold and AQE's runtime re-planning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.session import landed

LCA_PROJECTION = {
    "CASE_NUMBER": "concat('C-', cast(l_orderkey - l_orderkey % 3 AS string), '-', cast(l_linenumber AS string))",
    "SOURCE_FILE": "concat('src_', cast(l_partkey % 3 + 1 AS string))",
    "SOURCE_ORD": "cast(l_partkey % 3 + 1 AS int)",
    "CASE_STATUS": (
        "CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 'Withdrawn' "
        "WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Denied' "
        "WHEN l_returnflag = 'A' THEN 'Certified' ELSE 'Certified - Withdrawn' END"
    ),
    "RECEIVED_DATE": "cast(o_orderdate AS date)",
    "DECISION_DATE": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE cast(l_shipdate AS date) END",
    "VISA_CLASS": "CASE l_suppkey % 10 WHEN 0 THEN 'E-3' WHEN 1 THEN 'H-1B1' ELSE 'H-1B' END",
    "SOC_CODE": (
        "CASE l_partkey % 6 WHEN 0 THEN '11-2021.00' WHEN 1 THEN '13-2051.00' WHEN 2 THEN '15-1252.00' "
        "WHEN 3 THEN '15-2051.01' WHEN 4 THEN '41-9031.00' ELSE NULL END"
    ),
    "SOC_TITLE": (
        "CASE l_partkey % 8 WHEN 0 THEN 'Marketing Managers' WHEN 1 THEN 'Financial Risk Specialists' "
        "WHEN 2 THEN 'Software Developers' WHEN 3 THEN 'Business Intelligence Analysts' "
        "WHEN 4 THEN 'Data Scientists' WHEN 5 THEN 'Sales Engineers' "
        "WHEN 6 THEN 'Project Management Specialists' ELSE NULL END"
    ),
    "JOB_TITLE": "p_name",
    "EMPLOYER_NAME": (
        "CASE l_linenumber WHEN 1 THEN concat('Firm ', cast(c_custkey - c_custkey % 5 AS string), ', Inc.') "
        "WHEN 2 THEN concat('FIRM ', cast(c_custkey - c_custkey % 5 AS string), ' INC') "
        "WHEN 3 THEN concat('The Firm ', cast(c_custkey - c_custkey % 5 AS string), ' LLC') "
        "WHEN 4 THEN concat('Firm ', cast(c_custkey - c_custkey % 5 AS string), ',LLC') "
        "WHEN 5 THEN concat('Firm ', cast(c_custkey - c_custkey % 5 AS string), ' L.L.C.') "
        "WHEN 6 THEN concat('  Firm ', cast(c_custkey - c_custkey % 5 AS string), '  Corp. Ltd ') "
        "ELSE CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'Amazon Web Services, Inc.' "
        "WHEN c_custkey % 4 = 2 THEN 'AMAZON.COM SERVICES LLC' ELSE 'The Citadel' END END"
    ),
    "NAICS_CODE": (
        "CASE c_nationkey % 6 WHEN 0 THEN '541511' WHEN 1 THEN '522110' WHEN 2 THEN ' 334413' "
        "WHEN 3 THEN '99' WHEN 4 THEN '31' ELSE NULL END"
    ),
    "WORKSITE_STATE": "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE n_name END",
    "WAGE_RATE_OF_PAY_FROM": (
        "CASE l_linenumber WHEN 4 THEN l_quantity WHEN 5 THEN l_extendedprice / 12 "
        "WHEN 6 THEN l_quantity * 40 ELSE l_extendedprice END"
    ),
    "WAGE_UNIT_OF_PAY": (
        "CASE l_linenumber WHEN 4 THEN 'Hour' WHEN 5 THEN 'Month' WHEN 6 THEN 'Week' "
        "WHEN 7 THEN 'Fortnight' ELSE 'Year' END"
    ),
    "PW_WAGE_LEVEL": (
        "CASE WHEN l_quantity <= 10 THEN 'I' WHEN l_quantity <= 20 THEN 'II' WHEN l_quantity <= 30 THEN 'III' "
        "WHEN l_quantity <= 40 THEN 'IV' ELSE NULL END"
    ),
    "NEW_EMPLOYMENT": "CASE WHEN l_suppkey % 3 = 0 THEN 1 WHEN l_suppkey % 3 = 1 THEN 0 ELSE NULL END",
    "CHANGE_EMPLOYER": "CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END",
    "NEW_CONCURRENT_EMPLOYMENT": "CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE NULL END",
    "H_1B_DEPENDENT": "CASE WHEN c_custkey % 9 = 0 THEN 'Y' WHEN c_custkey % 9 = 1 THEN NULL ELSE 'N' END",
    "WILLFUL_VIOLATOR": "CASE WHEN c_custkey % 50 = 0 THEN 'Y' ELSE 'N' END",
}

PERM_PROJECTION = {
    "CASE_NUMBER": "concat('P-', cast(o_orderkey AS string))",
    "CASE_STATUS": (
        "CASE WHEN o_orderkey % 17 = 0 THEN 'Withdrawn' WHEN o_orderstatus = 'F' THEN 'Certified' "
        "WHEN o_orderstatus = 'O' THEN 'Certified - Expired' ELSE 'Denied' END"
    ),
    "RECEIVED_DATE": "cast(o_orderdate AS date)",
    "DECISION_DATE": "cast(o_orderdate AS date)",
    "EMP_BUSINESS_NAME": (
        "CASE WHEN c_custkey % 2 = 0 THEN concat('FIRM ', cast(c_custkey - c_custkey % 4 AS string), ', INC.') "
        "ELSE concat('Firm ', cast(c_custkey - c_custkey % 4 AS string), ' Company') END"
    ),
    "EMP_NAICS": "CASE c_nationkey % 4 WHEN 0 THEN '541511' WHEN 1 THEN '522110' WHEN 2 THEN '611310' ELSE NULL END",
    "EMP_NUM_PAYROLL": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE round(c_acctbal) END",
    "PWD_SOC_CODE": (
        "CASE o_orderkey % 4 WHEN 0 THEN '13-1111.00' WHEN 1 THEN '15-1252.00' "
        "WHEN 2 THEN '13-2051.00' ELSE NULL END"
    ),
    "PWD_SOC_TITLE": (
        "CASE o_orderkey % 5 WHEN 0 THEN 'Management Analysts' WHEN 1 THEN 'Software Developers' "
        "WHEN 2 THEN 'Operations Research Analysts' WHEN 3 THEN 'Financial Risk Specialists' ELSE NULL END"
    ),
    "JOB_TITLE": "o_orderpriority",
    "JOB_OPP_WAGE_FROM": "o_totalprice",
    "JOB_OPP_WAGE_PER": "CASE WHEN o_orderkey % 29 = 0 THEN 'Hour' ELSE 'Year' END",
    "PRIMARY_WORKSITE_STATE": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE n_name END",
    "OTHER_REQ_IS_FW_CURRENTLY_WRK": "CASE o_orderkey % 6 WHEN 0 THEN 'N' WHEN 1 THEN NULL ELSE 'Y' END",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan over ``filingscope.scan.partitions`` tasks when the session sets that.

    For tables stored as one large row group, which one task would read and
    join alone.  Unset (the default), scans keep the splits of their files.
    """
    n = df.sparkSession.conf.get("filingscope.scan.partitions", None)
    return df.repartition(int(n)) if n else df


def lca_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LCA-shaped rows (before consolidation) derived from the driver tables.

    Orders meet customers before the line items, which are moved for the orders and the parts only.
    """
    li = spread(_read(spark, sf_dir, "lineitem"))
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer")
    p = _read(spark, sf_dir, "part")
    n = _read(spark, sf_dir, "nation")
    ordered = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    joined = li.join(p, li.l_partkey == p.p_partkey).join(ordered, li.l_orderkey == o.o_orderkey)
    return joined.select(*[F.expr(e).alias(k) for k, e in LCA_PROJECTION.items()])


def lca_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lca_joined``, joined once and stored: every source and every pass over it reads only its own columns."""
    return landed(lca_joined(spark, sf_dir), "lca-raw")


def perm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERM-shaped rows derived from the driver tables."""
    o = spread(_read(spark, sf_dir, "orders"))
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.select(*[F.expr(e).alias(k) for k, e in PERM_PROJECTION.items()])


def projection_sql(projection: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {k}" for k, e in projection.items())


LCA_RAW_SQL = (
    "SELECT\n  " + projection_sql(LCA_PROJECTION) + "\nFROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey "
    "JOIN nation ON c_nationkey = n_nationkey"
)
PERM_RAW_SQL = (
    "SELECT\n  " + projection_sql(PERM_PROJECTION) + "\nFROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey"
)


# -- raw text exports rendered from the binding (ingest fixtures) ----------------------

# Each source renders dates its own way; source 1 also wraps code cells as
# ="..." text and uses the old header spelling; source 2 writes N/A for
# missing cells and lacks one column entirely.
SOURCE_DATE_FORMATS = {1: "M/d/yy", 2: "M/d/yyyy", 3: "yyyy-MM-dd"}
WRAPPED_COLUMNS = ("NAICS_CODE", "SOC_CODE")
MISSING_IN_SOURCE_2 = "NEW_CONCURRENT_EMPLOYMENT"
LCA_NUMERIC_TEXT = ("WAGE_RATE_OF_PAY_FROM", "NEW_EMPLOYMENT", "CHANGE_EMPLOYER", "NEW_CONCURRENT_EMPLOYMENT")


def render_raw_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame]]:
    """(name, order, all-text frame) per source, with 25 blank template rows each
    (one per nation row)."""
    raw = lca_raw(spark, sf_dir)
    nation = _read(spark, sf_dir, "nation")
    data_cols = [c for c in LCA_PROJECTION if c not in ("SOURCE_FILE", "SOURCE_ORD")]
    types = dict(raw.dtypes)
    out = []
    for order, fmt in SOURCE_DATE_FORMATS.items():
        part = raw.where(F.col("SOURCE_ORD") == order)
        cols = {}
        for c in data_cols:
            if types[c] == "date":
                v = F.date_format(c, fmt)
            elif types[c] == "string":
                v = F.col(c)
            else:
                v = F.col(c).cast("string")
            if order == 1 and c in WRAPPED_COLUMNS:
                v = F.concat(F.lit('="'), v, F.lit('"'))
            if order == 2 and c != "CASE_NUMBER":
                v = F.coalesce(v, F.lit("N/A"))
            cols[c] = v
        if order == 2:
            cols.pop(MISSING_IN_SOURCE_2)
        text = part.select(*[v.alias(k) for k, v in cols.items()])
        blanks = nation.select(F.lit("").alias("CASE_NUMBER"),
                               *[F.lit(None).cast("string").alias(k) for k in cols if k != "CASE_NUMBER"])
        text = text.unionByName(blanks)
        if order == 1:
            text = text.withColumnRenamed("H_1B_DEPENDENT", "H-1B_DEPENDENT")
        out.append((f"src_{order}", order, text))
    return out


# -- PERM exports: two ordered sources that share cases, with unreadable cells ----------------

PERM_EXPORT_PROJECTION = {
    **PERM_PROJECTION,
    "CASE_NUMBER": "concat('P-', cast(o_orderkey - o_orderkey % 2 AS string))",
    "SOURCE_FILE": "concat('perm_', cast(o_custkey % 2 + 1 AS string))",
    "SOURCE_ORD": "cast(o_custkey % 2 + 1 AS int)",
    "ORIGINAL_CERT_DATE": "CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS date) ELSE NULL END",
    "BAD_DATE": "o_orderkey % 11 = 0",
    "BAD_NUMBER": "o_orderkey % 13 = 0",
}
PERM_DATE_FORMATS = {1: "M/d/yyyy", 2: "yyyy-MM-dd"}
PERM_NUMERIC_TEXT = ("EMP_NUM_PAYROLL", "JOB_OPP_WAGE_FROM")
PERM_EXPORT_SQL = (
    "SELECT\n  " + projection_sql(PERM_EXPORT_PROJECTION) + "\nFROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey"
)


def render_perm_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame]]:
    """(name, order, all-text frame) per PERM source, with blank template rows."""
    joined = (spread(_read(spark, sf_dir, "orders")).join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
              .join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")))
    raw = joined.select(*[F.expr(e).alias(k) for k, e in PERM_EXPORT_PROJECTION.items()])
    types = dict(raw.dtypes)
    cells = [c for c in raw.columns if c not in ("SOURCE_FILE", "SOURCE_ORD", "BAD_DATE", "BAD_NUMBER")]
    out = []
    for order, fmt in PERM_DATE_FORMATS.items():
        cols = {c: F.date_format(c, fmt) if types[c] == "date" else F.col(c).cast("string") for c in cells}
        cols["DECISION_DATE"] = F.when(F.col("BAD_DATE"), F.lit("13/45/2020")).otherwise(cols["DECISION_DATE"])
        cols["EMP_NUM_PAYROLL"] = F.when(F.col("BAD_NUMBER"), F.lit("about 40")).otherwise(cols["EMP_NUM_PAYROLL"])
        text = raw.where(F.col("SOURCE_ORD") == order).select(*[v.alias(k) for k, v in cols.items()])
        blanks = _read(spark, sf_dir, "nation").select(*[F.lit("" if c == "CASE_NUMBER" else None).cast("string").alias(c) for c in cells])
        out.append((f"perm_{order}", order, text.unionByName(blanks)))
    return out
