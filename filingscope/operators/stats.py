"""Aggregations, scorecards and distribution summaries (A1-A29).

Every scorecard reads its filings once, into one grouped pass with conditional
counts (map-side partial aggregation): by group alone, or by group and value where
quantiles are asked for (``operators.distribution``).  Pandas-style semantics are
kept explicitly: group keys that are null are dropped (unless asked otherwise),
ratios with a zero denominator are null, and medians are exact (no task holds a
group's values).

Small result tables (a handful of quarters, tiers, bins) may be finished
with an un-partitioned window; those windows only ever see aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.flags import not_denied, yes_flag
from filingscope.functions.wages import round_half_up
from filingscope.operators.distribution import Distribution, distribution, stored
from filingscope.spec import WAGE_LEVELS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _drop_null_keys(df: DataFrame, keys) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def rate(num: Column, den: Column) -> Column:
    """num / den, null when den == 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def share(flag) -> Column:
    """Mean of a boolean column (null on an empty group)."""
    return F.avg(_c(flag).cast("double"))


# -- A1 / A25 / A26 / A27 / A29 -------------------------------------------------

def value_counts(df: DataFrame, col: str, k: int | None = None, keep_null: bool = False,
                 count_name: str = "filings") -> DataFrame:
    src = df if keep_null else df.where(F.col(col).isNotNull())
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias(count_name)).orderBy(F.desc(count_name), F.asc_nulls_first(col))
    return out if k is None else out.limit(k)


def attach_total(df: DataFrame, total: Column, name: str) -> DataFrame:
    """Add a grand total as a column: a one-row aggregate broadcast back on a
    constant key (no un-partitioned window over a table of unbounded size)."""
    tot = df.agg(total.alias(name)).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(tot), "_k").drop("_k")


def share_table(df: DataFrame, col: str, keep_null: bool = True) -> DataFrame:
    counts = value_counts(df, col, keep_null=keep_null, count_name="n")
    with_total = attach_total(counts, F.sum("n"), "_total")
    return with_total.select(col, "n", (F.col("n") / F.col("_total")).alias("share"))


def domain_counts(df: DataFrame, col: str, domain, domain_type: str = "string") -> DataFrame:
    """Counts reindexed to a fixed domain; values absent from the data get 0."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{col} {domain_type}, _pos int")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("filings"))
    return (dom.join(counts, col, "left")
            .select(col, "_pos", F.coalesce("filings", F.lit(0)).cast("long").alias("filings"))
            .orderBy("_pos").drop("_pos"))


def hire_split(df: DataFrame, flag: str, true_label: str, false_label: str) -> DataFrame:
    label = F.when(F.col(flag), F.lit(true_label)).otherwise(F.lit(false_label))
    return df.groupBy(label.alias("hire_type")).agg(F.count(F.lit(1)).alias("filings"))


def tier_counts(df: DataFrame, tier_col: str = "MBA_TIER") -> DataFrame:
    t = share_table(df, tier_col, keep_null=False)
    return t.select(tier_col, F.col("n").alias("filings"), (F.col("share") * 100).alias("pct_of_total"))


# -- A2 / A3 / A4 / A5 / A10 ----------------------------------------------------

def cert_rate(df: DataFrame, by=()) -> DataFrame:
    src = _drop_null_keys(df, by)
    aggs = [F.count_if("DECIDED").alias("decided"), F.count_if("CERTIFIED").alias("certified")]
    g = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    return g.withColumn("cert_rate", rate(F.col("certified"), F.col("decided")))


def outcome_counts() -> dict[str, Column]:
    return {"certified": F.col("CERTIFIED"), "decided": F.col("DECIDED")}


def scorecard(df: DataFrame, by: str, wage: str | None = "ANNUAL_WAGE", cert: bool = True) -> DataFrame:
    """filings, cert rate over decided rows, optional median bounded wage."""
    counts = outcome_counts() if cert else {}
    if wage:
        return scorecard_of(distribution(df, [by], wage, counts), cert)
    g = _drop_null_keys(df, [by]).groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return _scorecard_columns(g, by, cert, False)


def scorecard_of(d: Distribution, cert: bool = True, median: bool = True) -> DataFrame:
    """The scorecard of a stored distribution with ``outcome_counts``."""
    g = d.summary({"median_annual_wage": 0.5}) if median else d.totals()
    return _scorecard_columns(g, d.by[0], cert, median)


def _scorecard_columns(g: DataFrame, by: str, cert: bool, median: bool) -> DataFrame:
    if cert:
        g = g.withColumn("cert_rate", rate(F.col("certified"), F.col("decided")))
    return g.select(by, F.col("_n").alias("filings"), *["cert_rate"] * cert, *["median_annual_wage"] * median).orderBy(
        F.desc("filings"), F.asc(by))


def kpis(df: DataFrame, signal_flag: str) -> DataFrame:
    d = distribution(df, [], "ANNUAL_WAGE", {
        "decided": F.col("DECIDED"), "certified": F.col("CERTIFIED"), "wage_n": F.col("ANNUAL_WAGE").isNotNull(),
        "signalled": F.col(signal_flag), "asked": F.col(signal_flag).isNotNull()})
    return d.summary({"median_wage": 0.5}).select(
        F.col("_n").alias("matched"), "decided", rate(F.col("certified"), F.col("decided")).alias("cert_rate"), "median_wage",
        "wage_n", rate(F.col("signalled"), F.col("asked")).alias("signal_share"))


# -- A6 / A7 / A8 ---------------------------------------------------------------

def employer_mix(df: DataFrame, employer: str = "EMPLOYER_CANONICAL", min_filings: int = 10) -> DataFrame:
    g = _drop_null_keys(df, [employer]).groupBy(employer).agg(
        F.count("MBA_TIER").alias("total"),
        F.count_if(F.col("MBA_TIER") != "excluded").alias("mba_relevant"),
    )
    g = g.withColumn("mba_share", rate(F.col("mba_relevant"), F.col("total")))
    return g.where(F.col("total") >= min_filings).orderBy(F.desc("mba_share"), F.desc("mba_relevant"), F.asc(employer))


def relevance_counts() -> dict[str, Column]:
    return {"total_filings": F.col("MBA_TIER").isNotNull(), "mba_relevant_filings": F.col("MBA_TIER") != "excluded"}


def lca_employer_counts(hire_flag: str = "IS_NEW_HIRE") -> dict[str, Column]:
    return {**relevance_counts(), "_kept": not_denied("CASE_STATUS"), "_hired": F.col(hire_flag), "_asked": F.col(hire_flag).isNotNull(),
            "_willful": yes_flag("WILLFUL_VIOLATOR"), "_dependent": yes_flag("H_1B_DEPENDENT")}


def perm_employer_counts() -> dict[str, Column]:
    return {**relevance_counts(), "_kept": not_denied("CASE_STATUS"), "_external": yes_flag("OTHER_REQ_IS_FW_CURRENTLY_WRK", "N")}


def employer_scorecard_lca(df: DataFrame, min_filings: int = 10, employer: str = "EMPLOYER_CANONICAL",
                           hire_flag: str = "IS_NEW_HIRE", wage: str = "ANNUAL_WAGE_FROM") -> DataFrame:
    return employer_scorecard_lca_of(distribution(df, [employer], wage, lca_employer_counts(hire_flag)), min_filings)


def employer_scorecard_lca_of(d: Distribution, min_filings: int = 10) -> DataFrame:
    """The LCA employer scorecard of a stored distribution with ``lca_employer_counts``."""
    shares = {"certified": ("_kept", "_n"), "new_position_share": ("_hired", "_asked")}
    flags = [(F.col("_willful") > 0).alias("any_willful_violator"), (F.col("_dependent") > 0).alias("any_h1b_dependent")]
    return _employer_scorecard(d, min_filings, "median_annual_wage", shares, flags)


def employer_scorecard_perm(df: DataFrame, min_filings: int = 5, employer: str = "EMPLOYER_CANONICAL") -> DataFrame:
    return employer_scorecard_perm_of(distribution(df, [employer], "EMP_NUM_PAYROLL", perm_employer_counts()), min_filings)


def employer_scorecard_perm_of(d: Distribution, min_filings: int = 5) -> DataFrame:
    """The PERM employer scorecard of a stored distribution with ``perm_employer_counts``."""
    shares = {"certified": ("_kept", "_n"), "external_hire_share": ("_external", "_n")}
    return _employer_scorecard(d, min_filings, "median_company_payroll", shares, [])


def _employer_scorecard(d: Distribution, min_filings: int, median: str, shares: dict[str, tuple[str, str]], extra: list[Column]) -> DataFrame:
    employer = d.by[0]
    g = d.summary({median: 0.5}).where(F.col("mba_relevant_filings") >= min_filings)
    return g.select(
        employer, "total_filings", "mba_relevant_filings", *[rate(F.col(a), F.col(b)).alias(name) for name, (a, b) in shares.items()], *extra,
        median, rate(F.col("mba_relevant_filings"), F.col("total_filings")).alias("mba_share")).orderBy(
        F.desc("mba_share"), F.desc("mba_relevant_filings"), F.asc(employer))


# -- A11 / A12 / A13 ------------------------------------------------------------

def yoy_by_quarter(df: DataFrame, base_fy: int, next_fy: int, max_quarter: int = 3) -> DataFrame:
    q = df.where((F.col("FISCAL_QUARTER") <= max_quarter) & F.col("FISCAL_YEAR").isin(base_fy, next_fy))
    g = q.groupBy("FISCAL_QUARTER").agg(
        F.count_if(F.col("FISCAL_YEAR") == base_fy).alias("base_filings"),
        F.count_if(F.col("FISCAL_YEAR") == next_fy).alias("next_filings"),
    ).where((F.col("base_filings") > 0) | (F.col("next_filings") > 0))
    w = Window.partitionBy()
    return g.withColumn(
        "pct_change_total",
        (rate(F.sum("next_filings").over(w), F.sum("base_filings").over(w)) - 1) * 100,
    )


def yoy_by_tier(df: DataFrame, base_fy: int, next_fy: int, tiers=("core", "adjacent", "excluded"),
                tier_col: str = "MBA_TIER", max_quarter: int = 3) -> DataFrame:
    """Per tier: Q1..Q3 filings in both years and % change; a tier row is
    emitted only when both years occur and the base count is positive."""
    q = df.where((F.col("FISCAL_QUARTER") <= max_quarter) & F.col("FISCAL_YEAR").isin(base_fy, next_fy))
    g = q.groupBy(tier_col).agg(
        F.count_if(F.col("FISCAL_YEAR") == base_fy).alias("base_filings"),
        F.count_if(F.col("FISCAL_YEAR") == next_fy).alias("next_filings"),
    )
    w = Window.partitionBy()
    both_years = (F.sum("base_filings").over(w) > 0) & (F.sum("next_filings").over(w) > 0)
    g = g.withColumn("_both", both_years)
    out = g.where(F.col(tier_col).isin(*tiers) & F.col("_both") & (F.col("base_filings") > 0))
    return out.select(tier_col, "base_filings", "next_filings",
                      ((F.col("next_filings") / F.col("base_filings") - 1) * 100).alias("pct_change"))


def fiscal_coverage(df: DataFrame) -> DataFrame:
    src = df.where(F.col("FISCAL_YEAR").isNotNull() & F.col("FISCAL_QUARTER").isNotNull())
    return src.groupBy("FISCAL_YEAR").pivot("FISCAL_QUARTER", [1, 2, 3, 4]).agg(F.count(F.lit(1))) \
        .na.fill(0).withColumnsRenamed({"1": "Q1", "2": "Q2", "3": "Q3", "4": "Q4"})


# -- A14 / A15 ------------------------------------------------------------------

def monthly_series(df: DataFrame, date_col: str = "RECEIVED_DATE") -> DataFrame:
    """Month-end counts with months that have no filings filled as 0."""
    counts = df.where(F.col(date_col).isNotNull()).groupBy(F.last_day(date_col).alias("month_end")) \
        .agg(F.count(F.lit(1)).alias("filings"))
    bounds = counts.agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
    months = bounds.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"),
                                                F.expr("INTERVAL 1 MONTH"))).alias("m")) \
        .select(F.last_day("m").alias("month_end"))
    return months.join(counts, "month_end", "left").select(
        "month_end", F.coalesce("filings", F.lit(0)).cast("long").alias("filings"))


def seasonality(df: DataFrame, date_col: str = "RECEIVED_DATE") -> DataFrame:
    spark = df.sparkSession
    counts = df.where(F.col(date_col).isNotNull()).groupBy(F.month(date_col).alias("month")) \
        .agg(F.count(F.lit(1)).alias("filings"))
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(counts, "month", "left").select(
        "month", F.coalesce("filings", F.lit(0)).cast("long").alias("filings"))


# -- A16 / A17 ------------------------------------------------------------------

def missingness(df: DataFrame) -> DataFrame:
    """Share of nulls of every column that has any, in percent to one place, the largest first (ties by name)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], cols, "column_name", "_nulls").where(F.col("_nulls") > 0)
    # half up on whole numbers: thousandths of the rows, plus a half
    tenths = F.floor((F.col("_nulls") * 2000 + F.col("_rows")) / (F.col("_rows") * 2))
    return long.select("column_name", (tenths / 10).alias("pct_missing"), "_nulls").orderBy(
        F.desc("_nulls"), "column_name").drop("_nulls")


def column_profile(df: DataFrame) -> DataFrame:
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(*[F.count(c).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "non_null")
    dtype = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return long.withColumn("dtype", dtype[F.col("column_name")])


# -- A18 - A21 ------------------------------------------------------------------

def describe(df: DataFrame, col: str, by=()) -> DataFrame:
    return distribution(df.where(F.col(col).isNotNull()), list(by), col).describe()


def histogram(df: DataFrame, col: str, bins: int, log10: bool = False, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins between the data min and max (last bin closed), 0-filled.

    Optional ``lo``/``hi`` are exclusive pre-filters on the raw value; with
    ``log10`` the bins are laid over log10 of the value.
    """
    x = F.col(col)
    src = df.where(x.isNotNull())
    src = src if lo is None else src.where(x > lo)
    src = src if hi is None else src.where(x < hi)
    return distribution(src, [], col).histogram(bins, log10)


def box_stats(df: DataFrame, col: str, by: str = "MBA_TIER", whisker: float = 1.5) -> DataFrame:
    """Quartiles, Tukey whiskers (most extreme points inside the fences), outlier count."""
    return distribution(df.where(F.col(col).isNotNull()), [by], col).box(whisker)


# -- A22 - A24 ------------------------------------------------------------------

def crosstab_top(df: DataFrame, row: str, col: str, n_rows: int = 15, n_cols: int = 8) -> DataFrame:
    """Long-form crosstab cells for the top rows and, within those rows, top columns.

    Row totals (rows without a column value included), column totals and cells come from one stored count.
    """
    counts = stored(df.where(F.col(row).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("filings")))
    top_rows = _ranked_top(counts.groupBy(row).agg(F.sum("filings").alias("_t")), row, n_rows, "row_rank")
    cells = counts.where(F.col(col).isNotNull()).join(F.broadcast(top_rows), row)
    top_cols = _ranked_top(cells.groupBy(col).agg(F.sum("filings").alias("_t")), col, n_cols, "col_rank")
    return cells.select(row, "row_rank", col, "filings").join(F.broadcast(top_cols), col)


def _ranked_top(totals: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """The ``k`` keys of the largest ``_t`` with their ranks (k rows in the window)."""
    order = [F.desc("_t"), F.asc(key)]
    return totals.orderBy(*order).limit(k).select(key, F.row_number().over(Window.orderBy(*order)).alias(name))


def level_pivot(df: DataFrame, row: str = "SOC_TITLE", level_col: str = "PW_WAGE_LEVEL",
                levels=("I", "II", "III", "IV")) -> DataFrame:
    src = _drop_null_keys(df, [row, level_col])
    g = src.groupBy(row).agg(*[F.count_if(F.col(level_col) == lv).alias(lv) for lv in levels])
    total = sum((F.col(lv) for lv in levels), F.lit(0))
    return g.withColumn("total", total.cast("long"))


def level_share(df: DataFrame, top: int = 15, row: str = "SOC_TITLE", levels=("I", "II", "III", "IV")) -> DataFrame:
    p = level_pivot(df, row, levels=levels).orderBy(F.desc("total"), F.asc(row)).limit(top)
    return p.select(row, *[(F.col(lv) / F.col("total")).alias(f"share_{lv}") for lv in levels], "total")


def wage_level_mix(df: DataFrame) -> DataFrame:
    return domain_counts(df, "WAGE_LEVEL", WAGE_LEVELS)



# -- A9 leaderboard ---------------------------------------------------------------

def leaderboard(df: DataFrame, other: DataFrame, signal_flag: str, where: Column | None = None,
                min_filings: int = 3, k: int | None = 300, lca_flags: bool = True,
                roles=(), employer: str = "EMPLOYER_CANONICAL") -> DataFrame:
    """Employer ranking over the rows of ``df`` that fulfil ``where``, with the MBA mix taken from all its
    rows and a history flag from the other dataset; all employers for ``k`` None.

    ``df`` is read once: the filter is a condition of the counts, and a row outside it has no wage.
    The joined inputs are one row per employer.
    """
    from filingscope.functions.flags import search_link, yes_label
    from filingscope.operators.entities import history_flag

    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    counts = {"filings": inside, "_cert": inside & F.col("CERTIFIED"), "_dec": inside & F.col("DECIDED"),
              "_signal": inside & F.col(signal_flag), "_asked": inside & F.col(signal_flag).isNotNull(),
              "_mba": F.col("MBA_TIER") != "excluded"}
    if lca_flags:
        counts |= {"_wv": inside & yes_flag("WILLFUL_VIOLATOR"), "_dep": inside & yes_flag("H_1B_DEPENDENT")}
    d = distribution(df, [employer], F.when(inside, F.col("ANNUAL_WAGE")), counts)
    g = d.summary({"median_wage": 0.5}).where(F.col("filings") >= min_filings)
    g = history_flag(g, other, employer, "_hist")
    role_text = ", ".join(sorted(roles)[:2]) if roles else "MBA"
    cols = [
        employer, "filings",
        (F.when(F.col("_mba") > 0, F.col("_mba") / F.col("_n")) * 100).alias("mba_mix_pct"),
        (rate(F.col("_cert"), F.col("_dec")) * 100).alias("cert_rate_pct"),
        (rate(F.col("_signal"), F.col("_asked")) * 100).alias("signal_pct"),
        "median_wage",
        yes_label("_hist").alias("other_history"),
        search_link(F.col(employer), F.lit(role_text)).alias("search_link"),
    ]
    if lca_flags:
        cols += [yes_label(F.col("_wv") > 0).alias("willful_violator"), yes_label(F.col("_dep") > 0).alias("h1b_dependent")]
    out = g.select(*cols).orderBy(F.desc("filings"), F.asc(employer))
    return out if k is None else out.limit(k)
