"""Pre-aggregated, dictionary-encoded fact cube (K1-K7).

Plan shape: the filing rows are scanned once and aggregated into cells at
the cube grain plus tier (map-side partial aggregation, so a giant employer
collapses to a few partial rows per task).  Every dimension (top-N
occupations, employers with enough filings, states, sectors) and the final
facts are derived from that cells table; the facts join the top-N
occupation dimension by broadcast (bounded by N) and the employer dimension
with a join that AQE sizes at run time.  No filing row is joined to an
unbounded table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.session import ensure_checkpoint_dir
from filingscope.operators.distribution import distribution, stored
from filingscope.operators.entities import match_names
from filingscope.spec import WAGE_LEVELS, FilingsSpec

# The cube's occupations, and the filings that an employer needs to be in it.
TOP_N_OCCUPATIONS = 150
MIN_EMPLOYER_FILINGS = 3


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row in a total order, computed distributedly.

    The frame is range-partitioned and sorted by ``order``; a row's position
    is its offset inside its partition (from ``monotonically_increasing_id``)
    plus the sizes of all earlier partitions (a table with one row per
    partition, broadcast back).  No step funnels the rows into one task.
    The tagged rows are written to the shared checkpoint folder first: sizes
    and positions must come from one and the same range partitioning.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    sizes = tagged.groupBy("_pid").agg((F.max("_pos") + 1).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).select("_pid", "_off")
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_pos")).cast("int"))
            .drop("_mid", "_pid", "_pos", "_off"))


@dataclass
class CubeDims:
    occupations: DataFrame   # OCC_TITLE, filings, occ_idx, tier
    employers: DataFrame     # EMPLOYER_CANONICAL, filings, emp_idx
    states: DataFrame        # STATE, state_idx
    sectors: DataFrame       # NAICS_SECTOR, sector_idx


def cell_keys(spec: FilingsSpec, with_wage_level: bool, employer: str | Column = "EMPLOYER_CANONICAL") -> list[str | Column]:
    """The grouping keys of a cell: the cube's grain plus the tier."""
    flag = "IS_NEW_HIRE" if with_wage_level else "IS_EXTERNAL_HIRE"
    keys = [F.col(spec.occupation_col).alias("OCC_TITLE"), employer, F.col(spec.state_col).alias("STATE"), "NAICS_SECTOR"]
    return [*keys, *(["WAGE_LEVEL"] if with_wage_level else []), F.col(flag).alias("_flag"), "MBA_TIER"]


def cube_cells(df: DataFrame, spec: FilingsSpec, with_wage_level: bool = True) -> DataFrame:
    """The single pass over filing rows: counts at the cube grain plus tier.

    Null keys are kept here (dimension counts include rows the cube later
    drops); every dimension and the final facts are derived from this much
    smaller table, so the fact table is scanned and shuffled once.
    """
    keys = cell_keys(spec, with_wage_level)
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("filings"),
        F.count_if("CERTIFIED").alias("certified"),
        F.count_if("DECIDED").alias("decided"),
        F.sum(F.col("ANNUAL_WAGE").cast("decimal(20,6)")).alias("wage_sum"),  # exact in any order
        F.count("ANNUAL_WAGE").alias("wage_n"),
    )
    # Materialise once in the shared checkpoint folder: the dimensions filter
    # the cells differently, and the optimizer would push each filter into its
    # own re-scan of the filing rows instead of reusing one aggregation.
    ensure_checkpoint_dir(df.sparkSession)
    return cells.checkpoint(eager=True)


def dims_from_cells(cells: DataFrame, n_occ: int = TOP_N_OCCUPATIONS, min_emp: int = MIN_EMPLOYER_FILINGS) -> CubeDims:
    occ_counts = cells.where(F.col("OCC_TITLE").isNotNull()).groupBy("OCC_TITLE") \
        .agg(F.sum("filings").alias("filings"))
    order = [F.desc("filings"), F.asc("OCC_TITLE")]
    top = occ_counts.orderBy(*order).limit(n_occ)
    # bounded by n_occ rows: a global window is fine here
    top = top.withColumn("occ_idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    # the tier shown for an occupation is its most common tier (ties alphabetical)
    tiers = cells.where(F.col("OCC_TITLE").isNotNull()).groupBy("OCC_TITLE", "MBA_TIER") \
        .agg(F.sum("filings").alias("_n")) \
        .groupBy("OCC_TITLE").agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("MBA_TIER"))).getField("MBA_TIER")
                                  .alias("tier"))
    occupations = top.join(tiers, "OCC_TITLE", "left").withColumn("tier", F.coalesce("tier", F.lit("adjacent")))

    emp_counts = cells.where(F.col("EMPLOYER_CANONICAL").isNotNull()).groupBy("EMPLOYER_CANONICAL") \
        .agg(F.sum("filings").alias("filings")).where(F.col("filings") >= min_emp)
    employers = dense_index(emp_counts, [F.desc("filings"), F.asc("EMPLOYER_CANONICAL")], "emp_idx")
    states = dense_index(cells.where(F.col("STATE").isNotNull()).select("STATE").distinct(), [F.asc("STATE")],
                         "state_idx")
    sectors = dense_index(cells.where(F.col("NAICS_SECTOR").isNotNull()).select("NAICS_SECTOR").distinct(),
                          [F.asc("NAICS_SECTOR")], "sector_idx")
    return CubeDims(occupations, employers, states, sectors)


def cube_dims(df: DataFrame, spec: FilingsSpec, n_occ: int = TOP_N_OCCUPATIONS,
              min_emp: int = MIN_EMPLOYER_FILINGS, with_wage_level: bool | None = None) -> CubeDims:
    wl = (spec.name == "lca") if with_wage_level is None else with_wage_level
    return dims_from_cells(cube_cells(df, spec, wl), n_occ, min_emp)


def wage_level_index(col) -> Column:
    pos = F.array_position(F.array(*[F.lit(x) for x in WAGE_LEVELS]), F.col(col))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(WAGE_LEVELS) - 1)).cast("int")


def facts_from_cells(cells: DataFrame, dims: CubeDims, with_wage_level: bool = True) -> DataFrame:
    """Cells restricted to the dimensions, re-aggregated without tier, dictionary-encoded."""
    sub = cells.join(F.broadcast(dims.occupations.select("OCC_TITLE", "occ_idx")), "OCC_TITLE") \
        .where(F.col("STATE").isNotNull() & F.col("EMPLOYER_CANONICAL").isNotNull())
    keys = ["occ_idx", "EMPLOYER_CANONICAL", "STATE", "NAICS_SECTOR"] + (["WAGE_LEVEL"] if with_wage_level else []) \
        + ["_flag"]
    g = sub.groupBy(*keys).agg(
        F.sum("filings").alias("filings"), F.sum("certified").alias("certified"), F.sum("decided").alias("decided"),
        F.round(F.coalesce(F.sum("wage_sum"), F.lit(0)), 2).cast("double").alias("wage_sum"),
        F.sum("wage_n").alias("wage_n"))
    enc = (g.join(dims.employers.select("EMPLOYER_CANONICAL", "emp_idx"), "EMPLOYER_CANONICAL")
           .join(dims.states, "STATE", "left")              # data-dependent size: AQE decides
           .join(F.broadcast(dims.sectors), "NAICS_SECTOR", "left"))  # <= 22 values: fixed sector dictionary
    cols = [F.col("occ_idx").alias("occ"), F.col("emp_idx").alias("emp"),
            F.coalesce("state_idx", F.lit(-1)).alias("state"), F.coalesce("sector_idx", F.lit(-1)).alias("sector")]
    if with_wage_level:
        cols.append(wage_level_index("WAGE_LEVEL").alias("wage_level"))
    cols.append(F.col("_flag").cast("int").alias("new_hire" if with_wage_level else "external_hire"))
    cols += ["filings", "certified", "decided", "wage_sum", "wage_n"]
    return enc.select(*cols)


def cube_facts(df: DataFrame, spec: FilingsSpec, dims: CubeDims, with_wage_level: bool = True) -> DataFrame:
    return facts_from_cells(cube_cells(df, spec, with_wage_level), dims, with_wage_level)


def build_cube(df: DataFrame, spec: FilingsSpec, with_wage_level: bool = True,
               n_occ: int = TOP_N_OCCUPATIONS, min_emp: int = MIN_EMPLOYER_FILINGS) -> tuple[CubeDims, DataFrame]:
    """Dimensions and facts from one cells table (one scan of the filing rows)."""
    cells = cube_cells(df, spec, with_wage_level)
    dims = dims_from_cells(cells, n_occ, min_emp)
    return dims, facts_from_cells(cells, dims, with_wage_level)


def cube_coverage(facts: DataFrame, mba: DataFrame, dataset: str) -> DataFrame:
    f = facts.agg(F.sum("filings").alias("cube_filings"))
    m = mba.agg(F.count(F.lit(1)).alias("mba_total"))
    # both sides are single-row aggregates: attach with a constant-key broadcast join
    j = f.withColumn("_k", F.lit(1)).join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k")
    return j.select(F.lit(dataset).alias("dataset"), "mba_total", F.col("cube_filings").cast("long").alias("cube_filings"),
                    F.try_divide(F.col("cube_filings").cast("double"), F.col("mba_total").cast("double")).alias("coverage"))


def employer_meta(lca: DataFrame, perm: DataFrame, min_emp: int = MIN_EMPLOYER_FILINGS) -> DataFrame:
    """Metadata of every employer with ``min_emp`` MBA-relevant filings in either dataset.

    Each dataset is read once: counts by employer (with the payroll's distribution for PERM) give the
    employer list, the flags, the shares and the names that both datasets share.
    """
    emp, mba = "EMPLOYER_CANONICAL", F.col("MBA_TIER") != "excluded"
    ls = stored(lca.where(F.col(emp).isNotNull()).groupBy(emp).agg(
        F.count(F.lit(1)).alias("_lt"), F.count_if(mba).alias("_lm"),
        F.bool_or(F.coalesce(F.col("WILLFUL_VIOLATOR") == "Y", F.lit(False))).alias("_wv"),
        F.bool_or(F.coalesce(F.col("H_1B_DEPENDENT") == "Y", F.lit(False))).alias("_dep")))
    payroll = distribution(perm, [emp], "EMP_NUM_PAYROLL", {"_pm": mba})
    ps = stored(payroll.totals().withColumnRenamed("_n", "_pt"))
    lm, pm = F.col("_lm"), F.col("_pm")
    m = match_names(*[d.where(n > 0).select(F.col(emp).alias("_name"), n.alias("_n")) for d, n in ((ls, lm), (ps, pm))])
    both = m.where("sponsors_both").select(F.explode(F.array("lca_canonical_name", "perm_canonical_name")).alias(emp)) \
        .where(F.col(emp).isNotNull()).distinct().withColumn("_both", F.lit(True))
    medians = payroll.quantiles({"_pay": 0.5})
    j = (ls.join(ps, emp, "full").where((lm >= min_emp) | (pm >= min_emp))
         .join(medians, emp, "left").join(both, emp, "left"))
    return j.select(
        emp,
        F.coalesce("_both", F.lit(False)).alias("both_pipelines"),
        F.coalesce("_wv", F.lit(False)).alias("willful_violator"),
        F.coalesce("_dep", F.lit(False)).alias("h1b_dependent"),
        F.col("_pay").cast("long").alias("median_payroll"),
        F.try_divide(F.col("_lm").cast("double"), F.col("_lt").cast("double")).alias("lca_mba_share"),
        F.try_divide(F.col("_pm").cast("double"), F.col("_pt").cast("double")).alias("perm_mba_share"),
    )


def cube_slice(facts: DataFrame, employers: DataFrame, sectors: tuple[int, ...] = (), states: tuple[int, ...] = (),
               occupations: tuple[int, ...] = (), wage_levels: tuple[int, ...] = (), flag_only: bool = False,
               flag_col: str = "new_hire") -> DataFrame:
    """Re-aggregate the cube under facet filters into an employer ranking."""
    f = facts
    for col, vals in (("sector", sectors), ("state", states), ("occ", occupations), ("wage_level", wage_levels)):
        if vals:
            f = f.where(F.col(col).isin(*vals))
    if flag_only:
        f = f.where(F.col(flag_col) == 1)
    g = f.groupBy("emp").agg(
        F.sum("filings").alias("filings"), F.sum("certified").alias("certified"), F.sum("decided").alias("decided"),
        F.sum(F.when(F.col(flag_col) == 1, F.col("filings")).otherwise(0)).alias("_flagged"),
        # cents are whole numbers: their sum is exact in any order
        F.sum(F.floor(F.col("wage_sum") * 100 + 0.5)).alias("_cents"), F.sum("wage_n").alias("_wn"))
    names = employers.select(F.col("emp_idx").alias("emp"), "EMPLOYER_CANONICAL")
    return g.join(names, "emp").select(
        "emp", "EMPLOYER_CANONICAL", "filings",
        F.try_divide(F.col("certified").cast("double"), F.col("decided").cast("double")).alias("cert_rate"),
        F.try_divide(F.col("_flagged").cast("double"), F.col("filings").cast("double")).alias("flag_share"),
        (F.try_divide(F.col("_cents").cast("double"), F.col("_wn").cast("double")) / 100).alias("mean_wage"),
    )
