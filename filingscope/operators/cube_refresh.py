"""The cube kept up to date export by export (K1-K3 maintained, not rebuilt).

A folder holds signed cells, an export each: rows that an export adds count +1, stored rows that it supersedes count -1,
at the cube's grain but by the employer's raw spelling, so that a later change of canonical names needs no filing.  The
sum of all exports' cells is the cells of the master; wages are decimals, so subtracting is exact.  Dimensions are
ranked again from these sums.  Only an export's own rows and the stored rows of its cases are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.operators.cube import CubeDims, cell_keys, dims_from_cells, facts_from_cells
from filingscope.operators.entities import apply_canonical
from filingscope.plans.enrich import enrich
from filingscope.session import discard, landed, path_exists, sweep
from filingscope.sources.master import (
    fresh_rows,
    known_rows,
    marks_of,
    newest_of,
    newest_rows,
    refresh_master,
    rows_at,
    superseded,
    write_master,
)
from filingscope.spec import FilingsSpec

MEASURES = ("filings", "certified", "decided", "wage_sum", "wage_n")


def changes(master: DataFrame, new: DataFrame, known: DataFrame, marks: DataFrame, key: str = "CASE_NUMBER",
            order_col: str = "SOURCE_ORD") -> tuple[DataFrame, DataFrame]:
    """(rows that ``refresh_master`` will add, rows that it will remove) when ``new`` meets the stored master.

    ``new`` comes from ``newest_rows``, ``known`` from ``known_rows``, ``marks`` from what it has ``superseded``: the refresh
    reads the same.  Rows to remove are read at their places.
    """
    return fresh_rows(new, known, key, order_col), rows_at(master, marks)


def signed_cells(rows: DataFrame, spec: FilingsSpec, with_wage_level: bool) -> DataFrame:
    """Cells of master rows that carry ``_sign``: every measure is a sum of signs or signed wages."""
    mba = enrich(rows, spec).where(F.col("MBA_TIER") != "excluded")
    sign, wage = F.col("_sign"), F.col("ANNUAL_WAGE").cast("decimal(20,6)")
    return mba.groupBy(*cell_keys(spec, with_wage_level, F.col(spec.employer_col).alias("EMPLOYER"))).agg(
        F.sum(sign).alias("filings"), F.sum(F.when(F.col("CERTIFIED"), sign).otherwise(0)).alias("certified"),
        F.sum(F.when(F.col("DECIDED"), sign).otherwise(0)).alias("decided"), F.sum(wage * sign).alias("wage_sum"),
        F.sum(F.when(wage.isNotNull(), sign).otherwise(0)).alias("wage_n"))


def take_export(spark: SparkSession, new: DataFrame, master: str, cells: str, number: int, spec: FilingsSpec,
                with_wage_level: bool = True, here: bool = False) -> None:
    """Record what an export changes in the cube, then refresh the master with it.

    The cells are written first, against the master as it was; a call repeated after a failure keeps cells that are
    complete and repeats the refresh only, so nothing is counted twice.  ``here``: ``new`` is read from stored files.
    """
    there = path_exists(spark, master)
    export = newest_rows(new, here=here)
    scratch = [] if export is new else [export]
    if there:
        stored_rows = spark.read.option("mergeSchema", True).parquet(master)
        known = known_rows(stored_rows, newest_of(export))
        marks = marks_of(superseded(known))
        scratch += [known, marks]
    if not path_exists(spark, f"{cells}/batch={number}/_SUCCESS"):
        if there:
            added, removed = changes(stored_rows, export, known, marks)
            rows = added.withColumn("_sign", F.lit(1)).unionByName(removed.withColumn("_sign", F.lit(-1)), allowMissingColumns=True)
        else:
            rows = export.withColumn("_sign", F.lit(1))
        signed_cells(rows, spec, with_wage_level).write.mode("overwrite").parquet(f"{cells}/batch={number}")
        sweep(spark)
    if there:
        refresh_master(spark, export, master, known=known, marks=marks)
    else:
        write_master(export, master, rebalance=False)
    for frame in scratch:
        discard(frame)


def stored_cells(spark: SparkSession, cells: str, names: DataFrame) -> DataFrame:
    """The cells of all exports, as ``cube.cube_cells`` of the master has them, under the canonical names of ``names``.

    Cells are dealt by spelling once: their sums and the lookup of the spelling's name need no other exchange.
    """
    rows = spark.read.parquet(cells)
    sums = [F.sum(m).alias(m) for m in MEASURES]
    keys = [c for c in rows.columns if c not in (*MEASURES, "batch")]
    live = rows.repartition("EMPLOYER").groupBy(*keys).agg(*sums).where(F.col("filings") != 0)
    named = apply_canonical(live, "EMPLOYER", None, names)
    return landed(named.groupBy(*[c for c in keys if c != "EMPLOYER"], "EMPLOYER_CANONICAL").agg(*sums), "cells")


def refreshed_cube(spark: SparkSession, cells: str, names: DataFrame, with_wage_level: bool = True) -> tuple[CubeDims, DataFrame]:
    """Dimensions and facts from the stored cells; no filing is read."""
    now = stored_cells(spark, cells, names)
    dims = dims_from_cells(now)
    return dims, facts_from_cells(now, dims, with_wage_level)
