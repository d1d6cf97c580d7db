"""Enrichment of master rows and the standard dataset builders.

``enrich`` adds every derived column the analyses read, in one projection
plus one lookup join (raw employer name -> canonical/brand label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.functions.classify import mba_tier, naics_sector
from filingscope.functions.flags import (
    NEW_HIRE_COLUMNS,
    NEW_ONLY_COLUMNS,
    NEW_OR_TRANSFER_COLUMNS,
    certified,
    decided,
    external_hire_flag,
    new_hire_flag,
    positions_sum,
)
from filingscope.functions.wages import annual_wage, bounded
from filingscope.operators.entities import apply_canonical, spelling_map
from filingscope.operators.ingest import add_fiscal_calendar, latest_source_wins
from filingscope.session import discard, landed
from filingscope.sources import testbind
from filingscope.sources.master import rows_at, stale_marks
from filingscope.spec import LCA, PERM, FilingsSpec


def enrich(df: DataFrame, spec: FilingsSpec, names: DataFrame | None = None) -> DataFrame:
    """Add tier, sector, wages, status flags and (given a name map) the employer label."""
    cols = {
        "MBA_TIER": mba_tier(spec.soc_code_col, spec.occupation_col),
        "NAICS_SECTOR": naics_sector(spec.naics_col),
        "ANNUAL_WAGE_FROM": annual_wage(spec.wage_amount_col, spec.wage_unit_col),
        "DECIDED": decided(spec.status_col, spec.decided_statuses),
        "CERTIFIED": certified(spec.status_col, spec.decided_statuses, spec.denied_status),
    }
    if spec.name == "lca":
        cols.update({
            "IS_NEW_HIRE": new_hire_flag(*NEW_HIRE_COLUMNS),
            "HAS_NEW_OR_TRANSFER_POSITION": new_hire_flag(*NEW_OR_TRANSFER_COLUMNS),
            "NEW_OR_TRANSFER_POSITIONS": positions_sum(*NEW_OR_TRANSFER_COLUMNS),
            "IS_NEW_EMPLOYMENT": new_hire_flag(*NEW_ONLY_COLUMNS),
            "WAGE_LEVEL": F.coalesce(F.col("PW_WAGE_LEVEL"), F.lit("Unspecified")),
        })
    else:
        cols["IS_EXTERNAL_HIRE"] = external_hire_flag("OTHER_REQ_IS_FW_CURRENTLY_WRK")
    out = df.withColumns(cols).withColumn("ANNUAL_WAGE", bounded("ANNUAL_WAGE_FROM"))
    if names is not None:
        out = apply_canonical(out, spec.employer_col, None, names)
    return out


def master_from_raw(raw: DataFrame) -> DataFrame:
    """Fiscal calendar + latest-source-wins (when sources are tagged)."""
    df = add_fiscal_calendar(raw)
    if "SOURCE_ORD" in df.columns:
        df = latest_source_wins(df, "CASE_NUMBER", "SOURCE_ORD")
    return df


def master_of(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """``master_from_raw`` of stored rows, which stay where they are; ``marks``: their ``stale_marks``."""
    return add_fiscal_calendar(rows_at(raw, marks, there=False))


def lca_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testbind.lca_raw(spark, sf_dir)
    return master_of(raw, stale_marks(raw))


def perm_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_from_raw(testbind.perm_raw(spark, sf_dir))


def shared_employer_map(spark: SparkSession, lca: DataFrame, perm: DataFrame) -> DataFrame:
    """One raw-name -> label map across both datasets (so both settle on one spelling)."""
    return spelling_map(spark, (lca, LCA.employer_col), (perm, PERM.employer_col))


class Datasets:
    """Lazily built master + enriched frames for one data directory.

    A dataset that is enriched is read more than once (for the names, then for each analysis): its master is stored at
    first use, and so is the name map.  ``lca_master`` and ``perm_master`` stay plans until then.  The rows that the LCA
    master was made from go when it is stored, unless such a plan is out.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, lca: DataFrame | None = None,
                 perm: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._masters = {name: df for name, df in (("lca", lca), ("perm", perm)) if df is not None}
        self._stored: set[str] = set()
        self._made_from: list[DataFrame] = []  # of the LCA master, while no plan over them is out
        self._names = None

    def _master(self, name: str) -> DataFrame:
        if name not in self._masters:
            if name == "lca":
                raw = testbind.lca_raw(self.spark, self.sf_dir)
                self._made_from = [raw, stale_marks(raw)]
                self._masters[name] = master_of(*self._made_from)
            else:
                self._masters[name] = perm_master(self.spark, self.sf_dir)
        return self._masters[name]

    def _kept(self, name: str) -> DataFrame:
        if name not in self._stored:
            self._masters[name] = landed(self._master(name), f"{name}-master")
            self._stored.add(name)
            if name == "lca":
                for frame in self._made_from:
                    discard(frame)
        return self._masters[name]

    @property
    def lca_master(self) -> DataFrame:
        out = self._master("lca")
        if "lca" not in self._stored:
            self._made_from = []
        return out

    @property
    def perm_master(self) -> DataFrame:
        return self._master("perm")

    @property
    def names(self) -> DataFrame:
        if self._names is None:
            self._names = landed(shared_employer_map(self.spark, self.lca_master, self.perm_master), "names")
        return self._names

    @property
    def lca(self) -> DataFrame:
        return enrich(self._kept("lca"), LCA, self.names)

    @property
    def perm(self) -> DataFrame:
        return enrich(self._kept("perm"), PERM, self.names)

    def unnamed_mba(self, spec: FilingsSpec) -> DataFrame:
        """``lca_mba`` or ``perm_mba`` without the employer label: the same rows, no lookup of names."""
        return enrich(self._kept(spec.name), spec).where(F.col("MBA_TIER") != "excluded")

    def lca_mba(self) -> DataFrame:
        return self.lca.where(F.col("MBA_TIER") != "excluded")

    def perm_mba(self) -> DataFrame:
        return self.perm.where(F.col("MBA_TIER") != "excluded")
