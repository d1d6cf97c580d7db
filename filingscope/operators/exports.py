"""All dashboard exports (S6) from one pass over each dataset.

Every export is a rollup of counts, of a distribution, or of both.  ``grouping_cells`` takes all of a dataset's grouping
sets in one pass (GROUPING SETS with map-side partial aggregation), stores their cells once in the shared checkpoint
folder, and splits them by grouping id; the exports are derived from those cells and never read the filings again.
Filings outside an export's filter carry no value there, so they fold into one cell a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.operators import stats
from filingscope.operators.distribution import N, VALUE, Distribution, stored, value_of
from filingscope.operators.entities import match_names
from filingscope.operators.search import PERSONA_KEYWORDS, keyword_match
from filingscope.spec import LCA, PERM, FilingsSpec

EMPLOYER, SECTOR, LEVEL, MBA, SHORT = "EMPLOYER_CANONICAL", "NAICS_SECTOR", "PW_WAGE_LEVEL", "_mba", "_short"
TOP_EMPLOYERS = 200


def grouping_cells(df: DataFrame, keys: dict[str, Column], sets: dict[str, list[str]], counts: dict[str, Column]) -> dict[str, DataFrame]:
    """(set's keys..., _n, counts...) of every named grouping set, from one pass over ``df``.

    A null key is a group of its own, apart from the rolled-up rows of other sets.
    """
    rows = df.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(f"_is{i}") for i, c in enumerate(counts.values())])
    order = list(keys)
    cells = stored(rows.groupingSets([[F.col(k) for k in own] for own in sets.values()], *order).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias(N), *[F.count_if(f"_is{i}").alias(name) for i, name in enumerate(counts)]))
    # a bit for every key that the set leaves out, the first key's being the highest
    gid = {name: sum(1 << (len(order) - 1 - i) for i, k in enumerate(order) if k not in own) for name, own in sets.items()}
    return {name: cells.where(F.col("_set") == gid[name]).select(*own, N, *counts) for name, own in sets.items()}


def dataset_cells(df: DataFrame, spec: FilingsSpec, persona: tuple[str, ...] = PERSONA_KEYWORDS["finance_risk_fintech"],
                  levels: tuple[str, ...] = ("II", "III")) -> dict[str, DataFrame]:
    """The cells that a dataset's exports need."""
    mba = F.coalesce(F.col("MBA_TIER") != "excluded", F.lit(False))
    keys = {spec.occupation_col: F.col(spec.occupation_col), EMPLOYER: F.col(EMPLOYER), SECTOR: F.col(SECTOR),
            spec.state_col: F.col(spec.state_col), MBA: mba}
    if spec.name == "perm":
        keys["_payroll"] = value_of("EMP_NUM_PAYROLL")
        sets = {"occupation": [spec.occupation_col, MBA], "employer": [EMPLOYER, "_payroll"], "sector": [SECTOR, MBA],
                "state": [spec.state_col, MBA]}
        return grouping_cells(df, keys, sets, {**stats.outcome_counts(), **stats.perm_employer_counts()})
    short = F.coalesce(keyword_match(persona, ("SOC_TITLE", "JOB_TITLE"), available=set(df.columns)) & F.col(LEVEL).isin(*levels), F.lit(False))
    keys |= {LEVEL: F.col(LEVEL), SHORT: short, "_wage": F.when(mba, value_of("ANNUAL_WAGE")), "_wage_from": value_of("ANNUAL_WAGE_FROM"),
             "_short_wage": F.when(short, value_of("ANNUAL_WAGE_FROM"))}
    sets = {"occupation": [spec.occupation_col, MBA, LEVEL], "employer": [EMPLOYER, "_wage_from"], "sector": [SECTOR, MBA, "_wage"],
            "state": [spec.state_col, MBA, "_wage"], "shortlist": [EMPLOYER, SHORT, "_short_wage"]}
    return grouping_cells(df, keys, sets, {**stats.outcome_counts(), **stats.lca_employer_counts()})


def counted(cells: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, filings), the most filed first."""
    out = cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(N).alias("filings")).orderBy(F.desc("filings"), F.asc(key))
    return out if k is None else out.limit(k)


def spread(cells: DataFrame, key: str, value: str | None, counts: list[str]) -> Distribution:
    """Cells as the distribution of ``value`` by ``key``."""
    v = F.col(value) if value else F.lit(None).cast("double")
    return Distribution(cells.where(F.col(key).isNotNull()).select(key, v.alias(VALUE), N, *counts), (key,), tuple(counts))


def mix(cells: DataFrame, min_filings: int = 10) -> DataFrame:
    g = spread(cells, EMPLOYER, None, ["total_filings", "mba_relevant_filings"]).totals().select(
        EMPLOYER, F.col("total_filings").alias("total"), F.col("mba_relevant_filings").alias("mba_relevant"),
        stats.rate(F.col("mba_relevant_filings"), F.col("total_filings")).alias("mba_share"))
    return g.where(F.col("total") >= min_filings).orderBy(F.desc("mba_share"), F.desc("mba_relevant"), F.asc(EMPLOYER))


def wage_levels(cells: DataFrame, occupation: str, levels=("I", "II", "III", "IV")) -> DataFrame:
    """(occupation, filings at each level); occupations without any level are left out."""
    known = cells.where(F.col(occupation).isNotNull() & F.col(LEVEL).isNotNull())
    return known.groupBy(occupation).agg(
        *[F.coalesce(F.sum(F.when(F.col(LEVEL) == lv, F.col(N))), F.lit(0)).alias(lv) for lv in levels],
        F.coalesce(F.sum(F.when(F.col(LEVEL).isin(*levels), F.col(N))), F.lit(0)).alias("total")).orderBy(occupation)


def export_tables(lca: DataFrame, perm: DataFrame) -> dict[str, DataFrame]:
    """The 18 exports by file name; each dataset is read once, here."""
    out: dict[str, DataFrame] = {}
    names = {}
    for prefix, df, spec in (("lca", lca, LCA), ("perm", perm, PERM)):
        cells = dataset_cells(df, spec)
        relevant = {name: cells[name].where(MBA) for name in ("occupation", "sector", "state")}
        wage, outcomes = ("_wage" if prefix == "lca" else None), ["certified", "decided"]
        out[f"{prefix}_top_occupations"] = counted(cells["occupation"], spec.occupation_col)
        out[f"{prefix}_top_employers"] = counted(cells["employer"], EMPLOYER, TOP_EMPLOYERS)
        out[f"{prefix}_employer_mba_mix"] = mix(cells["employer"])
        out[f"{prefix}_mba_occupations"] = counted(relevant["occupation"], spec.occupation_col)
        out[f"{prefix}_sector_scorecard"] = stats.scorecard_of(spread(relevant["sector"], SECTOR, wage, outcomes), median=bool(wage))
        out[f"{prefix}_state_scorecard"] = stats.scorecard_of(spread(relevant["state"], spec.state_col, wage, []), cert=False, median=bool(wage))
        if prefix == "lca":
            out["lca_mba_states"] = counted(relevant["state"], spec.state_col)
            out["lca_wage_level_by_occupation"] = wage_levels(relevant["occupation"], spec.occupation_col)
            out["lca_employer_scorecard"] = stats.employer_scorecard_lca_of(
                spread(cells["employer"], EMPLOYER, "_wage_from", list(stats.lca_employer_counts())))
            d = spread(cells["shortlist"].where(SHORT), EMPLOYER, "_short_wage", [])
            out["persona_finance_risk_shortlist"] = d.summary({"median_wage": 0.5}).where(F.col(N) >= 2).select(
                EMPLOYER, F.col(N).alias("matched_filings"), "median_wage").orderBy(F.desc("matched_filings"), F.asc(EMPLOYER))
        else:
            out["perm_employer_scorecard"] = stats.employer_scorecard_perm_of(
                spread(cells["employer"], EMPLOYER, "_payroll", list(stats.perm_employer_counts())))
        names[prefix] = spread(cells["employer"], EMPLOYER, None, ["mba_relevant_filings"]).totals().where("mba_relevant_filings > 0").select(
            F.col(EMPLOYER).alias("_name"), F.col("mba_relevant_filings").alias("_n"))
    out["employer_lca_perm_pipeline"] = match_names(names["lca"], names["perm"]).orderBy("employer_core_key")
    return out
