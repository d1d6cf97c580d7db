"""Execute headline analyses on the enriched Parquet and summarise their final
(AQE) physical plans into PLANS.md: shuffles, join strategies, scan pushdown
and pruning.

Usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.1)
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def summarise(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    pushed = sorted({p for s in scans for p in re.findall(r"PushedFilters: \[([^\]]*)\]", s) if p})
    widths = [len(re.findall(r":", m)) for s in scans for m in re.findall(r"ReadSchema: struct<([^>]*)>", s)]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin", plan)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", plan)),
        "scans": len(scans),
        "max_read_cols": max(widths) if widths else 0,
        "pushed": "; ".join(pushed)[:160],
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from filingscope.operators import cube, entities, search, stats
    from filingscope.operators.search import PERSONA_KEYWORDS, Facets
    from filingscope.plans.enrich import enrich, master_from_raw, shared_employer_map
    from filingscope.session import get_session
    from filingscope.sources.master import write_master
    from filingscope.sources.testbind import lca_raw, perm_raw
    from filingscope.spec import LCA, PERM

    spark = get_session("local[8]", 16)
    base = tempfile.mkdtemp(prefix="plans-")
    lca_raw(spark, sf_dir).write.parquet(f"{base}/lr")
    perm_raw(spark, sf_dir).write.parquet(f"{base}/pr")
    consolidated = master_from_raw(spark.read.parquet(f"{base}/lr"))
    rows = [("consolidate_lca (before write)", summarise(final_plan(consolidated)))]
    write_master(consolidated, f"{base}/lm")
    write_master(master_from_raw(spark.read.parquet(f"{base}/pr")), f"{base}/pm")
    lm, pm = spark.read.parquet(f"{base}/lm"), spark.read.parquet(f"{base}/pm")
    names = shared_employer_map(spark, lm, pm)
    rows.append(("employer name map", summarise(final_plan(names))))
    names.write.parquet(f"{base}/names")
    nm = spark.read.parquet(f"{base}/names")
    rows.append(("enrich_lca (fact join)", summarise(final_plan(enrich(lm, LCA, nm)))))
    enrich(lm, LCA, nm).write.partitionBy("FISCAL_YEAR").parquet(f"{base}/lca")
    enrich(pm, PERM, nm).write.partitionBy("FISCAL_YEAR").parquet(f"{base}/perm")
    lca, perm = spark.read.parquet(f"{base}/lca"), spark.read.parquet(f"{base}/perm")
    lca_mba = lca.where(F.col("MBA_TIER") != "excluded")
    perm_mba = perm.where(F.col("MBA_TIER") != "excluded")
    titles = ("SOC_TITLE", "JOB_TITLE")
    queries = {
        "a4_sector_scorecard": stats.scorecard(lca_mba, "NAICS_SECTOR"),
        "a7_employer_scorecard": stats.employer_scorecard_lca(lca),
        "a9_leaderboard": stats.leaderboard(lca, perm, "HAS_NEW_OR_TRANSFER_POSITION",
                                            search.facet_condition(lca.columns, LCA, Facets())),
        "a12_yoy_by_tier": stats.yoy_by_tier(lca, 1998, 1999),
        "a21_box_stats": stats.box_stats(lca, "ANNUAL_WAGE"),
        "a22_crosstab_top": stats.crosstab_top(lca_mba, "SOC_TITLE", "NAICS_SECTOR"),
        "e6_match_datasets": entities.match_datasets(lca_mba, perm_mba),
        "q6_persona_catalog": search.persona_catalog(lca, titles),
        "q7_persona_top_employers": search.top_per_persona(search.persona_matches(lca, titles, PERSONA_KEYWORDS),
                                                           "EMPLOYER_CANONICAL", 15, 3),
        "k2_lca_cube": cube.build_cube(lca_mba, LCA)[1],
        "k5_employer_meta": cube.employer_meta(lca, perm),
    }
    for name, df in queries.items():
        rows.append((name, summarise(final_plan(df))))
    out = ["| query | shuffles | broadcast joins | sort-merge joins | parquet scans | widest scan (cols) | pushed filters |",
           "|---|---|---|---|---|---|---|"]
    for name, s in rows:
        out.append(f"| {name} | {s['shuffles']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | {s['scans']} | "
                   f"{s['max_read_cols']} | {s['pushed']} |")
    print("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
