"""Cross-operator invariants on the smallest tables."""

from pyspark.sql import functions as F

from filingscope.operators import cube, entities, stats
from filingscope.plans.enrich import Datasets
from filingscope.spec import LCA
from tests.conftest import SF_SMALL


def test_group_counts_sum_to_non_null_rows(spark):
    ds = Datasets(spark, SF_SMALL)
    lca = ds.lca
    total = stats.value_counts(lca, "WORKSITE_STATE").agg(F.sum("filings")).first()[0]
    assert total == lca.where(F.col("WORKSITE_STATE").isNotNull()).count()


def test_consolidated_master_has_one_source_per_case(spark):
    m = Datasets(spark, SF_SMALL).lca_master
    assert m.groupBy("CASE_NUMBER").agg(F.count_distinct("SOURCE_ORD").alias("n")).where("n > 1").count() == 0


def test_canonical_map_is_idempotent(spark):
    ds = Datasets(spark, SF_SMALL)
    canon = entities.canonical_map((ds.lca_master, "EMPLOYER_NAME"), (ds.perm_master, "EMP_BUSINESS_NAME"))
    names = canon.select(F.col("canonical_name").alias("n")).distinct()
    again = entities.canonical_map((names, "n"))
    assert again.where(F.col("raw_name") != F.col("canonical_name")).count() == 0


def test_cube_covers_at_most_mba_rows_and_slice_equals_direct(spark):
    ds = Datasets(spark, SF_SMALL)
    mba = ds.lca_mba()
    dims = cube.cube_dims(mba, LCA)
    facts = cube.cube_facts(mba, LCA, dims)
    assert facts.agg(F.sum("filings")).first()[0] <= mba.count()
    # re-aggregating the cube per employer equals aggregating the filtered rows directly
    sliced = {r.EMPLOYER_CANONICAL: (r.filings, r.cert_rate) for r in cube.cube_slice(facts, dims.employers).collect()}
    kept = (mba.join(dims.occupations.select(F.col("OCC_TITLE").alias("SOC_TITLE")), "SOC_TITLE", "left_semi")
            .join(dims.employers.select("EMPLOYER_CANONICAL"), "EMPLOYER_CANONICAL", "left_semi")
            .where(F.col("WORKSITE_STATE").isNotNull()))
    direct = {r.EMPLOYER_CANONICAL: (r.filings, r.cert_rate) for r in kept.groupBy("EMPLOYER_CANONICAL").agg(
        F.count(F.lit(1)).alias("filings"),
        F.try_divide(F.count_if("CERTIFIED").cast("double"), F.count_if("DECIDED").cast("double")).alias("cert_rate"),
    ).collect()}
    assert sliced == direct


def test_dimension_indexes_are_dense(spark):
    ds = Datasets(spark, SF_SMALL)
    dims = cube.cube_dims(ds.lca_mba(), LCA)
    for df, col in ((dims.employers, "emp_idx"), (dims.states, "state_idx"), (dims.sectors, "sector_idx"),
                    (dims.occupations, "occ_idx")):
        idx = sorted(r[0] for r in df.select(col).collect())
        assert idx == list(range(len(idx)))
