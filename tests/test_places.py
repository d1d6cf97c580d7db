"""Stored rows left out, or taken, by their place in their files; what a refresh moves and leaves behind."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from filingscope.operators.ingest import latest_source_wins
from filingscope.session import scratch_path
from filingscope.sources import master
from tests.test_refresh import SCHEMA


@pytest.mark.parametrize("most", [master.MAX_MARKS, 0], ids=["sent", "joined"])
def test_rows_at_places(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(master, "MAX_MARKS", most)
    path = str(tmp_path / "rows")
    spark.range(30_000).withColumn("part", F.col("id") % 2).repartition(3).write.partitionBy("part").parquet(path)
    rows = spark.read.parquet(path)
    wanted = (F.col("id") % 7 == 0) | F.col("id").between(9_000, 14_000)
    marks = master.marks_of(master.placed(rows).where(wanted))
    assert marks.count() < 30
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(master.rows_at(rows, marks)) == ids(rows.where(wanted))
    other = master.rows_at(rows, marks, there=False)
    assert ids(other) == ids(rows.where(~wanted)) and other.columns == rows.columns
    assert ids(master.rows_at(rows.where("part = 1"), marks, there=False)) == ids(rows.where(~wanted & (F.col("part") == 1)))
    if most:
        plan = other._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan  # no row moves
    none = master.marks_of(master.placed(rows).where("false"))
    assert master.rows_at(rows, none, there=False).count() == 30_000 and master.rows_at(rows, none).isEmpty()


def scratch(spark):
    return set(glob.glob(os.path.join(os.path.dirname(scratch_path(spark, "x")), "*")))


def test_refresh_moves_cases_and_leaves_nothing(spark, tmp_path):
    """Whole rows (200 bytes of text each) are neither shuffled nor kept aside: only keys are."""
    path, n = str(tmp_path / "master"), 20_000
    wide = F.concat_ws("", *[F.md5(F.concat_ws("-", "id", F.lit(i))) for i in range(6)]).alias("text")

    def export(order, first):
        return spark.range(first, first + n).select(
            F.concat(F.lit("C-"), F.col("id")).alias("CASE_NUMBER"), F.lit(order).alias("SOURCE_ORD"), wide,
            (F.lit(2000) + F.col("id") % 5).cast("int").alias("FISCAL_YEAR"), F.lit(1).alias("FISCAL_QUARTER"))

    master.write_master(export(1, 0), path)
    before, tracker = scratch(spark), spark.sparkContext._jsc.sc().statusStore()
    first = spark.sparkContext.parallelize([0], 1).count() and max(s.stageId() for s in stages(tracker))
    master.refresh_master(spark, export(2, n // 2), path)
    moved = sum(s.shuffleWriteBytes() for s in stages(tracker) if s.stageId() > first)
    assert moved < n * 100
    assert scratch(spark) == before
    got = spark.read.parquet(path)
    assert got.count() == n * 3 // 2 and got.where("SOURCE_ORD = 2").count() == n


def stages(store):
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]


def test_refresh_of_rows_without_a_case(spark, tmp_path):
    """Rows without a case number are one case, as in a full consolidation, wherever they are stored."""
    path = str(tmp_path / "master")
    old = [(None, 1, 1, 2024, 1), ("a", 1, 2, 2024, 1), (None, 1, 3, 2024, 2)]
    new = [(None, 2, 4, 2025, 1), ("b", 2, 5, 2025, 1)]
    one, two = (spark.createDataFrame(rows, SCHEMA) for rows in (old, new))
    master.write_master(one, path)
    assert master.refresh_master(spark, two, path) == [(2024, 1), (2024, 2), (2025, 1)]
    want = latest_source_wins(one.unionByName(two))
    assert sorted(map(str, spark.read.parquet(path).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert not os.path.exists(f"{path}/FISCAL_YEAR=2024/FISCAL_QUARTER=2")  # its last row went


def test_cube_refresh_keeps_its_cells_compressed_and_nothing_else(spark, tmp_path):
    """Cells of the exports lie in a landed folder; exports, places and marks of a finished step are gone."""
    from filingscope.operators import cube_refresh
    from filingscope.operators.entities import spelling_map
    from filingscope.operators.ingest import add_fiscal_calendar
    from filingscope.sources import testbind
    from filingscope.spec import LCA
    from tests.conftest import SF_SMALL

    rows = add_fiscal_calendar(testbind.lca_raw(spark, SF_SMALL))
    path, cells, before = str(tmp_path / "master"), str(tmp_path / "cells"), scratch(spark)
    for number, order in enumerate((1, 2)):
        cube_refresh.take_export(spark, rows.where(F.col("SOURCE_ORD") == order), path, cells, number, LCA, here=number == 1)
        assert scratch(spark) == before
    assert rows.count() > spark.read.parquet(path).count() > 0  # the caller's rows stay
    names = spelling_map(spark, (spark.read.parquet(path), LCA.employer_col))
    now = cube_refresh.stored_cells(spark, cells, names)
    left = {os.path.basename(d).split("-")[0] for d in scratch(spark) - before}
    assert left == {"cells", "spellings"} and now.inputFiles()


def test_master_of_stored_rows_equals_latest_source_wins(spark, tmp_path):
    from filingscope.plans.enrich import master_from_raw, master_of

    rows = [(f"c{i % 50}" if i % 11 else None, None if i % 13 == 0 else i % 3, i, f"2024-{i % 12 + 1:02}-01") for i in range(2_000)]
    rows += [("giant", i % 4, i, "2023-05-05") for i in range(3_000)] + [("unordered", None, 1, None), ("unordered", None, 2, None)]
    spark.createDataFrame(rows, "CASE_NUMBER string, SOURCE_ORD int, v int, d string").select(
        "*", F.to_date("d").alias("RECEIVED_DATE"), F.lit(None).cast("date").alias("DECISION_DATE")).repartition(3).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    got, want = master_of(raw, master.stale_marks(raw)), master_from_raw(raw)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_datasets_keep_the_master_and_names_only(spark):
    """The rows a stored master was made from go with it, unless a plan over them was handed out."""
    from filingscope.plans.enrich import Datasets
    from tests.conftest import SF_SMALL

    labels = lambda: sorted(os.path.basename(d).rsplit("-", 1)[0] for d in scratch(spark) - before)
    before, ds = scratch(spark), Datasets(spark, SF_SMALL)
    rows = ds.lca.count()
    assert "lca-raw" not in labels() and "marks" not in labels() and "lca-master" in labels()
    other = Datasets(spark, SF_SMALL)
    plan = other.lca_master
    assert other.lca.count() == plan.count() == rows and "lca-raw" in labels()


def test_persona_query_stores_no_raw_rows_to_its_end(spark):
    """What the top occupations read is the master; the joined rows it was made from are gone."""
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL

    before = scratch(spark)
    top = entry.queries()["q7_persona_top_occupations_lca"](spark, SF_SMALL)
    left = {os.path.basename(d).rsplit("-", 1)[0] for d in scratch(spark) - before}
    assert left == {"lca-master", "spellings", "names"} and top.count() > 0
