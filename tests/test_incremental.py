"""The incremental name map, the labels it keeps right, and the ingest report counted by the writes."""

import os

import pytest
from pyspark.sql import functions as F

from filingscope.operators import cube, cube_refresh, name_map
from filingscope.operators.entities import canonical_map, spelling_counts, spelling_map
from filingscope.operators.ingest import add_fiscal_calendar, consolidate, ingest_report, latest_source_wins, prepare_raw
from filingscope.plans.enrich import enrich
from filingscope.sources import testbind
from filingscope.sources.staging import consolidate_observed
from filingscope.spec import LCA, PERM
from tests.conftest import SF_SMALL

BATCHES = [["ACME INC", "ACME INC", "Acme, Inc.", None, "Zed LLC", " Zed LLC "], ["Acme, Inc.", "Acme, Inc.", "Bolt Corp"],
           [], ["BOLT CORP", "BOLT CORP", "", None, "!!!"]]


def frame(spark, names, number=0):
    return spark.createDataFrame([(f"{number}-{i}", n) for i, n in enumerate(names)], "CASE_NUMBER string, name string")


def labels(df):
    return {(r.CASE_NUMBER, r.name, r.CANONICAL_NAME) for r in df.collect()}


def wanted(spark, upto):
    rows = [(f"{k}-{i}", n) for k, b in enumerate(BATCHES[:upto]) for i, n in enumerate(b)]
    every = spark.createDataFrame(rows, "CASE_NUMBER string, name string")
    best = {r.raw_name: r.canonical_name for r in canonical_map((every, "name")).collect()}
    return every, {(c, n, None if n is None else best[n.strip()]) for c, n in rows}


def test_map_equals_a_rebuild_after_each_batch(spark, tmp_path):
    path = str(tmp_path / "map")
    for k, names in enumerate(BATCHES):
        for _ in range(2):  # a repeated batch changes nothing
            name_map.add_spellings(spark, path, k, spelling_counts((frame(spark, names, k), "name")))
        every, _ = wanted(spark, k + 1)
        cols = ["raw_name", "core", "canonical_name", "n"]
        assert sorted(map(tuple, name_map.name_map(spark, path).select(cols).collect())) == \
            sorted(map(tuple, canonical_map((every, "name")).select(cols).collect()))
    first = {r.core: r.canonical_name for r in name_map.winners(spark, path, 1).collect()}
    last = {r.core: r.canonical_name for r in name_map.winners(spark, path).collect()}
    assert "ACME INC" in first.values() and "Acme, Inc." in last.values()  # older versions stay readable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_folders_of_renamed_keys_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "labelled")
    name_map.add_filings(spark, path, 0, frame(spark, BATCHES[0], 0), "name")
    before = files(f"{path}/filings")
    rewritten = name_map.add_filings(spark, path, 1, frame(spark, BATCHES[1], 1), "name")
    after = files(f"{path}/filings")
    touched = [f"bucket={b}{os.sep}" for b in rewritten]
    assert all(after.get(f) == t for f, t in before.items() if not any(x in f for x in touched))
    assert any(f not in after for f in before)  # the renamed employer's folder is a new one
    name_map.add_filings(spark, path, 1, frame(spark, BATCHES[1], 1), "name")
    for k in (2, 3):
        name_map.add_filings(spark, path, k, frame(spark, BATCHES[k], k), "name")
    assert labels(spark.read.parquet(f"{path}/filings")) == wanted(spark, 4)[1]


def test_labelling_a_stream(spark, tmp_path):
    landing, path = str(tmp_path / "landing"), str(tmp_path / "labelled")
    for k, names in enumerate(BATCHES):
        frame(spark, names, k).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema("CASE_NUMBER string, name string").option("maxFilesPerTrigger", 1).parquet(landing)
    name_map.start_labelling(stream, path, "name", str(tmp_path / "cp")).awaitTermination()
    assert labels(spark.read.parquet(f"{path}/filings")) == wanted(spark, 4)[1]


def exports(spark):
    rows = [("old", 1, [("a", "2024-01-05"), ("b", "2024-02-05"), ("", None), (None, None)]),
            ("new", 2, [("b", "2024-03-01"), ("c", None), ("c", "2024-04-01")])]
    return [spark.createDataFrame([(c, "x", d, None) for c, d in r], "CASE_NUMBER string, v string, DECISION_DATE string, RECEIVED_DATE string")
            .withColumns({"SOURCE_FILE": F.lit(s), "SOURCE_ORD": F.lit(o)}) for s, o, r in rows]


def test_observed_report(spark, tmp_path):
    path = str(tmp_path / "master")
    got = consolidate_observed(spark, exports(spark), ["old", "new", "absent"], path)
    want = ingest_report(prepare_raw(exports(spark)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    keys = ["CASE_NUMBER", "SOURCE_FILE", "DECISION_DATE"]
    stored = spark.read.parquet(path).select(keys).collect()
    assert sorted(map(str, stored)) == sorted(map(str, consolidate(exports(spark)).select(keys).collect()))


def test_observed_report_refuses_unlisted_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="not listed"):
        consolidate_observed(spark, exports(spark), ["old"], str(tmp_path / "master"))


@pytest.mark.parametrize("spec", [LCA, PERM], ids=["lca", "perm"])
def test_cube_equals_a_rebuild(spark, tmp_path, spec):
    lca = spec is LCA
    rows = (testbind.lca_raw if lca else testbind.perm_raw)(spark, SF_SMALL)
    rows = add_fiscal_calendar(rows).drop("SOURCE_ORD", "SOURCE_FILE").where("CASE_NUMBER IS NOT NULL").cache()
    third = F.pmod(F.xxhash64("CASE_NUMBER"), F.lit(3))
    # the second export moves cases to another employer, state and status; the third is older than both
    moved = rows.where(third == 1).withColumns({spec.employer_col: F.lit("Mover LLC"), spec.state_col: F.lit("ELSEWHERE"),
                                                spec.status_col: F.lit("Denied")})
    exports = [rows.where(third < 2).withColumn("SOURCE_ORD", F.lit(1)), moved.withColumn("SOURCE_ORD", F.lit(2)),
               rows.where(third > 0).withColumn("SOURCE_ORD", F.lit(0))]
    master, cells = str(tmp_path / "master"), str(tmp_path / "cells")
    for number, new in [*enumerate(exports), (2, exports[2])]:
        cube_refresh.take_export(spark, new, master, cells, number, spec, lca)
    every = latest_source_wins(exports[0].unionByName(exports[1]).unionByName(exports[2]))
    names = spelling_map(spark, (every, spec.employer_col))
    mba = enrich(every, spec, names).where(F.col("MBA_TIER") != "excluded")
    (want_dims, want), (dims, got) = cube.build_cube(mba, spec, lca), cube_refresh.refreshed_cube(spark, cells, names, lca)
    assert want.columns == got.columns and want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for part in ("occupations", "employers", "states", "sectors"):
        assert sorted(map(str, getattr(dims, part).collect())) == sorted(map(str, getattr(want_dims, part).collect()))
