"""Layouts of raw files found in one job, and a master refreshed in place."""

import os

import pytest
from pyspark.sql import functions as F

from filingscope.operators.ingest import latest_source_wins
from filingscope.sources import raw
from filingscope.sources.master import refresh_master, write_master

SCHEMA = "CASE_NUMBER string, SOURCE_ORD int, v int, FISCAL_YEAR int, FISCAL_QUARTER int"


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_layouts_and_own_files(spark, tmp_path):
    write(tmp_path / "a b+c%20.csv", 'CASE_NUMBER,x\n1,"p, ""q"""\n')
    write(tmp_path / "[x]{y}.csv", "x,CASE_NUMBER\r\n,2\r\n")
    write(tmp_path / "lines*.csv", 'CASE_NUMBER,x\n3,"two\nlines"\n')
    write(tmp_path / "twice.csv", "CASE_NUMBER,x,x,\n4,l,r,\n")
    write(tmp_path / "bom.csv", "﻿CASE_NUMBER,x\n5,é\n")
    write(tmp_path / "only header.csv", "CASE_NUMBER,x\n")
    write(tmp_path / "empty.csv", "")
    found = raw.layouts(spark, str(tmp_path))
    assert sum(len(x.files) for x in found) == 6
    assert [x.spans_lines for x in found for f in x.files if "lines" in f] == [True] and sum(x.spans_lines for x in found) == 1
    rows = {r.CASE_NUMBER: (r.x, os.path.basename(r.file)) for r in raw.csv_scan(spark, str(tmp_path), "file").collect()}
    assert rows == {"1": ('p, "q"', "a b+c%20.csv"), "2": (None, "[x]{y}.csv"), "3": ("two\nlines", "lines*.csv"),
                    "4": (None, "twice.csv"), "5": ("é", "bom.csv")}
    listed = raw.csv_scan(spark, [str(tmp_path / "[x]{y}.csv"), str(tmp_path / "bom.csv")])
    assert {r.CASE_NUMBER for r in listed.collect()} == {"2", "5"}


def test_many_files_take_one_job(spark, tmp_path):
    for i in range(150):
        write(tmp_path / f"{i}.csv", f"CASE_NUMBER,x\n{i},a\n" if i % 2 else f"x,CASE_NUMBER\nb,{i}\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layouts", "")
    found = raw.layouts(spark, str(tmp_path))
    jobs = tracker.getJobIdsForGroup("layouts")
    spark.sparkContext.setJobGroup("", "")
    assert len(found) == 2 and sum(len(x.files) for x in found) == 150
    assert len(jobs) <= 4  # listing, lines, grouping: the same for any number of files
    assert raw.csv_scan(spark, str(tmp_path)).where("x IN ('a', 'b')").count() == 150


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


EXPORTS = [
    [("a", 1, 1, 2024, 1), ("a", 1, 2, 2024, 1), ("b", 1, 3, 2024, 2), ("c", 1, 4, 2024, 3), ("d", 1, 5, None, None), ("e", 1, 6, 2025, 1)],
    [("c", 2, 7, 2024, 4), ("d", 2, 8, 2025, 2), ("f", 2, 9, 2024, 2), ("f", 2, 10, 2024, 2)],  # moves c and d to other periods
    [("b", 0, 11, 2026, 1), ("g", 0, 12, 2024, 2)],                                            # older: b's row stays out
    [],
]


def test_refresh_equals_a_full_consolidation(spark, tmp_path):
    path = str(tmp_path / "master")
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in EXPORTS]
    write_master(latest_source_wins(frames[0]), path)
    touched = []
    for i, new in enumerate(frames[1:], 1):
        before = files_of(path)
        touched.append(refresh_master(spark, new, path))
        kept = {f for f, t in files_of(path).items() if before.get(f) == t}
        untouched = {f for f in before if not any(f"FISCAL_YEAR={y if y else '__HIVE_DEFAULT_PARTITION__'}/FISCAL_QUARTER="
                                                  f"{q if q else '__HIVE_DEFAULT_PARTITION__'}/" in f for y, q in touched[-1])}
        assert kept == untouched
        whole = spark.createDataFrame([r for rows in EXPORTS[:i + 1] for r in rows], SCHEMA)
        want = {tuple(r) for r in latest_source_wins(whole).collect()}
        assert {tuple(r) for r in spark.read.parquet(path).select(*whole.columns).collect()} == want
        assert spark.read.parquet(path).count() == len(want)
    assert touched == [[(2024, 2), (2024, 3), (2024, 4), (2025, 2), (None, None)], [(2024, 2)], []]
    state = sorted(map(str, spark.read.parquet(path).collect()))
    refresh_master(spark, frames[1], path)  # delivered again
    assert sorted(map(str, spark.read.parquet(path).collect())) == state


def test_refresh_takes_new_columns(spark, tmp_path):
    path = str(tmp_path / "master")
    write_master(spark.createDataFrame([("a", 1, 1, 2024, 1), ("b", 1, 2, 2024, 2)], SCHEMA), path)
    refresh_master(spark, spark.createDataFrame([("a", 2, "n", 2024, 1)], "CASE_NUMBER string, SOURCE_ORD int, w string, FISCAL_YEAR int, FISCAL_QUARTER int"), path)
    got = spark.read.option("mergeSchema", True).parquet(path).select("CASE_NUMBER", "v", "w").collect()
    assert {tuple(r) for r in got} == {("a", None, "n"), ("b", 2, None)}


RAW = "CASE_NUMBER string, RECEIVED_DATE string, DECISION_DATE string, v string, SOURCE_FILE string, SOURCE_ORD int"


def test_stage_equals_consolidation_without_exchange(spark):
    from filingscope.operators.ingest import consolidate, ingest_report, prepare_raw
    from filingscope.sources import staging

    first = [(f"c{i % 40}", "2024-01-02", None if i % 9 else "2024-11-03", str(i), "one", 1) for i in range(120)]
    second = [(f"c{i % 60}", None, "2025-02-03" if i % 3 else None, str(i), "two", 2) for i in range(30, 90)]
    blanks = [(None if i % 2 else "", None, None, None, "one", 1) for i in range(200)]
    frames = [spark.createDataFrame(first + blanks, RAW), spark.createDataFrame(second, RAW)]
    stage = staging.stage_exports(spark, frames, numeric_cols=("v",), buckets=4)
    try:
        got = staging.consolidate_stage(spark, stage)
        want = consolidate(frames, numeric_cols=("v",))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan and "PartitionFilters" in plan
        report = staging.stage_report(spark, stage)
        wanted = ingest_report(prepare_raw(frames, numeric_cols=("v",)))
        assert sorted(map(tuple, report.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
        assert "v#" not in report._jdf.queryExecution().executedPlan().toString()  # unneeded columns stay unread
    finally:
        staging.drop_stage(spark, stage)
    assert not spark.catalog.tableExists(stage.table)


def test_an_export_of_one_source_is_not_joined_with_itself(spark, tmp_path):
    from filingscope.sources.master import fresh_rows, known_rows, newest_of, newest_rows

    path = str(tmp_path / "master")
    one, two = (spark.createDataFrame(rows, SCHEMA) for rows in EXPORTS[:2])
    mixed = one.unionByName(two)
    for frame in (one, one.withColumn("SOURCE_ORD", F.lit(None).cast("int")), mixed, one.where("false")):
        got = newest_rows(frame)
        assert sorted(map(str, got.collect())) == sorted(map(str, latest_source_wins(frame).collect()))
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    write_master(one, path)
    new = newest_rows(two)
    known = known_rows(spark.read.parquet(path), newest_of(new))
    assert "Join" not in fresh_rows(new, known)._jdf.queryExecution().optimizedPlan().toString()
