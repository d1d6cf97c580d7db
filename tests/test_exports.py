"""The exports: one scan a dataset, all 18 files, awkward names through the files."""

from pyspark.sql import functions as F

from filingscope.operators import exports
from filingscope.plans.enrich import Datasets
from filingscope.session import delete_path
from filingscope.sources.sinks import read_export, write_exports
from tests.conftest import SF_SMALL


def test_exports_read_each_dataset_once(spark, tmp_path, monkeypatch):
    ds = Datasets(spark, SF_SMALL)
    ds.lca.write.parquet(f"{tmp_path}/lca")
    ds.perm.write.parquet(f"{tmp_path}/perm")
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    store = exports.stored
    monkeypatch.setattr(exports, "stored", spy)
    tables = exports.export_tables(spark.read.parquet(f"{tmp_path}/lca"), spark.read.parquet(f"{tmp_path}/perm"))
    assert len(tables) == 18 and len(plans) == 2
    assert all(p.count("FileScan parquet") == 1 and p.count("Expand") == 1 for p in plans)
    assert not any("FileScan parquet" in t._jdf.queryExecution().optimizedPlan().toString() for t in tables.values())
    write_exports(tables, f"{tmp_path}/out")
    assert all(read_export(spark, f"{tmp_path}/out", n, t.schema).count() == t.count() for n, t in tables.items())
    delete_path(spark, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_awkward_names_come_back(spark, tmp_path):
    rows = [('Smith, "Jo" & Co', 1), (" lead", 2), ("two\nlines", 3), ("trail ", None), ("é\\", 5)]
    df = spark.createDataFrame(rows, "name string, n long")
    write_exports({"odd": df}, str(tmp_path))
    assert {tuple(r) for r in read_export(spark, str(tmp_path), "odd", df.schema).collect()} == set(rows)


def test_grouping_sets_keep_null_keys_apart(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 3), (None, None, 4)], "k string, j string, n int")
    cells = exports.grouping_cells(df, {"k": F.col("k"), "j": F.col("j")}, {"one": ["k"], "two": ["j", "k"]}, {"big": F.col("n") > 2})
    assert {tuple(r) for r in cells["one"].collect()} == {("a", 2, 0), (None, 2, 2)}
    assert {tuple(r) for r in cells["two"].collect()} == {(None, "a", 1, 0), ("x", "a", 1, 0), ("x", None, 1, 1), (None, None, 1, 1)}
