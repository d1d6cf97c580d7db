"""Stored distributions against plain numpy, on both paths, and merged from batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingscope.operators import distribution as dist
from filingscope.operators import stats

SCHEMA = "k string, x double, ok boolean"
PROBS = {"p25": 0.25, "p50": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [(rnd.choice("abc"), rnd.choice([None, math.nan, round(rnd.uniform(-500, 90_000), rnd.choice([0, 2]))]), rnd.choice([True, False, None]))
           for _ in range(900)]
    return out + [("hot", float(rnd.randint(1, 40)), True) for _ in range(2000)] + [("one", 5.0, None), ("none", None, True), (None, 3.0, True)]


def values(rows, key):
    return [x for k, x, _ in rows if (key is None or k == key) and x is not None and not math.isnan(x)]


@pytest.mark.parametrize("small", [dist.SMALL, 30, 0])
def test_totals_and_quantiles(spark, rows, monkeypatch, small):
    monkeypatch.setattr(dist, "SMALL", small)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    d = dist.distribution(df, ["k"], "x", {"ok": F.col("ok")})
    got = {r.k: r for r in d.summary(PROBS).collect()}
    assert set(got) == {"a", "b", "c", "hot", "one", "none"}
    for k, r in got.items():
        v = values(rows, k)
        assert r._n == sum(x[0] == k for x in rows) and r.ok == sum(x[0] == k and x[2] is True for x in rows)
        for name, p in PROBS.items():
            assert r[name] is None if not v else math.isclose(r[name], np.quantile(v, p), rel_tol=1e-12)
    whole = dist.distribution(df, [], "x").summary({"m": 0.5}).first()
    assert whole._n == len(rows) and math.isclose(whole.m, np.median(values(rows, None)))


def test_merged_batches_equal_one_pass(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    half = F.crc32(F.col("x").cast("string").cast("binary")) % 2 == 0
    parts = [dist.distribution(df.where(c), ["k"], "x", {"ok": F.col("ok")}) for c in (F.coalesce(half, F.lit(False)), ~F.coalesce(half, F.lit(False)))]
    both, once = parts[0].merge(parts[1]), dist.distribution(df, ["k"], "x", {"ok": F.col("ok")})
    assert sorted(map(str, both.cells.collect())) == sorted(map(str, once.cells.collect())) and both.size == once.size
    with pytest.raises(ValueError):
        both.merge(dist.distribution(df, ["k"], "x"))


def test_describe_histogram_and_box(spark, rows):
    d = dist.distribution(spark.createDataFrame(rows, SCHEMA), ["k"], "x")
    for r in d.describe().collect():
        v = values(rows, r.k)
        assert (r["count"], r.min, r.max) == (len(v), min(v), max(v)) and math.isclose(r.mean, np.mean(v), abs_tol=1e-4)
        assert r.std is None if len(v) == 1 else math.isclose(r.std, np.std(v, ddof=1), abs_tol=1e-4)
    bins = d.histogram(10, lo=0).orderBy("bin").collect()
    assert [b.filings for b in bins] == np.histogram([x for x in values([r for r in rows if r[0]], None) if x > 0], 10)[0].tolist()
    box = {r.k: r for r in d.box().collect()}
    v = np.array(values(rows, "a"))
    q1, q3 = np.quantile(v, [0.25, 0.75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert box["a"].outliers == len(v) - len(inside) and box["a"].whisker_high == inside.max()


def test_without_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dist.distribution(df, ["k"], "x").summary(PROBS).count() == 0
    one = dist.distribution(df, [], "x").summary(PROBS).first()
    assert one._n == 0 and one.p50 is None
    assert dist.distribution(df, [], "x").histogram(5).count() == 0
    assert dist.distribution(df, [], "x").describe().first()["count"] == 0


def test_missingness_is_rounded_and_sorted(spark):
    df = spark.createDataFrame([(None if i < 2 else 1, None if i < 5 else 1, 1, None) for i in range(7)], "a int, b int, c int, d int")
    assert [(r.column_name, r.pct_missing) for r in stats.missingness(df).collect()] == [("d", 100.0), ("b", 71.4), ("a", 28.6)]


def test_plans_known_to_be_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for none in (df.where(F.lit(False)), spark.range(0).select(F.lit("k").alias("k"), F.lit(1.0).alias("x")), df.limit(0)):
        assert dist.distribution(none, ["k"], "x").summary(PROBS).count() == 0
        assert dist.distribution(none, [], "x").summary(PROBS).first()._n == 0
