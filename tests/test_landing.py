"""Rows that several passes read are joined, parsed and resolved once."""

import pytest
from pyspark.sql import functions as F

from filingscope.functions.dates import parse_date
from filingscope.functions.text import unwrap_text
from filingscope.operators.ingest import consolidate
from filingscope.sources import testbind
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exports_join_the_tables_once(spark):
    frames = [df.withColumns({"SOURCE_FILE": F.lit(n), "SOURCE_ORD": F.lit(o)}) for n, o, df in testbind.render_raw_sources(spark, SF_SMALL)]
    text = plan(consolidate(frames, numeric_cols=testbind.LCA_NUMERIC_TEXT))
    joins = [line for line in text.splitlines() if "Join " in line]
    assert joins and all("LeftSemi" in line for line in joins)  # latest source wins; the tables' own joins are done
    want = testbind.lca_joined(spark, SF_SMALL)
    got = testbind.lca_raw(spark, SF_SMALL)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_text_is_parsed_by_one_format(spark):
    cells = {"1/2/69": "1969-01-02", "01/02/68": "2068-01-02", "2/29/72": "1972-02-29", "2/29/00": "2000-02-29", " 1/2/1998 ": "1998-01-02",
             "2024-02-29": "2024-02-29", "2/29/73": None, "1/2/ab": None, "1/2/+5": None, "/12": None, "5/": None, "1998/01/02": None,
             "1/2/3/98": None, "1/2/98x": None, "2024-1-2": None, "": None}
    df = spark.createDataFrame([(k, v) for k, v in cells.items()], "s string, want string")
    assert [r for r in df.select("s", "want", parse_date("s").cast("string").alias("got")).collect() if r.got != r.want] == []
    assert plan(df.select(parse_date("s"))).lower().count("gettimestamp(") == 2  # one for each separator


def test_only_wrapped_cells_meet_the_pattern(spark):
    cells = {'="a"': "a", '=""': "", '="': '="', 'x="a"': 'x="a"', '="a"b': '="a"b', '="a""b"': 'a""b', "": "", "a": "a"}
    df = spark.createDataFrame(list(cells.items()), "s string, want string")
    assert [r for r in df.select("s", "want", unwrap_text("s").alias("got")).collect() if r.got != r.want] == []
    assert "CASE WHEN" in plan(df.select(unwrap_text("s")))


def test_enriched_rows_come_from_a_stored_master_and_map(spark):
    from filingscope.plans.enrich import Datasets
    from filingscope.spec import LCA

    ds = Datasets(spark, SF_SMALL)
    joins = [line for line in plan(ds.lca_mba()).splitlines() if "Join " in line]
    assert len(joins) == 1 and "LeftOuter" in joins[0]  # the names; before, all tables were joined for every pass
    assert "Join" not in plan(ds.unnamed_mba(LCA)) and ds.unnamed_mba(LCA).count() == ds.lca_mba().count()


def test_batches_by_source_come_from_stored_rows(spark):
    from filingscope.plans.catalog_entities import _by_source
    from filingscope.plans.enrich import Datasets

    batches = _by_source(Datasets(spark, SF_SMALL))
    assert len(batches) == 3 and all("Join" not in plan(b) for b in batches)
