"""Edge rows for the column functions and small operators (hand-made inputs)."""

import datetime as dt
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from filingscope.functions import (
    annual_wage,
    bounded,
    clean_name,
    core_key,
    fiscal_quarter,
    fiscal_year,
    keyword_match,
    mba_tier,
    naics_sector,
    parse_date,
    unwrap_text,
)
from filingscope.functions.flags import url_quote_plus
from filingscope.operators import entities, ingest, stats


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_name_commas_and_periods(spark):
    assert one_col(spark, ["SEMICONDUCTOR,LLC", "L.L.C.", "  a  (b)  'c' "], clean_name) == \
        ["SEMICONDUCTOR LLC", "LLC", "A B C"]


def test_core_key_edges(spark):
    vals = ["Boston Consulting Group, Inc.", "THE BOSTON CONSULTING GROUP, INC.", "INC", "THE", "THE COMPANY",
            None, "FOO CO LTD LLC", "THE INC", "CO LLC"]
    assert one_col(spark, vals, core_key) == [
        "BOSTON CONSULTING GROUP", "BOSTON CONSULTING GROUP", "INC", "THE", "COMPANY", None, "FOO", "INC", "CO"]


def test_canonical_map_prefers_frequent_then_not_all_caps(spark):
    lca = spark.createDataFrame([("Hire IT people, Inc",), ("HIRE IT PEOPLE INC",), ("Hire IT People, Inc.",),
                                 ("Hire IT People, Inc.",)], "EMPLOYER_NAME string")
    perm = spark.createDataFrame([("HIRE IT PEOPLE INC",), ("Hire IT people, Inc",)], "EMP_BUSINESS_NAME string")
    m = {r.raw_name: r.canonical_name for r in
         entities.canonical_map((lca, "EMPLOYER_NAME"), (perm, "EMP_BUSINESS_NAME")).collect()}
    # 'Hire IT people, Inc' x2, 'HIRE IT PEOPLE INC' x2, 'Hire IT People, Inc.' x2: the caps variant loses
    assert set(m.values()) == {"Hire IT People, Inc."}
    assert len(m) == 3


def test_canonical_map_tie_prefers_not_all_caps(spark):
    df = spark.createDataFrame([("ACME INC",), ("Acme Inc",)], "n string")
    m = {r.raw_name: r.canonical_name for r in entities.canonical_map((df, "n")).collect()}
    assert m == {"ACME INC": "Acme Inc", "Acme Inc": "Acme Inc"}


def test_brand_rollup_and_exclusions(spark):
    names = ["Amazon Web Services, Inc.", "Apple American Group LLC", "The Citadel", "DELL LANDSCAPING, INC.",
             "First National Bank of America", "Citadel Americas Services LLC", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = {r.name: r.label for r in entities.brand_rollup(df, "name", "label").collect()}
    assert out["Amazon Web Services, Inc."] == "Amazon"
    assert out["Citadel Americas Services LLC"] == "Citadel"
    for n in names[1:5]:
        assert out[n] == n
    assert out[None] is None


def test_brand_core_keys_do_not_collide_across_brands(spark):
    df = spark.createDataFrame(entities.brand_variants(), "brand string, variant string")
    clashes = (df.select(core_key("variant").alias("core"), "brand").distinct()
               .groupBy("core").count().where("count > 1").collect())
    assert clashes == []
    assert df.count() == 108 and df.select("brand").distinct().count() == 21


def test_match_datasets_citadel_merge_and_brand_or_core(spark):
    lca = spark.createDataFrame([("Citadel",), ("Citadel",)], "EMPLOYER_CANONICAL string")
    perm = spark.createDataFrame([("The Citadel",)], "EMPLOYER_CANONICAL string")
    merged = entities.match_datasets(lca, perm).collect()
    assert len(merged) == 1 and merged[0].sponsors_both
    apart = entities.match_datasets(lca, perm, key_on="brand_or_core").collect()
    assert len(apart) == 2 and not any(r.sponsors_both for r in apart)


def test_match_datasets_symmetric(spark):
    a = spark.createDataFrame([("X Inc",), ("Y LLC",), ("Y LLC",)], "EMPLOYER_CANONICAL string")
    b = spark.createDataFrame([("X INC",), ("Z",)], "EMPLOYER_CANONICAL string")
    ab = {r.employer_core_key: (r.lca_filings, r.perm_filings) for r in entities.match_datasets(a, b).collect()}
    ba = {r.employer_core_key: (r.perm_filings, r.lca_filings) for r in entities.match_datasets(b, a).collect()}
    assert ab == ba == {"X": (1, 1), "Y": (2, 0), "Z": (0, 1)}


def test_mba_tier_edges(spark):
    rows = [("13-1111.00", "Data Scientists"), ("15-1111.00", "Business Intelligence Analysts"),
            ("15-0000.00", "Senior Project Management Specialists"), (None, None),
            ("15-0000.00", "Project Management Specialists"), ("41-0000.00", "Sales Engineers")]
    df = spark.createDataFrame(rows, "c string, t string")
    got = [r[0] for r in df.select(mba_tier("c", "t")).collect()]
    assert got == ["core", "adjacent", "excluded", "excluded", "adjacent", "adjacent"]


def test_naics_sector_edges(spark):
    assert one_col(spark, [" 334413", "99", None, "522110"], naics_sector) == [
        "Manufacturing", "Unknown / Unclassified", "Unknown / Unclassified", "Finance and Insurance"]


def test_annual_wage_and_bounds(spark):
    df = spark.createDataFrame([(10.0, "Hour"), (20000.0, "Year"), (5.0, "Fortnight"), (100000.0, "Bi-Weekly")],
                               "a double, u string")
    got = [tuple(r) for r in df.select(annual_wage("a", "u").alias("w")).select("w", bounded("w")).collect()]
    assert got == [(20800.0, 20800.0), (20000.0, None), (None, None), (2600000.0, None)]


def test_unwrap_text(spark):
    assert one_col(spark, ['="541511"', 'a="b"', None, '=""'], unwrap_text) == ["541511", 'a="b"', None, ""]


def test_parse_date_formats(spark):
    vals = ["1/2/25", "01/02/2025", "2025-01-02", "02/30/25", "zz", "1/1/70", "12/31/68", None]
    got = one_col(spark, vals, parse_date)
    d = dt.date
    assert got == [d(2025, 1, 2), d(2025, 1, 2), d(2025, 1, 2), None, None, d(1970, 1, 1), d(2068, 12, 31), None]


def test_fiscal_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 10, 1), None), (dt.date(2025, 9, 30), None),
                                (None, dt.date(2025, 1, 15)), (None, None)], "dec date, rec date")
    got = [tuple(r) for r in ingest.add_fiscal_calendar(df, "dec", "rec").select("FISCAL_YEAR", "FISCAL_QUARTER").collect()]
    assert got == [(2025, 1), (2025, 4), (2025, 2), (None, None)]


def test_latest_source_wins_keeps_all_rows_of_newest_source(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("A", 3, "z"), ("A", 3, "w"), ("B", 2, "v")],
                               "CASE_NUMBER string, SOURCE_ORD int, v string")
    got = sorted(tuple(r) for r in ingest.latest_source_wins(df).collect())
    assert got == [("A", 3, "w"), ("A", 3, "z"), ("B", 2, "v")]


def test_keyword_match_regex_and_empty(spark):
    df = spark.createDataFrame([("Credit   Risk Analyst",), ("Chef",), (None,)], "t string")
    assert [r[0] for r in df.select(keyword_match(["credit risk"], ["t"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(keyword_match([], ["t"])).collect()] == [True, True, True]
    assert [r[0] for r in df.select(keyword_match(["x"], ["missing"], available={"t"})).collect()] == [False] * 3


def test_monthly_series_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 5),), (dt.date(2025, 3, 9),), (None,)], "RECEIVED_DATE date")
    got = [tuple(r) for r in stats.monthly_series(df).orderBy("month_end").collect()]
    assert got == [(dt.date(2025, 1, 31), 1), (dt.date(2025, 2, 28), 0), (dt.date(2025, 3, 31), 1)]


def test_yoy_by_tier_skips_zero_base(spark):
    rows = [("core", 2025, 1), ("core", 2026, 1), ("adjacent", 2026, 2), ("core", 2026, 4)]
    df = spark.createDataFrame(rows, "MBA_TIER string, FISCAL_YEAR int, FISCAL_QUARTER int")
    got = [tuple(r) for r in stats.yoy_by_tier(df, 2025, 2026).collect()]
    assert got == [("core", 1, 1, 0.0)]


def test_url_quote_plus_matches_form_encoding(spark):
    vals = ["Firm 12, Inc. MBA careers", "A~B*C+D&E/é", "Bank of America N.A. Marketing Managers, Sales careers"]
    assert one_col(spark, vals, url_quote_plus) == [quote_plus(v) for v in vals]


def test_dense_index_is_consecutive_across_partitions(spark):
    from filingscope.operators.cube import dense_index
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = dense_index(df, [F.desc("k")], "idx").select("k", "idx").collect()
    assert sorted((r.idx, r.k) for r in got) == [(i, 999 - i) for i in range(1000)]


def test_csv_scan_bom_multiline_quotes_and_consolidation(spark, tmp_path):
    from filingscope.sources import raw as raw_io

    old = tmp_path / "old"
    new = tmp_path / "new"
    old.mkdir()
    new.mkdir()
    # old vintage: BOM, old header spelling, ="..." wrapped code, M/d/yy dates, a blank template row
    (old / "part.csv").write_text(
        "﻿CASE_NUMBER,H-1B_DEPENDENT,NAICS_CODE,RECEIVED_DATE,DECISION_DATE,EMPLOYER_NAME\n"
        'A-1,Y,"=""541511""",1/2/25,1/9/25,"Acme, ""The"" Co"\n'
        'A-2,N/A,"=""31""",2/3/25,,"Multi\nLine LLC"\n'
        ",,,,,\n",
        encoding="utf-8")
    # new vintage: current header, ISO dates, A-1 again (this source wins it)
    (new / "part.csv").write_text(
        "CASE_NUMBER,H_1B_DEPENDENT,NAICS_CODE,RECEIVED_DATE,DECISION_DATE,EMPLOYER_NAME\n"
        "A-1,N,541511,2025-01-02,2025-10-01,Acme Co\n",
        encoding="utf-8")
    sources = [raw_io.Source("old", str(old), 1), raw_io.Source("new", str(new), 2)]
    out = {r.CASE_NUMBER: r for r in raw_io.consolidate_sources(spark, sources).collect()}
    assert set(out) == {"A-1", "A-2"}
    a1, a2 = out["A-1"], out["A-2"]
    assert (a1.SOURCE_FILE, a1.H_1B_DEPENDENT, a1.FISCAL_YEAR, a1.FISCAL_QUARTER) == ("new", "N", 2026, 1)
    assert a2.SOURCE_FILE == "old" and a2.NAICS_CODE == "31" and a2.H_1B_DEPENDENT is None
    assert a2.EMPLOYER_NAME == "Multi\nLine LLC"
    assert a2.RECEIVED_DATE == dt.date(2025, 2, 3) and a2.DECISION_DATE is None
    assert (a2.FISCAL_YEAR, a2.FISCAL_QUARTER) == (2025, 2)
    report = {r.SOURCE_FILE: r for r in ingest.ingest_report(ingest.prepare_raw(raw_io.read_sources(spark, sources)))
              .collect()}
    assert (report["old"].rows_read, report["old"].blank_rows, report["old"].stale_duplicates,
            report["old"].rows_written) == (3, 1, 1, 1)
    assert report["new"].rows_written == 1


def test_facet_values_single_scan(spark):
    from filingscope.operators.search import facet_values
    from filingscope.spec import LCA
    df = spark.createDataFrame([("S1", "Sec", "I"), (None, "Sec", "II"), ("S2", None, "I")],
                               "WORKSITE_STATE string, NAICS_SECTOR string, WAGE_LEVEL string")
    got = [tuple(r) for r in facet_values(df, LCA).collect()]
    assert got == [("sector", "Sec"), ("state", "S1"), ("state", "S2"), ("wage_level", "I"), ("wage_level", "II")]


def test_unwrap_text_does_not_cross_lines(spark):
    # '.' stops at line breaks, as in the source's wrapper pattern
    assert one_col(spark, ['="a\nb"', '="x"'], unwrap_text) == ['="a\nb"', "x"]


def test_dense_index_does_not_need_exchange_reuse(spark):
    from filingscope.operators.cube import dense_index
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 400_000, numPartitions=7).select((F.col("id") * 7919 % 400_009).alias("k"))
        r = dense_index(df, [F.desc("k")], "idx").agg(
            F.count_distinct("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r.n, r.lo, r.hi) == (400_000, 0, 399_999)


def test_csv_files_of_one_folder_are_bound_by_header(spark, tmp_path):
    from filingscope.sources.raw import csv_scan
    (tmp_path / "a.csv").write_text("CASE_NUMBER,DECISION_DATE,SOC_CODE\nC1,1/2/2025,11-1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffCASE_NUMBER,SOC_CODE,DECISION_DATE\nC2,15-2,2/2/2025\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("SOC_CODE,CASE_NUMBER\n\"1\n2\",C3\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    got = {r.CASE_NUMBER: (r.DECISION_DATE, r.SOC_CODE) for r in csv_scan(spark, str(tmp_path)).collect()}
    assert got == {"C1": ("1/2/2025", "11-1"), "C2": ("2/2/2025", "15-2"), "C3": (None, "1\n2")}


def test_a_file_of_an_unlisted_source_fails_the_stream(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from filingscope.streaming.incremental import start_ingest
    (tmp_path / "landing" / "src_9").mkdir(parents=True)
    (tmp_path / "landing" / "src_9" / "x.csv").write_text("CASE_NUMBER,RECEIVED_DATE,DECISION_DATE\nC1,1/2/2025,1/3/2025\n")
    q = start_ingest(spark, str(tmp_path / "landing"), {"src_1": 1}, str(tmp_path / "table"), str(tmp_path / "ckpt"))
    with pytest.raises(StreamingQueryException, match="src_9"):
        q.awaitTermination()


def test_rows_without_a_source_order_are_kept(spark):
    df = spark.createDataFrame([("A", None), ("B", 1), ("B", 2)], "CASE_NUMBER string, SOURCE_ORD int")
    assert sorted(r.CASE_NUMBER for r in ingest.latest_source_wins(df).collect()) == ["A", "B"]


def test_persona_names_may_hold_quotes(spark):
    from filingscope.operators import search
    df = spark.createDataFrame([("nurse",), ("clerk",)], "JOB_TITLE string")
    personas = {"women's health": ("nurse",), 'the "clerk"': ("clerk",)}
    assert {r.persona for r in search.persona_matches(df, ["JOB_TITLE"], personas).collect()} == set(personas)
    assert {r.persona: r.matched_filings for r in search.persona_catalog(df, ["JOB_TITLE"], personas).collect()} == {
        "women's health": 1, 'the "clerk"': 1}


def test_quantiles_equal_the_exact_aggregate(spark):
    """A hot group, ties, negatives, tiny and huge values, single values and groups without values."""
    from filingscope.operators.quantiles import quantiles
    hot = spark.range(0, 60_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 50_021 / 3).alias("v"))
    odd = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", -5.0), ("b", -5.0), ("b", 1e-9), ("b", 1e15), ("c", 7.0),
         ("d", None), ("e", 0.0), ("e", -0.25)], "g string, v double")
    df = hot.unionByName(odd)
    want = {r.g: (r.a, r.b, r.c) for r in df.where("v is not null").groupBy("g").agg(
        F.percentile("v", 0.25).alias("a"), F.median("v").alias("b"), F.percentile("v", 0.75).alias("c")).collect()}
    got = quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75})
    assert {r.g: (r.a, r.b, r.c) for r in got.collect()} == want
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString().lower() for x in ("median", "percentile"))


def test_keyword_pattern_words_groups_and_blanks(spark):
    from filingscope.functions.text import keyword_pattern
    df = spark.createDataFrame([("Credit \t Risk lead",), ("data analyst",), ("big data",), (None,), ("ab",)], "t string")
    hits = lambda *k: [r[0] for r in df.select(keyword_match(list(k), ["t"])).collect()]
    assert hits("credit\u2003 risk", "") == [True, False, False, False, False]      # any white space; no blank keyword
    assert hits(" credit risk ") == [True, False, False, False, False]              # none around it
    assert hits("big|small data") == [False, False, True, False, False]             # words of one keyword: (big|small) data is spelled out
    assert hits("(?:big|data) analyst") == [False, True, False, False, False]
    assert hits("", "  ") == [True] * 5 and keyword_pattern([]) == ""
    assert hits("a$|b", "x") == [False, False, True, False, True]


def test_personas_as_a_table(spark):
    """Many personas, null titles, a title in several of them; patterns never meet the filings themselves."""
    from filingscope.operators import search
    df = spark.createDataFrame([("Data Analyst", None, 1), ("Data Analyst", None, 2), (None, "brand lead", 3), (None, None, 4)],
                               "SOC_TITLE string, JOB_TITLE string, n int")
    personas = {f"none{i}": (f"no such title {i}",) for i in range(300)} | {"data": ("data",), "analyst": ("analyst", "brand"), "all": ("",)}
    got = search.persona_matches(df, ["SOC_TITLE", "JOB_TITLE", "OTHER"], personas)
    assert sorted((r.persona, r.n) for r in got.collect()) == [
        ("all", 1), ("all", 2), ("all", 3), ("all", 4), ("analyst", 1), ("analyst", 2), ("analyst", 3), ("data", 1), ("data", 2)]
    catalog = {r.persona: (r.matched_filings, r.share_of_total) for r in search.persona_catalog(df, ["SOC_TITLE", "JOB_TITLE"], personas).collect()}
    assert len(catalog) == 303 and catalog["data"] == (2, 0.5) and catalog["none7"] == (0, 0.0) and catalog["all"] == (4, 1.0)
    with pytest.raises(ValueError):
        search.persona_matches(df, ["SOC_TITLE"], spark.range(search.MAX_PERSONAS + 1).select(
            F.col("id").cast("string").alias("persona"), F.lit("x").alias("pattern")))


def test_title_index_equals_the_scan(spark, tmp_path):
    from filingscope.operators import search
    from filingscope.spec import LCA
    rows = [("Data Analyst", "Senior DATA wrangler"), ("Data Analyst", None), (None, "data"), ("ab", "x"), ("Économiste", "Café 50% \\ lead"),
            ("banana", "ananas"), ("Data Analyst", "Senior DATA wrangler"), ("", "")]
    df = spark.createDataFrame(rows, "SOC_TITLE string, JOB_TITLE string")
    search.write_title_index(df, LCA, str(tmp_path))
    for text in ("data", "DATA ANALYST", "ana", "anan", "a", "", "é", "éco", "50% \\", "zzz", "ab", "wrangler", "data wrangler senior"):
        want = [tuple(r) for r in search.title_suggest(df, LCA, text, None).collect()]
        got = search.indexed_suggest(spark, str(tmp_path), LCA, text, None)
        assert [tuple(r) for r in got.collect()] == want, text
    assert len(search.indexed_suggest(spark, str(tmp_path), LCA, "a", 1).collect()) == 1
    assert "PushedFilters: [In(gram" in search.indexed_suggest(spark, str(tmp_path), LCA, "data")._jdf.queryExecution().executedPlan().toString()
