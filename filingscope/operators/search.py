"""Occupation search, facets and persona reports (Q1-Q9).

Persona reports run every persona in one pass.  Personas are a table of patterns; patterns are looked for in the
distinct titles only, and the filings meet the dictionary of titles that match (rows that match nothing are dropped).
Every report is then an ordinary ``groupBy(persona, ...)``.  Top-k per persona is a ``row_number`` over the
*aggregated* counts, never over filing rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingscope.functions.text import keyword_match, keyword_pattern, literal_contains
from filingscope.operators.distribution import distribution, stored
from filingscope.spec import FilingsSpec

# Example persona -> keyword lists.
PERSONA_KEYWORDS: dict[str, tuple[str, ...]] = {
    "finance_risk_fintech": (
        "credit risk", "risk management", "risk analyst", "financial risk",
        "financial analyst", "financial and investment analyst", "data scientist",
        "business intelligence", "quantitative analyst", "management analyst",
    ),
    "marketing_brand": (
        "marketing manager", "market research", "brand", "marketing specialist",
        "public relations", "product marketing",
    ),
    "supply_chain_ops": (
        "supply chain", "logistician", "logistics analyst", "operations manager",
        "operations research analyst", "purchasing manager", "industrial production manager",
    ),
    "product_tech_adjacent": (
        "product manager", "technical program manager", "information technology project manager",
        "business intelligence analyst", "project management specialist",
    ),
}


@dataclass(frozen=True)
class Facets:
    tiers: tuple[str, ...] = ("core", "adjacent")
    hire_only: bool = False
    titles: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    wage_levels: tuple[str, ...] = field(default=())


def facet_condition(columns, spec: FilingsSpec, facets: Facets) -> Column:
    """Conjunction of facets over rows with these ``columns``; an empty facet does not restrict (tiers always apply)."""
    out = F.col("MBA_TIER").isin(*facets.tiers)
    if facets.hire_only:
        out = out & F.col(spec.hire_flag_col)
    if facets.titles:
        out = out & F.col(spec.occupation_col).isin(*facets.titles)
    if facets.states:
        out = out & F.col(spec.state_col).isin(*facets.states)
    if facets.sectors:
        out = out & F.col("NAICS_SECTOR").isin(*facets.sectors)
    if facets.wage_levels and "WAGE_LEVEL" in columns:
        out = out & F.col("WAGE_LEVEL").isin(*facets.wage_levels)
    return out


def faceted_filter(df: DataFrame, spec: FilingsSpec, facets: Facets) -> DataFrame:
    return df.where(facet_condition(df.columns, spec, facets))


def keyword_search(df: DataFrame, keywords, title_cols) -> DataFrame:
    return df.where(keyword_match(keywords, title_cols, available=set(df.columns)))


def search_summary(df: DataFrame, keywords, title_cols, tier_col: str = "MBA_TIER") -> DataFrame:
    """One row per tier of the matches: tier count, total matched, share of all rows.

    Without any match: one row with no tier, 0 matched and share 0.
    """
    hit = keyword_match(keywords, title_cols, available=set(df.columns))
    tagged = df.select(hit.alias("_hit"), F.col(tier_col).alias("tier"))
    per = tagged.groupBy("tier").agg(
        F.count_if("_hit").alias("tier_filings"), F.count(F.lit(1)).alias("_rows"))
    shown = F.when((F.col("tier_filings") > 0) & F.col("tier").isNotNull(), F.struct("tier", "tier_filings"))
    one = per.agg(F.coalesce(F.sum("tier_filings"), F.lit(0)).alias("matched_filings"), F.sum("_rows").alias("_all"),
                  F.collect_list(shown).alias("_tiers"))  # one entry per tier
    share = F.try_divide(F.col("matched_filings").cast("double"), F.col("_all").cast("double"))
    return one.select("matched_filings", F.coalesce(share, F.lit(0.0)).alias("share_of_total"),
                      F.explode_outer("_tiers").alias("_t")).select(
        F.col("_t.tier").alias("tier"), F.coalesce("_t.tier_filings", F.lit(0)).cast("long").alias("tier_filings"),
        "matched_filings", "share_of_total")


def title_suggest(df: DataFrame, spec: FilingsSpec, text: str, k: int | None = 25) -> DataFrame:
    occ = spec.occupation_col
    hit = literal_contains(F.col(occ), text) | literal_contains(F.col("JOB_TITLE"), text)
    return _suggested(df.where(hit & F.col(occ).isNotNull()).groupBy(occ).agg(F.count(F.lit(1)).alias("filings")), occ, k)


def _suggested(counts: DataFrame, occ: str, k: int | None) -> DataFrame:
    out = counts.orderBy(F.desc("filings"), F.asc(occ))
    return out if k is None else out.limit(k)


#: Code points of an index term.
GRAM = 3


def write_title_index(df: DataFrame, spec: FilingsSpec, path: str) -> None:
    """Index the titles of ``df`` for ``indexed_suggest``: distinct titles with their filings, and sorted postings of their grams.

    The filings are read once and counted by title; everything after that works on distinct titles. Postings are range
    partitioned and sorted by gram, so a lookup skips all row groups but those of its grams.
    """
    occ, spark = spec.occupation_col, df.sparkSession
    counts = df.where(F.col(occ).isNotNull()).groupBy(F.col(occ).alias("occ"), F.col("JOB_TITLE").alias("job")).agg(F.count(F.lit(1)).alias("filings"))
    counts.withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/titles")
    titles = spark.read.parquet(f"{path}/titles")  # numbered once, in the written copy

    def grams(name: str) -> Column:
        col = F.lower(F.coalesce(F.col(name), F.lit("")))
        places = F.when(F.length(col) >= GRAM, F.sequence(F.lit(1), F.length(col) - GRAM + 1))
        return F.coalesce(F.transform(places, lambda i: F.substring(col, i, F.lit(GRAM))), F.array().cast("array<string>"))

    postings = titles.select("id", F.explode(F.array_union(grams("occ"), grams("job"))).alias("gram"))
    postings.repartitionByRange("gram").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")


def indexed_suggest(spark: SparkSession, path: str, spec: FilingsSpec, text: str, k: int | None = 25) -> DataFrame:
    """``title_suggest`` from a title index: titles that hold all grams of ``text`` are looked at, no filings.

    A text shorter than a gram is looked for in the distinct titles.
    """
    titles, plain = spark.read.parquet(f"{path}/titles"), text.lower()
    wanted = sorted({plain[i:i + GRAM] for i in range(len(plain) - GRAM + 1)})
    if wanted:
        found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        titles = titles.join(found.where(F.col("_n") == len(wanted)), "id", "left_semi")
    hit = literal_contains(F.col("occ"), text) | literal_contains(F.col("job"), text)
    occ = spec.occupation_col
    return _suggested(titles.where(hit).groupBy(F.col("occ").alias(occ)).agg(F.sum("filings").alias("filings")), occ, k)


def facet_values(df: DataFrame, spec: FilingsSpec) -> DataFrame:
    """Sorted distinct non-null values of every facet, from one scan (``stack``)."""
    facets = [("state", spec.state_col), ("sector", "NAICS_SECTOR")]
    if "WAGE_LEVEL" in df.columns:
        facets.append(("wage_level", "WAGE_LEVEL"))
    args = ", ".join(f"'{name}', `{col}`" for name, col in facets)
    long = df.select(F.expr(f"stack({len(facets)}, {args}) AS (facet, value)"))
    return long.where(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


# -- personas --------------------------------------------------------------------------

#: Personas that one table may hold: it is broadcast against the distinct titles.
MAX_PERSONAS = 10_000


def persona_table(spark: SparkSession, personas: Mapping[str, tuple[str, ...]] = PERSONA_KEYWORDS) -> DataFrame:
    """(persona, pattern): keyword lists as data, so any number of personas is one plan."""
    return spark.createDataFrame([(name, "(?i)" + keyword_pattern(words)) for name, words in personas.items()], "persona string, pattern string")


def _personas(spark: SparkSession, personas) -> DataFrame:
    table = personas if isinstance(personas, DataFrame) else persona_table(spark, personas)
    if table.count() > MAX_PERSONAS:
        raise ValueError(f"more than {MAX_PERSONAS} personas")
    return F.broadcast(table)


def title_personas(titles: DataFrame, title_cols, personas) -> DataFrame:
    """The rows of distinct ``titles`` joined with every persona whose pattern some title column holds (a theta join).

    Patterns are only ever looked for here, once a distinct title.
    """
    cols = [c for c in title_cols if c in titles.columns]
    held = reduce(or_, [F.rlike(F.coalesce(F.col(c), F.lit("")), F.col("pattern")) for c in cols], F.lit(False))
    return titles.join(_personas(titles.sparkSession, personas), held).drop("pattern")


def persona_matches(df: DataFrame, title_cols, personas=PERSONA_KEYWORDS) -> DataFrame:
    """(persona, row...) for every row matching a persona; ``personas``: keyword lists, or a table (persona, pattern).

    Rows meet a dictionary of the distinct titles that match, so a pattern is looked for once a title, not once a filing.
    """
    cols = [c for c in title_cols if c in df.columns]
    names = [f"_title{i}" for i in range(len(cols))]
    found = title_personas(df.select(*cols).distinct(), cols, personas).withColumnsRenamed(dict(zip(cols, names)))
    found = found.groupBy(*names).agg(F.collect_list("persona").alias("_in"))  # a list of at most MAX_PERSONAS
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cols, names)], F.lit(True))
    return df.join(found, same).select(*df.columns, F.explode("_in").alias("persona"))


def persona_catalog(df: DataFrame, title_cols, personas=PERSONA_KEYWORDS) -> DataFrame:
    """Per persona: matched filings and share of all rows, from one count of the filings by title."""
    cols = [c for c in title_cols if c in df.columns]
    counts = stored(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
    rows = counts.agg(F.sum("_n")).first()[0] or 0
    table = personas if isinstance(personas, DataFrame) else persona_table(df.sparkSession, personas)
    matched = title_personas(counts, cols, personas).groupBy("persona").agg(F.sum("_n").alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(0)).cast("long")
    return table.select("persona").join(matched, "persona", "left").select(
        "persona", hit.alias("matched_filings"), F.try_divide(hit.cast("double"), F.lit(float(rows))).alias("share_of_total"))


def top_per_persona(matched: DataFrame, col: str, k: int | None, min_count: int = 1) -> DataFrame:
    counts = matched.where(F.col(col).isNotNull()).groupBy("persona", col).agg(F.count(F.lit(1)).alias("filings"))
    if min_count > 1:
        counts = counts.where(F.col("filings") >= min_count)
    w = Window.partitionBy("persona").orderBy(F.desc("filings"), F.asc(col))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k else ranked


def persona_fy_counts(matched: DataFrame, max_quarter: int = 3) -> DataFrame:
    return (matched.where((F.col("FISCAL_QUARTER") <= max_quarter) & F.col("FISCAL_YEAR").isNotNull())
            .groupBy("persona", "FISCAL_YEAR").agg(F.count(F.lit(1)).alias("filings")))


def persona_wages(matched: DataFrame, wage: str = "ANNUAL_WAGE") -> DataFrame:
    d = distribution(matched.where(F.col(wage).isNotNull()), ["persona"], wage)
    return d.summary({"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumnRenamed("_n", "wage_n")


def persona_level_shares(matched: DataFrame, level: str = "PW_WAGE_LEVEL") -> DataFrame:
    counts = matched.where(F.col(level).isNotNull()).groupBy("persona", level).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("persona")))


def persona_flag_share(matched: DataFrame, flag: str = "IS_NEW_EMPLOYMENT") -> DataFrame:
    return matched.groupBy("persona").agg(F.avg(F.col(flag).cast("double")).alias("new_share"))


def persona_shortlist(matched: DataFrame, levels=("II", "III"), min_filings: int = 2,
                      wage: str = "ANNUAL_WAGE_FROM", employer: str = "EMPLOYER_CANONICAL") -> DataFrame:
    src = matched.where(F.col("PW_WAGE_LEVEL").isin(*levels) & F.col(employer).isNotNull())
    d = distribution(src, ["persona", employer], wage)
    enough = d.summary({"median_wage": 0.5}).where(F.col("_n") >= min_filings).withColumnRenamed("_n", "matched_filings")
    return (enough
            .orderBy("persona", F.desc("matched_filings"), F.asc(employer)))


def persona_dominant(matched: DataFrame, sector: str = "NAICS_SECTOR", occupation: str = "SOC_TITLE") -> DataFrame:
    s = top_per_persona(matched, sector, 1).select("persona", F.col(sector).alias("top_sector"))
    o = top_per_persona(matched, occupation, 1).select("persona", F.col(occupation).alias("top_occupation"))
    return s.join(o, "persona", "full")
