"""Employer entity resolution: canonical names, brand rollup, cross-dataset match.

All regex work runs on *distinct* names (after a partial-aggregated
``groupBy``), never once per filing row, and only one join touches the
fact rows: raw name -> final employer label.  That join is sized at run
time by AQE (broadcast when the map is small, shuffle join with skew
splitting when a single employer holds a large share of the rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.functions.names import clean_name, core_key, core_key_of_clean, is_all_caps, strip_ws
from filingscope.session import landed

# Curated brand -> known legal-entity spellings of that brand.
BRAND_GROUPS: dict[str, tuple[str, ...]] = {
    "Amazon": (
        "Amazon.com Services LLC",
        "Amazon Web Services, Inc.",
        "Amazon Development Center U.S., Inc.",
        "Amazon Data Services, Inc",
        "Amazon Advertising LLC",
        "Amazon Retail LLC",
        "Amazon Payments, Inc.",
        "Amazon Studios, LLC",
        "Amazon Capital Services, Inc.",
        "Amazon Media Venture LLC",
    ),
    "Goldman Sachs": (
        "Goldman Sachs & Co. LLC",
        "Goldman Sachs Services LLC",
        "Goldman Sachs Bank USA",
        "Goldman Sachs Wealth Services, L.P.",
        "The Ayco Company, L.P., a Goldman Sachs Company",
        "The Goldman Sachs Trust Company, NA",
        "The Goldman Sachs Trust Company",
    ),
    "Deloitte": (
        "Deloitte Consulting LLP",
        "Deloitte & Touche LLP",
        "Deloitte Tax LLP",
        "Deloitte Services LP",
        "Deloitte Touche Tohmatsu Services, LLC",
        "Deloitte Transactions and Business Analytics LLP",
        "Deloitte LLP",
        "Deloitte Financial Advisory Services LLP",
    ),
    "PwC": (
        "PricewaterhouseCoopers Advisory Services LLC",
        "PricewaterhouseCoopers LLP",
        "PricewaterhouseCoopers IT Services US LLC",
        "PricewaterhouseCoopers Corporate Finance LLC",
    ),
    "Citigroup": (
        "Citibank, N.A.",
        "Citibank, N.A. Puerto Rico",
        "Citigroup Global Markets Inc.",
        "Citigroup Technology, Inc.",
        "Citigroup Energy Inc.",
        "Citigroup Washington, Inc.",
    ),
    "Capital One": (
        "Capital One Services, LLC",
        "Capital One, National Association",
    ),
    "Wells Fargo": (
        "Wells Fargo Bank, N.A.",
        "Wells Fargo Securities, LLC",
        "Wells Fargo Clearing Services, LLC",
    ),
    "Morgan Stanley": (
        "Morgan Stanley Services Group Inc.",
        "Morgan Stanley & Co., LLC",
        "Morgan Stanley Smith Barney LLC",
        "Morgan Stanley Investment Management Inc.",
        "Morgan Stanley Fund Services Inc.",
        "Morgan Stanley Bank N.A.",
        "Morgan Stanley Private Bank NA",
        "Morgan Stanley Capital Group Inc.",
    ),
    "Bank of America": (
        "Bank of America N.A.",
        "Bank of America Corporation",
        "BofA Securities, Inc.",
    ),
    "Deutsche Bank": (
        "DB Global Technology, Inc.",
        "DB USA Core Corporation",
        "Deutsche Bank Securities, Inc.",
        "Deutsche Bank New York Branch",
        "Deutsche Bank Trust Company Americas",
        "Deutsche Bank National Trust Company",
    ),
    "Visa": (
        "Visa Technology & Operations LLC",
        "Visa U.S.A. Inc.",
    ),
    "Mastercard": (
        "Mastercard Technologies, LLC",
        "Mastercard International Incorporated",
        "Mastercard Mobile Transactions Solutions, Inc.",
    ),
    "Dell": (
        "Dell USA L.P.",
        "Dell Products L.P.",
        "Dell Product L.P.",
        "Dell Marketing L.P.",
        "Dell Financial Services L.L.C.",
        "Dell Puerto Rico Corporation",
    ),
    "Samsung": (
        "Samsung Electronics America, Inc.",
        "Samsung Austin Semiconductor, L.L.C.",
        "Samsung Semiconductor, Inc.",
        "Samsung Research America, Inc.",
        "Samsung SDI America, Inc.",
        "Samsung HME America, Inc.",
        "Samsung Electronics Home Appliances America, LLC",
    ),
    "HCL": (
        "HCL America Inc",
        "HCL Global Systems Inc",
        "HCL America Solutions Inc",
    ),
    "Capgemini": (
        "Capgemini America Inc",
        "Capgemini Government Solutions LLC",
    ),
    "Wipro": (
        "Wipro Limited",
        "Wipro VLSI Design Services, LLC",
        "Wipro NextGen Enterprise Inc.",
        "Wipro Telecom Consulting LLC",
        "Wipro Connected Services Inc",
        "Wipro Appirio Inc",
        "Wipro Pari Inc.",
        "Wipro Enterprises, Inc.",
        "Wipro Designit Services, Inc.",
    ),
    "Fidelity Investments": (
        "Fidelity Technology Group, LLC d/b/a Fidelity Investments",
        "Fidelity Technology Group, LLC",
        "FMR LLC d/b/a Fidelity Investments",
        "Fidelity Brokerage Services LLC d/b/a Fidelity Investments",
        "Fidelity Workplace Investing LLC d/b/a Fidelity Investments",
        "Fidelity Management & Research Company LLC d/b/a Fidelity Investments",
        "National Charitable Services LLC d/b/a Fidelity Investments",
        "Fidelity Investments Institutional Operations Company d/b/a Fidelity Investments",
    ),
    "TikTok": (
        "TikTok Inc.",
        "TikTok U.S. Data Security Inc.",
        "TikTok USDS Joint Venture LLC",
        "BD TikTok USA LLC",
    ),
    "CVS Health": (
        "CVS Shared Services Resources LLC",
        "CVS Pharmacy Inc.",
        "CVS Rx Services Inc.",
        "Caremark LLC",
    ),
    "Citadel": (
        "Citadel Securities Americas Services LLC",
        "Citadel Americas Services LLC",
        "Citadel Enterprise Americas Services LLC",
    ),
}


def brand_variants() -> list[tuple[str, str]]:
    return [(brand, v) for brand, variants in BRAND_GROUPS.items() for v in variants]


def brand_map(spark: SparkSession) -> DataFrame:
    """(core, brand): the 108 curated spellings reduced to their core keys.

    Bounded by the curated list (not by the data), so it is always safe to
    broadcast.
    """
    rows = brand_variants()
    df = spark.createDataFrame(rows, "brand string, variant string")
    return df.select(core_key("variant").alias("core"), "brand").dropDuplicates(["core"])


def spelling_counts(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Exact raw spelling -> filings, over every (df, column) given.

    Partial aggregation reduces each dataset to its distinct spellings before
    anything else touches the names.
    """
    parts = [df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("raw_spelling"))
             .agg(F.count(F.lit(1)).alias("n")) for df, col in sources]
    return reduce(lambda a, b: a.unionByName(b), parts)


def name_counts(*sources: tuple[DataFrame, str], spellings: DataFrame | None = None) -> DataFrame:
    """Stripped raw name -> filings; the Unicode strip runs once per distinct spelling."""
    sp = spellings if spellings is not None else spelling_counts(*sources)
    return sp.groupBy(_non_null(strip_ws("raw_spelling")).alias("raw_name")).agg(F.sum("n").alias("n"))


def _non_null(c):
    """Mark a key that is never null (its input is filtered) as non-nullable.

    Without it, the optimizer infers ``isnotnull(<regex chain>)`` from the
    joins on the key and pushes that filter through the aggregations into
    the fact scan, evaluating the name regexes once per filing row instead
    of once per distinct name.
    """
    return F.coalesce(c, F.lit(""))


def canonical_map(*sources: tuple[DataFrame, str], spellings: DataFrame | None = None) -> DataFrame:
    """raw_name -> canonical_name shared by all datasets passed together.

    Per core key, the most frequent raw spelling wins; ties prefer a
    spelling that is not all capitals, then the alphabetically first.
    """
    counts = name_counts(*sources, spellings=spellings).select(
        "raw_name", "n",
        _non_null(core_key("raw_name")).alias("core"),
        is_all_caps("raw_name").alias("is_caps"),
    )
    best = counts.groupBy("core").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("is_caps"), F.col("raw_name"))).alias("b")
    ).select("core", F.col("b.raw_name").alias("canonical_name"))
    return counts.join(best, "core").select("raw_name", "core", "canonical_name", "n")


def employer_map(spark: SparkSession, canon: DataFrame) -> DataFrame:
    """raw_name -> EMPLOYER_CANONICAL with the curated brand rollup applied.

    The canonical spelling shares its core key with every raw spelling in its
    group, so the brand is looked up by that core key once per distinct name.
    """
    brands = F.broadcast(brand_map(spark))
    return (
        canon.join(brands, "core", "left")
        .select("raw_name", F.col("canonical_name").alias("CANONICAL_NAME"),
                F.coalesce("brand", "canonical_name").alias("EMPLOYER_CANONICAL"))
    )


def spelling_map(spark: SparkSession, *sources: tuple[DataFrame, str]) -> DataFrame:
    """Exact raw spelling -> (CANONICAL_NAME, EMPLOYER_CANONICAL) over all datasets.

    Keyed by the spelling as it appears in the filings, so the fact-side
    lookup is a plain equi-join on the raw column (no per-row expression).
    """
    spellings = landed(spelling_counts(*sources), "spellings")  # read twice: the filings are counted once
    labels = employer_map(spark, canonical_map(spellings=spellings))
    keyed = spellings.select("raw_spelling").distinct().withColumn("raw_name", _non_null(strip_ws("raw_spelling")))
    return keyed.join(labels, "raw_name").select("raw_spelling", "CANONICAL_NAME", "EMPLOYER_CANONICAL")


def apply_canonical(df: DataFrame, raw_col: str, out_col: str | None, mapping: DataFrame) -> DataFrame:
    """Left lookup of a raw name column in ``mapping``.

    A map keyed by ``raw_spelling`` is joined on the column as is; a map keyed
    by the stripped ``raw_name`` is joined on the stripped column.  With
    ``out_col`` the last label column is renamed to it; otherwise every label
    column is attached under its own name.
    """
    key = "raw_spelling" if "raw_spelling" in mapping.columns else "raw_name"
    labels = [c for c in mapping.columns if c not in ("raw_name", "raw_spelling")]
    if out_col is not None:
        m = mapping.select(F.col(key).alias("_emp_key"), F.col(labels[-1]).alias(out_col))
    else:
        m = mapping.select(F.col(key).alias("_emp_key"), *labels)
    probe = F.col(raw_col) if key == "raw_spelling" else strip_ws(F.col(raw_col))
    return df.withColumn("_emp_key", probe).join(m, "_emp_key", "left").drop("_emp_key")


def brand_rollup(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Replace names that belong to a curated brand by the brand label."""
    spark = df.sparkSession
    out_col = out_col or col
    distinct = df.select(F.col(col).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    keyed = distinct.withColumn("core", core_key("_name"))
    labels = keyed.join(F.broadcast(brand_map(spark)), "core", "left").select(
        "_name", F.coalesce("brand", "_name").alias("_label"))
    return (
        df.join(labels, df[col].eqNullSafe(labels["_name"]), "left")
        .withColumn(out_col, F.col("_label"))
        .drop("_name", "_label")
    )


def label_counts(df: DataFrame, col: str = "EMPLOYER_CANONICAL") -> DataFrame:
    """(_name, _n) of the non-null labels."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_name")).agg(F.count(F.lit(1)).alias("_n"))


def _side_counts(per_name: DataFrame, prefix: str) -> DataFrame:
    keyed = per_name.withColumn("employer_core_key", core_key("_name"))
    return keyed.groupBy("employer_core_key").agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_name"))).getField("_name").alias(f"{prefix}_canonical_name"),
        F.sum("_n").alias(f"{prefix}_filings"),
    )


def match_datasets(left: DataFrame, right: DataFrame, lcol: str = "EMPLOYER_CANONICAL",
                   rcol: str = "EMPLOYER_CANONICAL", lprefix: str = "lca", rprefix: str = "perm",
                   key_on: str = "core") -> DataFrame:
    """One row per employer core key present on either side.

    ``key_on='brand_or_core'`` keeps curated brand labels apart from plain
    names that happen to share their core key (e.g. 'The Citadel').
    """
    return match_names(label_counts(left, lcol), label_counts(right, rcol), lprefix, rprefix, key_on)


def match_names(left: DataFrame, right: DataFrame, lprefix: str = "lca", rprefix: str = "perm",
                key_on: str = "core") -> DataFrame:
    """``match_datasets`` from counted names (_name, _n) of either side."""
    lc, rc = _side_counts(left, lprefix), _side_counts(right, rprefix)
    if key_on == "brand_or_core":
        spark = left.sparkSession
        brands = spark.createDataFrame([(b,) for b in BRAND_GROUPS], "brand string")
        lc = _prefix_brand_keys(lc, f"{lprefix}_canonical_name", brands)
        rc = _prefix_brand_keys(rc, f"{rprefix}_canonical_name", brands)
    m = lc.join(rc, "employer_core_key", "full")
    lf, rf = f"{lprefix}_filings", f"{rprefix}_filings"
    return m.select(
        "employer_core_key",
        f"{lprefix}_canonical_name",
        F.coalesce(F.col(lf), F.lit(0)).cast("long").alias(lf),
        f"{rprefix}_canonical_name",
        F.coalesce(F.col(rf), F.lit(0)).cast("long").alias(rf),
    ).withColumn("sponsors_both", (F.col(lf) > 0) & (F.col(rf) > 0))


def _prefix_brand_keys(counts: DataFrame, name_col: str, brands: DataFrame) -> DataFrame:
    b = F.broadcast(brands.withColumnRenamed("brand", "_brand"))
    joined = counts.join(b, counts[name_col] == b["_brand"], "left")
    return joined.withColumn(
        "employer_core_key",
        F.when(F.col("_brand").isNotNull(), F.concat(F.lit("BRAND:"), F.col("employer_core_key")))
        .otherwise(F.col("employer_core_key")),
    ).drop("_brand")


def both_datasets(match: DataFrame, lprefix: str = "lca", rprefix: str = "perm") -> DataFrame:
    return match.where("sponsors_both").orderBy(
        F.desc(f"{lprefix}_filings"), F.desc(f"{rprefix}_filings"), F.asc("employer_core_key"))


def left_only(match: DataFrame, lprefix: str = "lca", rprefix: str = "perm") -> DataFrame:
    return match.where((F.col(f"{lprefix}_filings") > 0) & (F.col(f"{rprefix}_filings") == 0))


def dedupe_effect(df: DataFrame, raw_col: str, canon_col: str = "EMPLOYER_CANONICAL") -> DataFrame:
    return df.agg(
        F.count_distinct(raw_col).alias("raw_names"),
        F.count_distinct(canon_col).alias("canonical_names"),
    )


def history_flag(df: DataFrame, other: DataFrame, col: str = "EMPLOYER_CANONICAL",
                 out_col: str = "other_history") -> DataFrame:
    """True when the exact label also occurs anywhere in ``other``."""
    keys = other.select(F.col(col).alias("_hk")).where(F.col("_hk").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    return (
        df.join(keys, df[col] == keys["_hk"], "left")
        .withColumn(out_col, F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_hk", "_hit")
    )


def clean_and_core(df: DataFrame, col: str) -> DataFrame:
    """Distinct raw names with their cleaned form and core key (E1 / E2)."""
    d = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("raw_name")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("raw_name", clean_name("raw_name").alias("cleaned"),
                    core_key_of_clean(clean_name("raw_name")).alias("core"), "n")
