"""Consolidation of raw periodic exports into one master table (C1-C12).

Everything is one lazy plan: scan per source -> rename -> unwrap -> union by
name -> drop blanks -> parse dates -> fiscal calendar -> latest source wins.
The only all-row shuffle is the latest-source-wins semi join on the case key;
its per-case maximum is a partially aggregated ``groupBy`` and the join
itself is eligible for AQE skew splitting, so one giant case cannot pin a
task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope.functions.dates import fiscal_basis, fiscal_quarter, fiscal_year, iso_date, parse_date
from filingscope.functions.text import NULL_TOKENS, null_token, unwrap_text

# Header spellings that changed across export vintages.
COLUMN_RENAMES = {"H-1B_DEPENDENT": "H_1B_DEPENDENT"}
DATE_COLUMNS = ("RECEIVED_DATE", "DECISION_DATE", "ORIGINAL_CERT_DATE")


def normalize_headers(df: DataFrame, renames: dict[str, str] = COLUMN_RENAMES) -> DataFrame:
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unwrap_text_cells(df: DataFrame) -> DataFrame:
    cols = _string_cols(df)
    return df.withColumns({c: unwrap_text(c) for c in cols}) if cols else df


def drop_blank(df: DataFrame, key: str = "CASE_NUMBER") -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Ordered union of every source's header; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def null_tokens(df: DataFrame, cols=None, tokens=NULL_TOKENS) -> DataFrame:
    cols = [c for c in (cols or _string_cols(df)) if c in df.columns]
    return df.withColumns({c: null_token(c, tokens) for c in cols}) if cols else df


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols}) if cols else df


def coerce_iso_date(df: DataFrame, cols) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: iso_date(c) for c in cols}) if cols else df


def parse_dates(df: DataFrame, cols=DATE_COLUMNS) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.withColumns({c: parse_date(c) for c in cols}) if cols else df


def add_fiscal_calendar(df: DataFrame, decision: str = "DECISION_DATE", received: str = "RECEIVED_DATE") -> DataFrame:
    """FISCAL_YEAR / FISCAL_QUARTER from the decision date, else the received date.

    A row with neither date gets null fiscal fields (counted by the ingest
    report) instead of failing the job.
    """
    d = fiscal_basis(decision, received)
    return df.withColumns({"FISCAL_YEAR": fiscal_year(d), "FISCAL_QUARTER": fiscal_quarter(d)})


def latest_source_wins(df: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD") -> DataFrame:
    """Keep, per case, every row of the newest source that has the case.

    Duplicates *inside* the winning source all survive (not a dedupe).
    """
    winners = df.groupBy(key).agg(F.max(order_col).alias(order_col))
    winners = winners.select(F.col(key).alias("_case"), F.col(order_col).alias("_newest"))
    won = F.col(key).eqNullSafe(F.col("_case")) & F.col(order_col).eqNullSafe(F.col("_newest"))
    return df.join(winners, won, "left_semi")  # a case whose sources have no order keeps its rows


def ingest_report(raw: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD",
                  source_col: str = "SOURCE_FILE") -> DataFrame:
    """Per source: rows read, blank template rows, stale duplicates, rows written,
    and written rows whose fiscal calendar could not be derived."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    populated = raw.where(~blank)
    winners = populated.groupBy(key).agg(F.max(order_col).alias("_win"))
    # blank rows are counted by themselves: in the join they would all be one key
    flagged = populated.join(winners, key).withColumn("_stale", ~F.col(order_col).eqNullSafe(F.col("_win")))
    no_date = F.coalesce(F.col("DECISION_DATE"), F.col("RECEIVED_DATE")).isNull()
    none = F.lit(0).cast("long")
    cases = flagged.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("rows_read"),
        none.alias("blank_rows"),
        F.count_if(F.col("_stale")).alias("stale_duplicates"),
        F.count_if(~F.col("_stale")).alias("rows_written"),
        F.count_if(~F.col("_stale") & no_date).alias("no_fiscal_date"),
    )
    blanks = raw.where(blank).groupBy(source_col).agg(F.count(F.lit(1)).alias("rows_read")).select(
        source_col, "rows_read", F.col("rows_read").alias("blank_rows"), none.alias("stale_duplicates"),
        none.alias("rows_written"), none.alias("no_fiscal_date"))
    counts = [c for c in cases.columns if c != source_col]
    return cases.unionByName(blanks).groupBy(source_col).agg(*[F.sum(c).alias(c) for c in counts])


def prepare_raw(frames: list[DataFrame], key: str = "CASE_NUMBER", numeric_cols=(),
                tokens=NULL_TOKENS) -> DataFrame:
    """Header rename, cell unwrap, union by name, NA tokens, dates, numbers.

    Blank template rows are still present (the ingest report counts them).
    """
    cleaned = [unwrap_text_cells(normalize_headers(f)) for f in frames]
    df = union_sources(cleaned)
    df = null_tokens(df, [c for c in _string_cols(df) if c not in (key, "SOURCE_FILE")], tokens)
    df = parse_dates(df)
    return coerce_numeric(df, numeric_cols)


def clean_rows(frames: list[DataFrame], key: str = "CASE_NUMBER", numeric_cols=(), tokens=NULL_TOKENS) -> DataFrame:
    """Raw text frames, each carrying SOURCE_FILE and SOURCE_ORD -> typed rows with their fiscal calendar."""
    return add_fiscal_calendar(drop_blank(prepare_raw(frames, key, numeric_cols, tokens), key))


def consolidate(frames: list[DataFrame], key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD",
                numeric_cols=(), tokens=NULL_TOKENS) -> DataFrame:
    """Raw text frames (one per source, oldest first, each carrying SOURCE_FILE
    and SOURCE_ORD) -> consolidated master rows."""
    return latest_source_wins(clean_rows(frames, key, numeric_cols, tokens), key, order_col)
