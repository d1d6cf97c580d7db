"""Raw export scans (S1, S2, C8): distributed CSV reads, every file bound by its own header.

Sources carry different headers across vintages, and so can the files of one
source folder.  One distributed pass over the files' lines, whatever their
number, finds each file's header and whether a quoted cell spans lines
(``layouts``).  Files of one layout are one read: split into blocks, unless a
cell spans lines.  All frames are combined by column name (never by position).
A row's own file is at hand as file metadata (``file_column``).
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.operators.ingest import consolidate, normalize_headers, union_sources

BOM = "\ufeff"


@dataclass(frozen=True)
class Source:
    name: str      # provenance label written to SOURCE_FILE
    path: str      # file or folder of CSV parts
    order: int     # precedence: higher = newer, wins on duplicate cases


@dataclass(frozen=True)
class Layout:
    header: str
    spans_lines: bool
    files: tuple[str, ...]


def csv_reader(spark: SparkSession, spans_lines: bool = True):
    """Quoted cells and doubled quotes; every column text (no inference).  ``spans_lines``: cells may hold line breaks."""
    return (spark.read.option("header", True).option("multiLine", spans_lines)
            .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("inferSchema", False))


def literal_path(path: str) -> str:
    """A path whose characters stand for themselves where patterns are allowed."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def layouts(spark: SparkSession, path: str | list[str]) -> list[Layout]:
    """The files under ``path`` that hold anything, by header and need; one job reads their lines once.

    A file's header is its first line.  Where all lines hold an even number of quotes, no cell spans lines.
    What reaches the driver is a row a layout, and the names of the files, which Spark lists there anyway.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))  # grows within a block
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    files = lines.groupBy("file").agg(
        F.min_by(F.when(F.col("start") == 0, F.col("value")), F.when(F.col("start") == 0, F.col("place"))).alias("header"),
        F.bool_or(quotes % 2 == 1).alias("spans_lines"))
    found = files.groupBy("header", "spans_lines").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return sorted((Layout(r.header, r.spans_lines, tuple(unquote(f) for f in r.files)) for r in found),
                  key=lambda x: (x.files[0], x.spans_lines))


def column_names(spark: SparkSession, layout: Layout) -> tuple[list[str], bool]:
    """The layout's columns, and whether they are the header's own words."""
    names = next(csv.reader([layout.header])) if not layout.header.count('"') % 2 else []
    if not names or not all(names) or len({n.lower() for n in names}) < len(names):
        # unnamed or repeated columns and headers of several lines are named by Spark's own rules
        return csv_reader(spark).csv(literal_path(layout.files[0])).columns, False
    return names, True


def csv_scan(spark: SparkSession, path: str | list[str], file_column: str | None = None) -> DataFrame:
    """The files of ``path`` by name of column; a column that a file lacks is null in its rows.

    ``file_column``: add each row's own file.
    """
    frames = []
    for layout in layouts(spark, path if isinstance(path, str) else [literal_path(p) for p in path]):
        names, own = column_names(spark, layout)
        # enforceSchema off: a file whose header has changed since fails instead of shifting its columns
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
        df = csv_reader(spark, layout.spans_lines).option("enforceSchema", not own).schema(schema).csv([literal_path(f) for f in layout.files])
        if file_column:
            # the path is percent-encoded, and a plus sign stands for itself
            plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            df = df.select("*", plain.alias(file_column))
        renames = {c: c.lstrip(BOM) for c in names if c.startswith(BOM)}
        frames.append(normalize_headers(df.withColumnsRenamed(renames) if renames else df))
    return union_sources(frames) if frames else spark.createDataFrame([], "CASE_NUMBER string")


def read_sources(spark: SparkSession, sources: list[Source], file_column: str | None = None) -> list[DataFrame]:
    """One frame per source, tagged with SOURCE_FILE / SOURCE_ORD (oldest first)."""
    frames = []
    for s in sorted(sources, key=lambda s: s.order):
        df = csv_scan(spark, s.path, file_column)
        frames.append(df.withColumns({"SOURCE_FILE": F.lit(s.name), "SOURCE_ORD": F.lit(s.order)}))
    return frames


def consolidate_sources(spark: SparkSession, sources: list[Source], numeric_cols=(), file_column: str | None = None) -> DataFrame:
    return consolidate(read_sources(spark, sources, file_column), numeric_cols=numeric_cols)
