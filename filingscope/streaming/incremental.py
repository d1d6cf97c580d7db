"""Incremental ingest of newly published exports with Structured Streaming.

New export files landing under ``landing/<source>/`` are picked up by a file
stream, which only lists them; every micro-batch then reads its files by
their own headers (``sources.raw``), cleans them with the same per-row
projections as the batch consolidation, tags them with source and precedence,
and writes Parquet partitioned by batch and fiscal period.  A batch replaces
its own folder, so a batch repeated after a failure leaves no second copy.

A file of a source that the manifest does not list fails the batch; no row is
lost in silence.  Latest-source-wins needs every source of a case, so it is
applied when the appended table is read (``read_consolidated``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingscope.operators.ingest import add_fiscal_calendar, drop_blank, latest_source_wins, prepare_raw
from filingscope.sources.raw import csv_scan


class UnlistedSource(ValueError):
    """A landed file belongs to no source of the manifest."""


def source_of(path: str) -> str:
    return path.rstrip("/").split("/")[-2]


def clean_files(spark: SparkSession, files: list[str], order_of: dict[str, int], numeric_cols=(),
                key: str = "CASE_NUMBER") -> DataFrame:
    """The landed files as cleaned rows with SOURCE_FILE, SOURCE_ORD and the fiscal calendar."""
    by_source: dict[str, list[str]] = {}
    for file in files:
        by_source.setdefault(source_of(file), []).append(file)
    unlisted = sorted(set(by_source) - set(order_of))
    if unlisted:
        raise UnlistedSource(f"no manifest entry for {', '.join(unlisted)}")
    frames = [csv_scan(spark, group).withColumns({"SOURCE_FILE": F.lit(s), "SOURCE_ORD": F.lit(order_of[s])})
              for s, group in sorted(by_source.items())]
    return add_fiscal_calendar(drop_blank(prepare_raw(frames, key, numeric_cols), key))


def start_ingest(spark: SparkSession, landing: str, order_of: dict[str, int], table: str, checkpoint: str,
                 numeric_cols=(), available_now: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Start the file stream; ``available_now`` processes what has landed and stops.

    ``order_of``: precedence of each source; ``files_per_batch`` bounds the file list of one micro-batch.
    """
    landed = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", files_per_batch).load(f"{landing}/*")
              .where("length > 0").select("path"))

    def ingest(batch: DataFrame, number: int) -> None:
        files = sorted(r.path for r in batch.collect())  # at most files_per_batch names
        if files:
            rows = clean_files(spark, files, order_of, numeric_cols)
            (rows.write.mode("overwrite").partitionBy("FISCAL_YEAR", "FISCAL_QUARTER")
             .parquet(f"{table}/batch={number}"))

    w = landed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_consolidated(spark: SparkSession, table: str, key: str = "CASE_NUMBER",
                      order_col: str = "SOURCE_ORD") -> DataFrame:
    """All batches by column name (a batch may lack a column), newest source of each case."""
    rows = spark.read.option("mergeSchema", True).parquet(table).drop("batch")
    return latest_source_wins(rows, key, order_col)
