"""Staged exports (C7, C9 without shuffling the filings again): typed rows, parsed once, bucketed by case.

An export's text is parsed, cleaned and written once, to a Parquet table bucketed by case number.  Whatever compares a
case's rows afterwards (latest source wins, the ingest report) finds them in one bucket: the join of the rows with
their case's newest source has no exchange on either side, and it reads only the columns it needs.  Blank template
rows are staged too, as the report counts them; they are dealt over all tasks, not to the task of the empty key.
A bucket is one task's work, so this is for exports whose cases have few rows each; for a table with a case of very
many rows ``ingest.latest_source_wins`` splits that case.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filingscope.operators.ingest import add_fiscal_calendar, prepare_raw
from filingscope.session import delete_path, scratch_path
from filingscope.sources.master import write_master


@dataclass(frozen=True)
class Stage:
    table: str
    path: str
    key: str
    order_col: str


def blank(key: str) -> Column:
    return F.col(key).isNull() | (F.col(key) == "")


def stage_exports(spark: SparkSession, frames: list[DataFrame], numeric_cols=(), buckets: int | None = None,
                  key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD", seen: Observation | None = None,
                  metrics: list[Column] | None = None) -> Stage:
    """Parse and clean raw frames (each carrying SOURCE_FILE and SOURCE_ORD) once, into a new stage.

    ``buckets``: as many as the session's shuffle partitions, which follow the size of the data.  ``seen`` observes
    ``metrics`` of the rows in the tasks that write them.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stage = Stage(f"stage_{uuid.uuid4().hex[:12]}", scratch_path(spark, "stage"), key, order_col)
    rows = add_fiscal_calendar(prepare_raw(frames, key, numeric_cols))
    # a text's hash is its bucket, so each task writes one bucket; a blank row goes by its own number instead
    own = F.when(blank(key), F.xxhash64(F.monotonically_increasing_id()).cast("string")).otherwise(F.col(key))
    rows = rows.repartition(buckets, own)
    rows = rows if seen is None else rows.observe(seen, *metrics)
    (rows.sortWithinPartitions(key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", stage.path).saveAsTable(stage.table))
    return stage


def with_newest(spark: SparkSession, stage: Stage, columns: list[str] | None = None) -> DataFrame:
    """The staged rows that have a case, with ``_newest``, the order of their case's newest source."""
    rows = spark.table(stage.table).where(~blank(stage.key))
    newest = rows.groupBy(stage.key).agg(F.max(stage.order_col).alias("_newest"))
    # on the case alone: bucketing covers that key, and the order is compared afterwards
    return (rows.select(*columns) if columns else rows).hint("merge").join(newest, stage.key)


def consolidate_stage(spark: SparkSession, stage: Stage) -> DataFrame:
    """Per case all rows of its newest source, as ``ingest.latest_source_wins``, without an exchange."""
    # no order is beyond the newest; an equality here would become a second join key, which the buckets don't cover
    won = (F.col(stage.order_col) >= F.col("_newest")) | F.col("_newest").isNull()
    return with_newest(spark, stage).where(won).drop("_newest")


def stage_report(spark: SparkSession, stage: Stage, source_col: str = "SOURCE_FILE") -> DataFrame:
    """``ingest.ingest_report`` of a stage: five columns of it are read, only counts by source are shuffled."""
    no_date = F.coalesce(F.col("DECISION_DATE"), F.col("RECEIVED_DATE")).isNull()
    stale = ~F.col(stage.order_col).eqNullSafe(F.col("_newest"))
    cases = with_newest(spark, stage, [stage.key, stage.order_col, source_col, "DECISION_DATE", "RECEIVED_DATE"]).groupBy(source_col).agg(
        F.count(F.lit(1)).alias("rows_read"), F.lit(0).cast("long").alias("blank_rows"), F.count_if(stale).alias("stale_duplicates"),
        F.count_if(~stale).alias("rows_written"), F.count_if(~stale & no_date).alias("no_fiscal_date"))
    none = F.lit(0).cast("long")
    blanks = spark.table(stage.table).where(blank(stage.key)).groupBy(source_col).agg(F.count(F.lit(1)).alias("blank_rows")).select(
        source_col, F.col("blank_rows").alias("rows_read"), "blank_rows", none.alias("stale_duplicates"), none.alias("rows_written"),
        none.alias("no_fiscal_date"))
    counts = [c for c in cases.columns if c != source_col]
    return cases.unionByName(blanks).groupBy(source_col).agg(*[F.sum(c).alias(c) for c in counts])


def consolidate_observed(spark: SparkSession, frames: list[DataFrame], sources: list[str], path: str, numeric_cols=(),
                         source_col: str = "SOURCE_FILE") -> DataFrame:
    """Write the master of raw frames to ``path`` and return ``ingest.ingest_report``, counted while it is written.

    The text is parsed by the stage's write, and the master's write reads the stage; no other pass counts anything.
    Rows read and blank rows are observed in the tasks that write the stage, rows written in those that write the
    master: both are final stages, whose repeated tasks count once.  What was read and is neither blank nor written
    is stale.  ``sources``: the names in ``source_col``, as the manifest lists them; a row of another one is an error.
    """
    names = dict(enumerate(dict.fromkeys(sources)))
    read, written = Observation(), Observation()

    def by_source(label: str, what: Column) -> list[Column]:
        return [F.count_if((F.col(source_col) == n) & what).alias(f"{label}{i}") for i, n in names.items()]

    every, no_date = F.lit(True), F.coalesce(F.col("DECISION_DATE"), F.col("RECEIVED_DATE")).isNull()
    stage = stage_exports(spark, frames, numeric_cols, seen=read, metrics=[
        F.count(F.lit(1)).alias("all"), *by_source("read", every), *by_source("blank", blank("CASE_NUMBER"))])
    got = dict(read.get)
    if got.get("all", 0) != sum(got.get(f"read{i}", 0) for i in names):
        drop_stage(spark, stage)
        raise ValueError(f"rows of a source that is not listed in {sorted(names.values())}")
    write_master(consolidate_stage(spark, stage), path, seen=written, metrics=by_source("written", every) + by_source("undated", no_date))
    got |= written.get
    drop_stage(spark, stage)
    rows = []
    for i, name in names.items():
        n, empty, out, undated = (got.get(f"{label}{i}", 0) for label in ("read", "blank", "written", "undated"))
        if n:
            rows.append((name, n, empty, n - empty - out, out, undated))
    return spark.createDataFrame(rows, f"{source_col} string, rows_read long, blank_rows long, stale_duplicates long, "
                                       "rows_written long, no_fiscal_date long")


def drop_stage(spark: SparkSession, stage: Stage) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {stage.table}")
    delete_path(spark, stage.path)
