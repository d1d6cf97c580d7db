"""Canonical names kept up to date batch by batch (E3, E4 incrementally).

A folder holds, a batch each, what a batch brought: ``counts`` (its raw names with their filings and core keys) and
``winners`` (the core keys whose canonical name it changed).  Adding up the counts gives the counts of all filings; the
last winner of a core key is its canonical name.  A batch reads the counts of its own core keys only, so the cost
follows names, not filings, and a batch that is repeated overwrites what it wrote.  Batches come in ascending order.

Labelled filings lie in ``filings``, by batch and by a hash of the core key: when a batch changes the name of some core
keys, only the folders those keys hash to are read and written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingscope.functions.names import core_key, is_all_caps, strip_ws
from filingscope.operators.distribution import stored
from filingscope.operators.entities import name_counts, spelling_counts
from filingscope.session import path_exists

COUNTS = "core string, raw_name string, is_caps boolean, n long, batch int"
WINNERS = "core string, canonical_name string, batch int"
#: Folders a batch of labelled filings is cut into.
BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows before its first batch."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _best(counts: DataFrame) -> DataFrame:
    """(core, canonical_name) by the rule of ``entities.canonical_map``."""
    total = counts.groupBy("core", "raw_name").agg(F.sum("n").alias("n"), F.min("is_caps").alias("is_caps"))
    first = F.min(F.struct((-F.col("n")).alias("neg_n"), "is_caps", "raw_name"))
    return total.groupBy("core").agg(first.getField("raw_name").alias("canonical_name"))


def winners(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(core, canonical_name) after all batches, or after those ``before`` a number: every version stays readable."""
    rows = _read(spark, f"{path}/winners", WINNERS)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("core").agg(F.max_by("canonical_name", "batch").alias("canonical_name"))


def add_spellings(spark: SparkSession, path: str, batch: int, spellings: DataFrame) -> DataFrame:
    """Add a batch's ``spelling_counts``; returns (core, canonical_name) of the core keys whose name changes."""
    named = name_counts(spellings=spellings).select(
        F.coalesce(core_key("raw_name"), F.lit("")).alias("core"), "raw_name", is_all_caps("raw_name").alias("is_caps"), "n")
    named.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")
    counts = _read(spark, f"{path}/counts", COUNTS).where(F.col("batch") <= batch)
    touched = counts.where(F.col("batch") == batch).select("core").distinct()
    now = _best(counts.join(touched, "core", "left_semi"))
    was = winners(spark, path, batch).withColumnRenamed("canonical_name", "_was")
    changed = stored(now.join(was, "core", "left").where(~F.col("canonical_name").eqNullSafe(F.col("_was"))).drop("_was"))
    changed.write.mode("overwrite").parquet(f"{path}/winners/batch={batch}")
    return changed


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(raw_name, core, canonical_name, n) after all batches, equal to ``entities.canonical_map`` of all filings."""
    counts = _read(spark, f"{path}/counts", COUNTS).groupBy("core", "raw_name").agg(F.sum("n").alias("n"))
    return counts.join(winners(spark, path), "core").select("raw_name", "core", "canonical_name", "n")


def _bucket(core: Column) -> Column:
    return F.pmod(F.xxhash64(core), F.lit(BUCKETS)).cast("int")


def _replace(rows: DataFrame, path: str) -> None:
    """Write the folders that ``rows`` has rows for; others keep their files."""
    (rows.hint("rebalance", "batch", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "bucket").parquet(f"{path}/filings"))


def relabel(spark: SparkSession, path: str, changed: DataFrame, before: int) -> list[int]:
    """Give the stored filings of earlier batches the names in ``changed``; returns the hash folders rewritten."""
    buckets = sorted(r.b for r in changed.select(_bucket(F.col("core")).alias("b")).distinct().collect())  # BUCKETS at most
    if not buckets or not path_exists(spark, f"{path}/filings"):
        return []
    rows = spark.read.parquet(f"{path}/filings").where((F.col("batch") < before) & F.col("bucket").isin(buckets))
    new = changed.select(F.col("core").alias("_core"), F.col("canonical_name").alias("_new"))
    fresh = (rows.join(new, F.col("core") == F.col("_core"), "left")
             .withColumn("CANONICAL_NAME", F.coalesce("_new", "CANONICAL_NAME")).drop("_core", "_new"))
    _replace(stored(fresh), path)
    spark.catalog.refreshByPath(f"{path}/filings")
    return buckets


def add_filings(spark: SparkSession, path: str, batch: int, filings: DataFrame, name_col: str) -> list[int]:
    """Take a batch of filings: the map first, then the stored filings it renames, then the batch's own rows.

    ``filings`` are stored with ``core`` and CANONICAL_NAME (both null without a name).  The name patterns run once a
    distinct spelling.  Returns the hash folders of earlier batches that were rewritten.
    """
    spellings = stored(spelling_counts((filings, name_col)))
    rewritten = relabel(spark, path, add_spellings(spark, path, batch, spellings), batch)
    label = (spellings.select("raw_spelling", F.coalesce(core_key(strip_ws("raw_spelling")), F.lit("")).alias("core"))
             .join(winners(spark, path), "core").withColumnRenamed("canonical_name", "CANONICAL_NAME"))
    rows = (filings.join(label, F.col(name_col) == F.col("raw_spelling"), "left").drop("raw_spelling")
            .withColumns({"batch": F.lit(batch), "bucket": _bucket(F.col("core"))}))
    _replace(rows, path)
    return rewritten


def start_labelling(filings: DataFrame, path: str, name_col: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Label a stream of filings; each micro-batch is ``add_filings`` under its own number."""
    def take(batch: DataFrame, number: int) -> None:
        add_filings(batch.sparkSession, path, number, batch, name_col)

    w = filings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
