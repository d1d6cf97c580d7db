"""Master table sink and loaders (S3-S5).

The master is Parquet partitioned by fiscal year and quarter, so period
filters prune whole folders and column selections prune column chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filingscope.operators.ingest import coerce_iso_date, coerce_numeric, latest_source_wins
from filingscope.session import delete_path, discard, landed, setting, sweep
from filingscope.spec import FilingsSpec

# Numeric columns coerced on load, per dataset.
LCA_NUMERIC = ("WAGE_RATE_OF_PAY_FROM", "WAGE_RATE_OF_PAY_TO", "PREVAILING_WAGE", "TOTAL_WORKER_POSITIONS")
PERM_NUMERIC = ("JOB_OPP_WAGE_FROM", "JOB_OPP_WAGE_TO", "EMP_NUM_PAYROLL", "EMP_YEAR_COMMENCED")
DATE_COLS = ("RECEIVED_DATE", "DECISION_DATE")


PERIOD = ("FISCAL_YEAR", "FISCAL_QUARTER")
#: Spark's folder name of a null partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_master(df: DataFrame, path: str, mode: str = "overwrite", seen: Observation | None = None,
                 metrics: list[Column] | None = None, rebalance: bool = True) -> None:
    """Partitioned Parquet, clustered by period before the write.

    Rows are rebalanced by period: adaptive execution splits a large quarter over many tasks and puts small ones
    together, from the sizes of the shuffle itself (no sampling pass over ``df``).  Without ``rebalance`` no row moves
    and each task writes a file a period, for a ``df`` that is read from large files.  ``seen`` observes ``metrics`` of
    the rows in the tasks that write them.
    """
    df = df.hint("rebalance", *PERIOD) if rebalance else df
    df = df if seen is None else df.observe(seen, *metrics)
    if rebalance:
        df.write.mode(mode).partitionBy(*PERIOD).parquet(path)
    else:
        write_unmoved(df, path, mode)


#: Files that a task of ``write_unmoved`` holds open, a period each; rows of further periods are sorted first.
OPEN_PERIODS = 128


def write_unmoved(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write each row from the task that has it, a file a period and task, without sorting the task's rows by period.

    Only periods that ``df`` has are replaced where ``mode`` is ``periods``.  They are, when all rows have been written
    aside, so ``df`` may read the same folder.
    """
    whole = mode != "periods"
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_PERIODS)):
        (df.write.mode(mode if whole else "overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
         .partitionBy(*PERIOD).parquet(path))
    sweep(df.sparkSession)


#: Rows of a file that one mark stands for: 64 words of 64 bits.
BLOCK = 4096
#: Marks (0.6 KB each) that are sent to every task; more of them meet the rows in an ordinary join.
MAX_MARKS = 200_000


def placed(rows: DataFrame) -> DataFrame:
    """Rows read from Parquet files with their place: ``_file``, a 64-bit hash of the file's path, and ``_at``, their number in it."""
    return rows.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_at": F.col("_metadata.row_index")})


def marks_of(places: DataFrame) -> DataFrame:
    """Places (_file, _at) as bits, stored: (_file, _block, _words), a row a block of a file that has any."""
    dealt = places.select(
        "_file", F.expr(f"_at div {BLOCK}").alias("_block"), F.expr(f"cast(_at % {BLOCK} div 64 as int)").alias("_word"),
        F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_bit")).repartition("_file", "_block")
    words = dealt.groupBy("_file", "_block", "_word").agg(F.bit_or("_bit").alias("_bits"))
    held = words.groupBy("_file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.col("_held")[i], F.lit(0)))
    return landed(held.select("_file", "_block", every.alias("_words")), "marks")


def rows_at(rows: DataFrame, marks: DataFrame, there: bool = True) -> DataFrame:
    """The rows at marked places of their files, or all others; the rows stay where they are read.

    One bit a row goes to every task, up to ``MAX_MARKS`` blocks; beyond, rows and marks are joined as the planner decides.
    """
    few = marks.count() <= MAX_MARKS
    at = placed(rows).withColumn("_block", F.expr(f"_at div {BLOCK}"))
    at = at.join(F.broadcast(marks) if few else marks, ["_file", "_block"], "inner" if there else "left")
    bit = F.expr(f"getbit(_words[cast(_at % {BLOCK} div 64 as int)], cast(_at % 64 as int)) = 1")
    return at.where(bit if there else ~F.coalesce(bit, F.lit(False))).select(*rows.columns)


def newest_rows(new: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD", here: bool = False) -> DataFrame:
    """``latest_source_wins`` of an export, stored.  Where all its rows have one order there is nothing to choose.

    ``here``: ``new`` is read from the caller's stored files; it is not written again where it stays as it is.
    """
    new = new if here else landed(new, "export")
    least, most, known, every = new.agg(F.min(order_col), F.max(order_col), F.count(order_col), F.count(F.lit(1))).first()
    one = known == 0 or (least == most and known == every)
    if one:
        return new
    won = landed(latest_source_wins(new, key, order_col), "export")
    if not here:
        discard(new)
    return won


def stale_marks(rows: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD") -> DataFrame:
    """``marks_of`` the stored rows that ``latest_source_wins`` leaves out; only cases, orders and places are moved.

    The join on the case is one that adaptive execution can split, so a case may have any share of the rows.
    """
    newest = rows.groupBy(F.col(key).alias("_case")).agg(F.max(order_col).alias("_newest"))
    old = F.col(key).eqNullSafe(F.col("_case")) & ~F.col(order_col).eqNullSafe(F.col("_newest"))
    return marks_of(placed(rows.select(key, order_col)).join(newest, old))


def known_rows(master: DataFrame, newest: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD") -> DataFrame:
    """The stored rows of an export's cases with ``_new`` and their place, stored: four columns of the master, no whole row.

    ``master`` is read from its files; ``newest``: (_case, _new).
    """
    rows = placed(master.select(key, order_col, *PERIOD))
    return landed(rows.join(newest, F.col(key).eqNullSafe(F.col("_case"))).drop("_case"), "known")


def superseded(known: DataFrame, order_col: str = "SOURCE_ORD") -> DataFrame:
    """The known rows that the export replaces."""
    return known.where(F.col(order_col) <= F.col("_new"))


def fresh_rows(new: DataFrame, known: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD") -> DataFrame:
    """The rows of ``new`` that no later source has; without such a source nothing is joined."""
    later = known.where(F.col(order_col) > F.col("_new")).select(F.col(key).alias("_late")).distinct()
    return new if later.isEmpty() else new.join(later, F.col(key).eqNullSafe(F.col("_late")), "left_anti")


def newest_of(new: DataFrame, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD") -> DataFrame:
    """(_case, _new) of an export."""
    return new.groupBy(F.col(key).alias("_case")).agg(F.max(order_col).alias("_new"))


def refresh_master(spark: SparkSession, new: DataFrame, path: str, key: str = "CASE_NUMBER", order_col: str = "SOURCE_ORD",
                   known: DataFrame | None = None, marks: DataFrame | None = None) -> list[tuple[int | None, int | None]]:
    """Take a new export's cleaned rows into the stored master; returns the periods that were replaced.

    Per case the newest source wins, as in a full consolidation: stored rows of an older source go, wherever they are,
    and new rows older than the stored ones stay out.  Only periods that gain or lose rows are read whole and
    written; other folders keep their files.  Stored rows of the same source are replaced, so an export that is
    delivered again changes nothing; ``new`` holds all rows that its source has for a case.

    Cases are compared on four columns.  What goes is known by its place, so whole rows are read, left out or written
    without being moved.  The new content is written aside first, then replaces the periods; after a failure in between,
    the same call brings the master to the same state.  ``known``: ``known_rows`` where a caller has them, with ``new``
    from ``newest_rows`` and maybe the ``marks`` of the superseded rows; all are the caller's to discard.
    """
    master = spark.read.option("mergeSchema", True).parquet(path)
    own = known is None
    if own:
        new = newest_rows(new, key, order_col)
        known = known_rows(master, newest_of(new, key, order_col), key, order_col)
    fresh, gone = fresh_rows(new, known, key, order_col), superseded(known, order_col)
    lost = {tuple(r[:2]): r[2] for r in gone.groupBy(*PERIOD).count().collect()}  # a row a quarter
    gained = {tuple(r) for r in fresh.select(*PERIOD).distinct().collect()}
    periods = lost.keys() | gained
    if periods:
        year, quarter = (F.col(c) for c in PERIOD)

        def rows_of(wanted) -> DataFrame:
            return master.where(reduce(or_, [year.eqNullSafe(F.lit(y)) & quarter.eqNullSafe(F.lit(q)) for y, q in wanted]))

        alone = lost.keys() - gained  # may lose its last rows, and then nothing would replace it
        left = {tuple(r[:2]): r[2] for r in rows_of(alone).groupBy(*PERIOD).count().collect()} if alone else {}
        out = marks_of(gone) if marks is None else marks
        write_unmoved(rows_at(rows_of(periods), out, there=False).unionByName(fresh, allowMissingColumns=True), path, "periods")
        if marks is None:
            discard(out)
        for y, q in (p for p in alone if left[p] == lost[p]):
            delete_path(spark, f"{path}/FISCAL_YEAR={NULL_FOLDER if y is None else y}/FISCAL_QUARTER={NULL_FOLDER if q is None else q}")
        spark.catalog.refreshByPath(path)
    if own:
        discard(known)
        discard(new)
    return sorted(periods, key=str)


def read_master(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_filings(spark: SparkSession, path: str, spec: FilingsSpec, columns=None) -> DataFrame:
    """Scan (with projection) + numeric and date coercion; bad values become null."""
    df = read_master(spark, path, columns)
    numeric = LCA_NUMERIC if spec.name == "lca" else PERM_NUMERIC
    df = coerce_numeric(df, [c for c in numeric if dict(df.dtypes).get(c) == "string"])
    return coerce_iso_date(df, [c for c in DATE_COLS if dict(df.dtypes).get(c) == "string"])
