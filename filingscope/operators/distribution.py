"""Stored exact distributions: one pass over the filings, shared by medians, quartiles, summaries, histograms and box plots.

A distribution counts a value column by group: cells (by..., value, n, counts...), written once to the shared checkpoint
folder.  Rows without a value are one cell of their group, so a group's plain counts come from the same cells.
Equal values are one row whatever their number; cells of two batches add up (``merge``), so a stored
distribution can follow its table.  Nothing below reads the filings again.

Exact quantiles never hold an unbounded group in one task.  A group of at most ``SMALL`` cells takes Spark's counted
percentile in the same pass as its totals.  For others a bucket is a fixed, order-preserving function of the value
(1/256 octave), bucket totals give each bucket's first rank, and only the buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filingscope.functions.wages import round_half_up
from filingscope.operators.quantiles import ranked
from filingscope.session import ensure_checkpoint_dir

VALUE, N = "_v", "_n"
#: Cells of a group whose quantiles one task may take.
SMALL = 250_000


@dataclass(frozen=True)
class Distribution:
    """``cells``: (by..., _v, _n, counts...); ``_v`` is null for rows without a value, ``counts`` are sums of conditions."""
    cells: DataFrame
    by: tuple[str, ...]
    counts: tuple[str, ...] = ()
    size: int | None = None  # number of cells, where known

    def _sums(self) -> list[Column]:
        return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (N, *self.counts)]

    def totals(self) -> DataFrame:
        """(by..., _n, counts...) of whole groups; one row without ``by``, also for an empty table."""
        return (self.cells.groupBy(*self.by) if self.by else self.cells).agg(*self._sums())

    def _few(self) -> bool:
        return self.size is not None and self.size <= SMALL

    def quantiles(self, probs: Mapping[str, float]) -> DataFrame:
        """(by..., one column per quantile) of every group that has a value; ranks between two values are weighted."""
        by = list(self.by) or ["_one"]
        have = self.cells.where(F.col(VALUE).isNotNull())
        have = (have if self.by else have.withColumn("_one", F.lit(1))).select(*by, VALUE, N)
        if self._few():
            return counted_percentiles(have.groupBy(*by), [], probs).select(*by, *probs)
        large = stored(have.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells")).where(F.col("_cells") > SMALL).select(*by))
        if large.isEmpty():
            return counted_percentiles(have.groupBy(*by), [], probs).select(*by, *probs)
        small = counted_percentiles(have.join(large, by, "left_anti").groupBy(*by), [], probs)
        return small.select(*by, *probs).unionByName(ranked(have.join(large, by, "left_semi"), by, dict(probs)))

    def summary(self, probs: Mapping[str, float]) -> DataFrame:
        """``totals`` with the quantiles (null for a group without values)."""
        if self._few():
            shown = [*self.by, N, *self.counts, *probs]
            return counted_percentiles(self.cells.groupBy(*self.by) if self.by else self.cells, self._sums(), probs).select(*shown)
        if self.by:
            return self.totals().join(self.quantiles(probs), list(self.by), "left")
        return self.totals().withColumn("_one", F.lit(1)).join(F.broadcast(self.quantiles(probs)), "_one", "left").drop("_one")

    def merge(self, other: Distribution) -> Distribution:
        """The distribution of both tables' rows."""
        if (self.by, self.counts) != (other.by, other.counts):
            raise ValueError("distributions of different groups or counts don't add up")
        both = self.cells.unionByName(other.cells).groupBy(*self.by, VALUE).agg(
            *[F.sum(c).cast("long").alias(c) for c in (N, *self.counts)])
        return kept(both, self.by, self.counts)

    def describe(self) -> DataFrame:
        """(by..., count, mean, std, min, p25, p50, p75, max) of the groups that have values; one row without ``by``."""
        have = self.cells.where(F.col(VALUE).isNotNull())
        v, n, by = F.col(VALUE), F.col(N), list(self.by)
        whole = (have.groupBy(*by) if by else have).agg(
            F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("count"), (F.sum(v * n) / F.sum(n)).alias("_mean"),
            F.min(v).alias("min"), F.max(v).alias("max"))
        # squares of distances from the mean: their sum keeps its digits
        if by:
            spread = have.join(whole.select(*by, "_mean"), by).groupBy(*by)
        else:
            mean = whole.first()["_mean"]
            spread = have.withColumn("_mean", F.lit(mean).cast("double"))
        spread = spread.agg(F.sqrt(F.try_divide(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))), F.sum(n) - 1)).alias("_std"))
        quarts = self.quantiles({"p25": 0.25, "p50": 0.5, "p75": 0.75})
        if not by:
            whole, spread = whole.withColumn("_one", F.lit(1)), spread.withColumn("_one", F.lit(1))
        keys = by or ["_one"]
        return whole.join(spread, keys).join(quarts, keys, "left").select(
            *by, "count", round_half_up("_mean", 4).alias("mean"), round_half_up("_std", 4).alias("std"), "min", "p25", "p50", "p75", "max")

    def histogram(self, bins: int, log10: bool = False, lo: float | None = None, hi: float | None = None) -> DataFrame:
        """Equal-width bins between the least and the largest value (the last one closed), 0-filled, over all groups.

        ``lo`` and ``hi`` leave out values at or beyond them; ``log10`` lays the bins over the logarithms.
        No rows without a value.
        """
        x = F.col(VALUE)
        have = self.cells.where(x.isNotNull())
        have = have if lo is None else have.where(x > lo)
        have = have if hi is None else have.where(x < hi)
        have = have.select((F.log10(x) if log10 else x).alias("v"), N)
        ends = have.agg(F.min("v"), F.max("v")).first()  # two numbers
        least, most = ends[0], ends[1]
        if least is None:
            return self.cells.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, filings long")
        width = most - least
        place = F.floor((F.col("v") - F.lit(least)) * F.lit(float(bins) / width if width else 0.0)) + 1
        counts = have.groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.sum(N).alias("filings"))
        every = self.cells.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
        edge = lambda i: round_half_up(F.lit(least) + F.lit(width) * i / bins, 4)
        return every.join(counts, "bin", "left").select(
            "bin", edge(F.col("bin") - 1).alias("bin_lo"), edge(F.col("bin")).alias("bin_hi"),
            F.coalesce("filings", F.lit(0)).cast("long").alias("filings"))

    def box(self, whisker: float = 1.5) -> DataFrame:
        """(by..., q1, median, q3, iqr, whisker_low, whisker_high, outliers): whiskers are the last values inside the fences."""
        by, v = list(self.by), F.col(VALUE)
        q = self.quantiles({"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
        inside = (v >= F.col("q1") - whisker * F.col("iqr")) & (v <= F.col("q3") + whisker * F.col("iqr"))
        return self.cells.where(v.isNotNull()).join(q, by).groupBy(*by, "q1", "median", "q3", "iqr").agg(
            F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col(N))), F.lit(0)).cast("long").alias("outliers"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(cells: DataFrame, by: tuple[str, ...], counts: tuple[str, ...]) -> Distribution:
    """Store the cells; their number is observed on the way."""
    seen = Observation()
    frame = stored(cells.observe(seen, F.count(F.lit(1)).alias("cells")))
    return Distribution(frame, by, counts, seen.get.get("cells"))  # nothing is observed where the plan is known to be empty


def counted_percentiles(grouped, sums: list[Column], probs: Mapping[str, float]) -> DataFrame:
    """``grouped.agg`` of the sums and of all quantiles of the counted values, in one pass."""
    name = list(probs)
    at = F.percentile(F.col(VALUE), [float(probs[p]) for p in name], F.col(N)).alias("_at")
    return grouped.agg(*sums, at).withColumns({p: F.col("_at")[i] for i, p in enumerate(name)}).drop("_at")


def value_of(col: str | Column) -> Column:
    """A numeric column as the cells hold it: not-a-number counts as no value."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(value), value)


def distribution(df: DataFrame, by: list[str], value: str | Column, counts: Mapping[str, Column] | None = None) -> Distribution:
    """One pass over ``df``.  Rows with a null group key are left out; ``counts``: conditions whose true rows are counted."""
    for key in by:
        df = df.where(F.col(key).isNotNull())
    counts = dict(counts or {})
    cells = df.groupBy(*by, value_of(value).alias(VALUE)).agg(
        F.count(F.lit(1)).alias(N), *[F.count_if(c).alias(name) for name, c in counts.items()])
    return kept(cells, tuple(by), tuple(counts))
