"""Exact quantiles (linear interpolation) without holding a group's values in one task.

1. Values are counted by (group, value), so equal values are one row and a
   giant group is spread over all tasks.
2. A bucket is a fixed, order-preserving function of the value (1/256 octave),
   so no sampling is needed; bucket totals give each bucket's first rank.
3. Only the buckets that hold a wanted rank are sorted by value.

The window of step 2 sees at most one row per bucket of a group, the one of
step 3 the distinct values of a single bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 256


def bucket_of(value: Column) -> Column:
    """A long that never falls as the value grows."""
    size = F.floor(F.log2(F.abs(value) + 1) * STEPS)
    return F.when(value < 0, -size - 1).otherwise(size).cast("long")


def ranked(counts: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """(by..., one column per quantile) from counted values (by..., _v, _n).

    ``by`` columns are taken to be not null.  The position is (n - 1) * p; between
    two ranks the values are weighted by their distance to it.
    """
    counts = counts.withColumn("_b", bucket_of(F.col("_v")))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    buckets = (counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_size"))
               .withColumn("_first", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
               .withColumn("_all", F.sum("_size").over(whole)))
    position = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = F.array_distinct(F.array(*[r.cast("long") for p in position.values() for r in (F.floor(p), F.ceil(p))]))
    wanted = F.filter(ranks, lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_size")))
    chosen = buckets.withColumn("_ranks", wanted).where(F.size("_ranks") > 0)
    below = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = (counts.join(chosen, [*by, "_b"])
              .withColumn("_from", F.col("_first") + F.coalesce(F.sum("_n").over(below), F.lit(0))))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    found = placed.select(*by, "_v", "_all", F.explode(hit).alias("_rank"))
    at = (found.groupBy(*by, "_all")
          .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")))  # two entries a quantile
    out = []
    for name, p in position.items():
        lo, hi = F.floor(p).cast("long"), F.ceil(p).cast("long")
        low, high = F.col("_at")[lo], F.col("_at")[hi]
        out.append(F.when(lo == hi, low).otherwise((hi - p) * low + (p - lo) * high).alias(name))
    return at.select(*by, *out)


def quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """(by..., one column per quantile) of the rows of ``df``, for every group that has a non-null value."""
    counts = (df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
              .groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    return ranked(counts, by, probs)
