"""Connected components of links between 64-bit nodes, as Spark jobs over link tables that shrink or stay equal.

Alternating large-star and small-star steps: every link moves towards the smallest node of its neighbourhood, so paths
halve each round and no node gathers its neighbours in one task (a partially aggregated minimum and joins only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import cut, release


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node reachable.

    Self links and repeats are allowed; null ends are dropped; no links give no rows.
    """
    edges = cut(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: each node's larger neighbours link to its smallest neighbour (itself included)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        last = edges
        edges = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: each node and its smaller neighbours link to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(edges.join(least, "u")
                    .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                    .select("e.*").where("u > v").distinct())
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
