"""Operator 10: exact metric range join of embeddings.

On unit vectors a cosine of c is the Euclidean distance sqrt(2 - 2c).  Every label's vectors are split by a few pivots
into cells (nearest pivot).  By the triangle inequality a vector x can lie within eps of a vector at home in another
cell p only if d(x, p) <= d(x, own pivot) + 2 eps and d(x, p) <= radius(p) + eps; to those cells it is replicated.  A
cell then joins without any other: its home vectors against its home and replicated vectors.

A cell may hold a third of all rows, so it is cut into hashed blocks of bounded rows, and each task compares one block
of home vectors with one block of the cell.  A task gives link counts per home vector and the links of a spanning
forest, never all pairs.  Equal vectors of a label are one class with a multiplicity, so copies are compared once.

Pivots are fitted on a bounded sample (PIVOT_SAMPLE rows a label, by hash; farthest-first); they steer only the work.
High-dimensional vectors without clusters replicate to most cells; results stay exact.

Cases: null labels; null, empty or zero vectors and ones with null or non-finite components are linked with nothing;
vectors of different lengths are never linked; an empty table gives no rows; repeated rows (same vec_id) are separate
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.components import components
from filingscope.llm.toolkit import cut

COSINE = 0.93
PIVOTS = 4
#: Rows a label that pivots may be chosen from.
PIVOT_SAMPLE = 256
#: Rows of a block of a cell; a task holds two.
BLOCK = 2048
#: Distances are compared with this slack; the cosine itself decides about a link.
SLACK = 1e-6


def classes(vectors: DataFrame) -> DataFrame:
    """(group, key, vector, copies): the usable distinct vectors of each label; ``group`` stands for label and length."""
    v = vectors.select("label", F.col("embedding").cast("array<double>").alias("vector")).where(
        "label is not null and vector is not null and size(vector) > 0"
        " and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(vector, x -> x != 0)")
    return (v.withColumn("group", F.xxhash64("label", F.size("vector")))
            .groupBy("group", "vector").agg(F.count("*").alias("copies"))
            .withColumn("key", F.xxhash64("group", "vector")))


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    picked = [0]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(rows)) and far.max() > SLACK:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
    return rows[picked]


def pivots_of(distinct: DataFrame, n: int = PIVOTS) -> DataFrame:
    """(group, pivots): pivots of each group as a list of unit vectors, fitted on a bounded sample a group."""
    # the smallest hashes of each group by a partially aggregated top list: two steps, so no group meets in one task
    parted = distinct.select("group", "vector", "key", F.pmod("key", F.lit(64)).alias("part"))
    first = Window.partitionBy("group", "part").orderBy("key")
    some = parted.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOT_SAMPLE // 64)

    def fit(table: pa.Table) -> pa.Table:
        rows = unit(np.array(table.column("vector").to_pylist()))
        chosen = farthest_first(rows, n)
        return pa.table({"group": table.column("group").slice(0, 1), "pivots": [chosen.tolist()]})

    return some.select("group", "vector").groupBy("group").applyInArrow(
        fit, "group long, pivots array<array<double>>")


def distances(distinct: DataFrame, pivots: DataFrame) -> DataFrame:
    """The classes with d: the distance to every pivot of their group."""

    def run(batches):
        for batch in batches:
            out = []
            for vector, pivot in zip(batch.column("vector").to_pylist(), batch.column("pivots").to_pylist(), strict=True):
                x = unit(np.array([vector]))
                out.append(np.sqrt(((np.array(pivot) - x) ** 2).sum(axis=1)).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("group", "key", "vector", "copies")] + [pa.array(out, pa.list_(pa.float64()))],
                names=["group", "key", "vector", "copies", "d"])

    return distinct.join(pivots, "group").mapInArrow(
        run, "group long, key long, vector array<double>, copies long, d array<double>")


def cells(placed: DataFrame, eps: float) -> DataFrame:
    """(group, cell, home, key, vector, copies): every class in its home cell and in those it can reach into."""
    own = placed.withColumn("least", F.array_min("d")).withColumn(
        "own", F.array_position("d", F.col("least")).cast("int") - 1)
    radius = own.groupBy("group", F.col("own").alias("cell")).agg(F.max("least").alias("radius"))
    every = own.select("group", "key", "vector", "copies", "least", "own", F.posexplode("d").alias("cell", "to"))
    return (every.where((F.col("cell") == F.col("own")) | (F.col("to") <= F.col("least") + 2 * eps + SLACK))
            .join(radius, ["group", "cell"])  # a cell without a home vector has no radius and no work
            .where((F.col("cell") == F.col("own")) | (F.col("to") <= F.col("radius") + eps + SLACK))
            .select("group", "cell", (F.col("cell") == F.col("own")).alias("home"), "key", "vector", "copies"))


def block_links(members: DataFrame, cosine: float) -> DataFrame:
    """(key, other, n): per task and home class, n = linked vectors (copies counted) and one row for each forest link."""
    sizes = members.groupBy("group", "cell").agg(F.count("*").alias("size"))
    dealt = members.join(sizes, ["group", "cell"]).withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.col("key"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    plain = ["group", "cell", "key", "vector", "copies"]
    home = dealt.where("home").select(*plain, F.lit(True).alias("query"), F.col("block").alias("i"), F.explode(each).alias("j"))
    others = dealt.select(*plain, F.lit(False).alias("query"), F.explode(each).alias("i"), F.col("block").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        query = np.asarray(table.column("query"))
        keys = table.column("key").to_numpy()
        if not query.any() or query.all():
            return pa.table({"key": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        rows = unit(np.array(table.column("vector").to_pylist()))
        copies = table.column("copies").to_numpy()
        a, b = np.flatnonzero(query), np.flatnonzero(~query)
        counts, links = np.zeros(len(a), np.int64), []
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(a), 512):
            part = a[at:at + 512]
            near = rows[part] @ rows[b].T
            i, j = np.nonzero(near >= cosine - 1e-9)
            if not len(i):
                continue
            # close calls by one fixed order of summation
            close = np.abs(near[i, j] - cosine) < 1e-9
            ok = np.ones(len(i), bool)
            ok[close] = np.einsum("ij,ij->i", rows[part[i[close]]], rows[b[j[close]]]) >= cosine
            i, j = i[ok], j[ok]
            other = keys[part[i]] != keys[b[j]]
            i, j = i[other], j[other]
            np.add.at(counts, at + i, copies[b[j]])
            for x, y in zip(keys[part[i]].tolist(), keys[b[j]].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        links = [(k, find(k), 0) for k in list(root)]
        links = [x for x in links if x[0] != x[1]] + [
            (k, k, n) for k, n in zip(keys[a].tolist(), counts.tolist(), strict=True) if n]
        cols = list(zip(*links, strict=True)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("key", "other", "n"), cols, strict=True)})

    return home.unionByName(others).groupBy("group", "cell", "i", "j").applyInArrow(compare, "key long, other long, n long")


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    eps = float(np.sqrt(2 - 2 * cosine))
    distinct = cut(classes(vectors))
    found = cut(block_links(cells(cut(distances(distinct, pivots_of(distinct))), eps), cosine))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = (distinct.select("key", "copies").join(counts, "key", "left")
             .join(roots.withColumnRenamed("node", "key"), "key", "left")
             .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "key").alias("root")))
    keyed = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).select(
        "vec_id", F.xxhash64(F.xxhash64("label", F.size("vector")), "vector").alias("key"),
        (F.col("label").isNotNull() & F.col("vector").isNotNull()).alias("whole"))
    own = keyed.withColumn("key", F.when(F.col("whole"), F.col("key"))).drop("whole").join(named, "key", "left")
    least = own.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("least"))
    return own.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
