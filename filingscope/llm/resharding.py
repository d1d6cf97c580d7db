"""Operator 8: minimum-cost-flow resharding.

Rows lie in old shards.  Every shard's rows form blocks by size class (quarter octaves), so a block's rows cost about
the same to move.  A flow network (blocks -> own shard at no cost, or -> a hub at the block's mean bytes a row -> any
shard; every shard takes its share of rows) is solved for the least bytes moved on the driver: its size depends on the
numbers of shards and size classes alone, never on rows.  The solution says how many rows of a block leave; the hub's
flow is dealt to the shards with room.  Rows then find their place by their rank in the block, which comes from counts
of sub-blocks of about SUB_BLOCK rows (hashed, so one hot block is many sub-blocks), and moved rows are written anew.

Law ``rows``: the new shards' row counts are at most one apart.

Cases: null text counts as 0 bytes; empty table gives no rows; repeated rows (and null ids) are separate rows; hot
sizes or sources only make more sub-blocks; columns named as the results are replaced.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.toolkit import cut

SUB_BLOCK = 10_000
OVERHEAD = 16
RESULT = ("size", "old_shard", "shard", "slot")


def min_cost_flow(arcs: list[tuple[str, str, int, float]], source, sink) -> dict[tuple, int]:
    """Flow on each arc (from, to, capacity, cost) of a largest flow of least cost (shortest augmenting paths)."""
    head, cap, cost, out = [], [], [], defaultdict(list)
    for u, v, c, w in arcs:
        for a, b, k, x in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(head))
            head.append(b)
            cap.append(k)
            cost.append(x)
    potential: dict = defaultdict(float)
    while True:
        best, via, heap, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in out[u]:
                if cap[e] > 0:
                    v = head[e]
                    x = d + max(0.0, cost[e] + potential[u] - potential[v])
                    if v not in best or x < best[v] - 1e-9:
                        best[v], via[v] = x, e
                        n += 1
                        heapq.heappush(heap, (x, n, v))
        if sink not in best:
            break
        far = best[sink]
        for u in set(out):
            potential[u] += min(best.get(u, far), far)
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        step = min(cap[e] for e in path)
        for e in path:
            cap[e] -= step
            cap[e ^ 1] += step
    return {(u, v, i): cap[2 * i + 1] for i, (u, v, _, _) in enumerate(arcs)}


def plan_moves(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple]:
    """Pieces (old_shard, block, rank_from, rank_to, new_shard, slot_from) that cover every row once.

    ``blocks``: (old_shard, block, rows, bytes).  Old shards beyond the new number are emptied.
    """
    total = sum(b[2] for b in blocks)
    low, extra = divmod(total, shards)
    dear = 1.0 + 4 * max([b[3] / b[2] for b in blocks], default=1.0)
    arcs = []
    for s, k, rows, size in blocks:
        arcs.append(("in", ("block", s, k), rows, 0.0))
        if s < shards:
            arcs.append((("block", s, k), ("shard", s), rows, 0.0))
        arcs.append((("block", s, k), "hub", rows, size / rows))
    for s in range(shards):
        arcs.append(("hub", ("shard", s), low + 1, 0.0))
        arcs.append((("shard", s), "out", low, 0.0))
        if extra:
            arcs.append((("shard", s), "out", 1, dear))  # only what the even share can't hold
    flow = min_cost_flow(arcs, "in", "out")
    stay = {u[1:]: f for (u, v, _), f in flow.items() if u[0] == "block" and v != "hub"}
    room = [[s, flow_in] for (u, v, _), flow_in in flow.items() if u == "hub" for s in [v[1]] if flow_in]
    pieces, slot = [], defaultdict(int)
    for s, k, rows, _ in sorted(blocks):
        kept = stay.get((s, k), 0)
        if kept:
            pieces.append((s, k, 0, kept, s, slot[s]))
            slot[s] += kept
    for s, k, rows, _ in sorted(blocks):
        at = stay.get((s, k), 0)
        while at < rows:
            to = room[-1]
            n = min(to[1], rows - at)
            pieces.append((s, k, at, at + n, to[0], slot[to[0]]))
            slot[to[0]] += n
            at += n
            to[1] -= n
            if not to[1]:
                room.pop()
    return pieces


def reshard(rows: DataFrame, old_shard: Column, size: Column, shards: int, order: Column) -> DataFrame:
    """All columns of ``rows`` with size, old_shard, shard and slot (gapless from 0 in each shard).

    ``old_shard``: a small integer; ``order``: deals rows of one block to its sub-blocks.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"size": size, "old_shard": old_shard.cast("int")}).drop("shard", "slot")
    sized = rows.withColumn(
        "_block", F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int"))
    about = [(r[0], r[1], r[2], r[3]) for r in
             sized.groupBy("old_shard", "_block").agg(F.count("*"), F.sum("size")).collect()]  # shards x size classes
    parts = spark.createDataFrame([(s, k, -(-n // SUB_BLOCK)) for s, k, n, _ in about],
                                  "old_shard int, _block int, _parts long")
    placed = sized.join(F.broadcast(parts), ["old_shard", "_block"]).withColumn(
        "_part", F.pmod(F.xxhash64(order), F.col("_parts")))
    key = ["old_shard", "_block", "_part"]
    before = Window.partitionBy("old_shard", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(placed.groupBy(*key).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
                 .drop("count"))
    ranked = (placed.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order, "size")) - 1)
              .join(starts, key).withColumn("_rank", F.col("_start") + F.col("_nth")))
    pieces = spark.createDataFrame(
        plan_moves(about, shards), "old_shard int, _block int, _from long, _to long, shard int, _slot long")
    return (ranked.join(F.broadcast(pieces), ["old_shard", "_block"]).where("_rank >= _from and _rank < _to")
            .withColumn("slot", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long"))
            .select(*[c for c in rows.columns if c not in RESULT], *RESULT))


def rewrite(resharded: DataFrame, path: str) -> DataFrame:
    """Write the shards that gained or lost rows as Parquet under ``path``/shard=N; returns the touched shard numbers."""
    moved = resharded.where("shard != old_shard")
    touched = moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    rows = resharded.join(F.broadcast(touched), "shard", "left_semi")  # as many rows as there are shards at most
    rows.repartition("shard", F.floor(F.col("slot") / SUB_BLOCK)).sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    return touched
