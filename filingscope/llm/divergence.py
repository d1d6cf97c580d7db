"""Operator 12: audit of how sources differ from each other, from single-pass inverted indexes.

Each worker reads its texts once into block postings, term -> (lang, source) -> occurrences and documents.  When the
block holds ``HELD`` postings, it is written as term-sorted runs, one a hash shard, and emptied.  The runs of a shard are
heap-merged, at most about ``FAN_IN`` at once and in as many rounds as that takes, into the frequencies of its terms.

Of all pairs of sources of a language, nearly all terms are missing from both or in one only.  A pair's sum is therefore
taken as if no source shared a term (from the numbers of a source's terms with equal counts), and the merged
postings are streamed once for what the shared terms add to or take from that.  Sources meet in blocks of ``BLOCK``, so a
worker's matrix is bounded however many sources a language has.

All arithmetic is on whole numbers.  p = 1 + floor(SCALE * (n + 1) / (N + V)); divergence of p from q: floor((p-q)^2 / q).

Cases: null text, lang and source count as empty; each row is a document, repeated or not; a group without terms
takes part with its smoothed shares; a language without kept terms gives pairs of value 0 and no terms; an empty
table gives no rows; equal values are ranked by the item in UTF-8 order; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.toolkit import cut, slices

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Postings of a block in a worker's memory; runs merged at once; hash shards at least; sources of a matrix side.
HELD, FAN_IN, SHARDS, BLOCK = 600_000, 64, 64, 256
#: Parts of a language's terms in the stream of corrections, and groups that are broadcast at most.
PARTS, SMALL = 64, 100_000
#: A posting adds up occurrences and documents in one number.
ONE_DOC = 1 << 44
RUN = "shard int, run long, postings long, body binary"


def packed(terms: list[bytes], ends: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray, groups: list) -> bytes:
    """A run: sorted terms, each with the postings (group, n, docs) up to its place in ``ends``; ``group`` counts in ``groups``."""
    used = np.unique(group)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.searchsorted(used, group).astype(np.int32), n, docs)]
    batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *lists], names=["term", "group", "n", "docs"])
    batch = batch.replace_schema_metadata({"groups": json.dumps([groups[i] for i in used.tolist()])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def merged(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """All runs as one: (terms in order, term index, group, n, docs of each posting in order, groups).

    A heap merges the runs' sorted terms; each term's place in the merged order deals its postings out.
    """
    groups: dict[tuple[str, str], int] = {}
    heads, parts = [], []
    for body in bodies:
        batch = pa.ipc.open_stream(body).read_next_batch()
        own = np.array([groups.setdefault(tuple(g), len(groups)) for g in json.loads(batch.schema.metadata[b"groups"])], np.int64)
        heads.append(batch.column("term").to_pylist())
        lists = [batch.column(c) for c in ("group", "n", "docs")]
        parts.append((np.diff(np.asarray(lists[0].offsets)), own[np.asarray(lists[0].values)], *(np.asarray(x.values) for x in lists[1:])))
    places: list[list[int]] = [[] for _ in bodies]
    terms: list[bytes] = []
    last, at = None, -1
    for term, run in heapq.merge(*(zip(h, repeat(r)) for r, h in enumerate(heads))):
        if term != last:
            at, last = at + 1, term
            terms.append(term)
        places[run].append(at)
    key = np.concatenate([np.repeat(np.array(x, np.int64), sizes) * len(groups) + group for x, (sizes, group, _, _) in zip(places, parts, strict=True)])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, docs = (np.add.reduceat(np.concatenate([x[i] for x in parts])[order], first) for i in (2, 3))
    return terms, key[first] // len(groups), key[first] % len(groups), n, docs, list(groups)


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """Runs of all texts.  A group's own mark is the empty term, so groups without terms are known too."""
    def run(batches):
        import pyarrow.compute as pc

        block: dict[tuple[str, str], dict[bytes, int]] = {}
        held = spilled = 0
        task = TaskContext.get().partitionId()

        def spill():
            groups = list(block)
            coded = pa.array(chain.from_iterable(block.values()), pa.binary()).dictionary_encode()
            values = np.fromiter(chain.from_iterable(x.values() for x in block.values()), np.int64, len(coded))
            group = np.repeat(np.arange(len(groups)), [len(x) for x in block.values()])
            block.clear()
            order = np.asarray(pc.sort_indices(coded.dictionary))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            terms = coded.dictionary.take(pa.array(order)).to_pylist()
            shard = np.array([crc32(t) % shards for t in terms], np.int64)
            at = place[np.asarray(coded.indices)]
            order = np.lexsort((group, at, shard[at]))
            at, group, values = at[order], group[order], values[order]
            edges = np.flatnonzero(np.diff(shard[at], prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(at)]):
                ends = np.flatnonzero(np.diff(at[i:j], append=-1)) + 1
                own = [terms[x] for x in at[i:j][ends - 1].tolist()]
                yield int(shard[at[i]]), (task << 24) + spilled, j - i, packed(
                    own, ends, group[i:j], values[i:j] % ONE_DOC, values[i:j] // ONE_DOC, groups)

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, body in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    terms = block.setdefault((lang, source), {b"": 0})
                    held -= len(terms)
                    have = terms.get
                    for term, n in Counter(TERM.findall(body.translate(LOWER))).items():
                        terms[term] = have(term, 0) + n + ONE_DOC
                    held += len(terms)
                    if held >= HELD:
                        yield from batches_of(spill())
                        held, spilled = 0, spilled + 1
        if block:
            yield from batches_of(spill())
        pa.default_memory_pool().release_unused()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text)
    return rows.mapInArrow(run, RUN)


def batches_of(rows, size: int = 64):
    """Runs as Arrow batches of a few rows."""
    schema = pa.schema([("shard", pa.int32()), ("run", pa.int64()), ("postings", pa.int64()), ("body", pa.binary())])
    held = []
    for r in rows:
        held.append(dict(zip(schema.names, r, strict=True)))
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, posts): occurrences by source of every term in ``LEAST_DOCS`` documents of a language.

    The empty term has every source of a language, with 0 occurrences.
    """
    shards = max(SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    have = cut(runs(docs, shards))
    while True:
        count = have.select("run").distinct().count()
        if count <= FAN_IN:
            break
        # about FAN_IN runs meet in a new one; each shard's part of a run stays apart
        bundle = F.pmod(F.xxhash64("run"), F.lit(-(-count // FAN_IN) if count > 2 * FAN_IN else 1))
        have = cut(have.withColumn("bundle", bundle).groupBy("shard", "bundle").applyInArrow(joined, RUN))
    return cut(have.groupBy("shard").applyInArrow(kept, "lang string, term string, posts array<struct<source: string, n: long>>"))


def joined(table: pa.Table) -> pa.Table:
    """One run of the given ones of a shard."""
    terms, at, group, n, docs, groups = merged(table.column("body").to_pylist())
    bundle, shard = table.column("bundle")[0].as_py(), table.column("shard")[0].as_py()
    ends = np.flatnonzero(np.diff(at, append=-1)) + 1
    return pa.Table.from_batches(list(batches_of([(shard, bundle, len(at), packed(terms, ends, group, n, docs, groups))])))


def kept(table: pa.Table) -> pa.Table:
    """Terms of a shard with enough documents of a language."""
    terms, at, group, n, docs, groups = merged(table.column("body").to_pylist())
    langs = sorted({g[0] for g in groups})
    lang = np.array([langs.index(g[0]) for g in groups])[group]
    order = np.lexsort((group, lang, at))
    at, group, n, docs, lang = (x[order] for x in (at, group, n, docs, lang))
    first = np.flatnonzero(np.diff(at * len(langs) + lang, prepend=-1))
    sizes = np.diff(np.append(first, len(at)))
    good = np.add.reduceat(docs, first) >= LEAST_DOCS
    good |= np.array([not t for t in terms])[at[first]]
    post = np.repeat(good, sizes)
    source = pa.array([g[1] for g in groups], pa.string()).take(pa.array(group[post]))
    posts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[good])), pa.int32()),
                                     pa.StructArray.from_arrays([source, pa.array(n[post])], ["source", "n"]))
    return pa.table([pa.array(langs, pa.string()).take(pa.array(lang[first][good])),
                     pa.array(terms, pa.binary()).take(pa.array(at[first][good])).cast(pa.string()), posts], names=["lang", "term", "posts"])


def share(n: Column, whole: Column) -> Column:
    """p of n occurrences; ``whole`` = N + V."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), whole.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to all others of its language, and its own terms."""
    table = frequencies(docs)
    posts = table.select("lang", "term", F.explode("posts").alias("x"), F.aggregate(
        "posts", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("total")).select("lang", "term", "total", "x.*")
    groups = posts.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.sum((F.col("term") != "").cast("long")).alias("own"))
    langs = table.groupBy("lang").agg(
        F.sum((F.col("term") != "").cast("long")).alias("v"),
        F.sum(F.aggregate("posts", F.lit(0).cast("long"), lambda t, x: t + x["n"])).alias("all"),
        F.max(F.when(F.col("term") == "", F.size("posts"))).alias("sources"))
    # N + V and the p of a term without occurrences, by group; few rows beside the postings
    groups = cut(groups.join(langs, "lang").select(
        "lang", "source", "own", "v", "sources", (F.col("whole") + F.col("v")).alias("whole"), (F.col("all") + F.col("v")).alias("all"))
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("whole"))))
        .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    known = F.broadcast(groups) if groups.count() <= SMALL else groups
    shares = posts.where(F.col("term") != "").join(known, ["lang", "source"]).select(
        "lang", "source", "number", "term", "sources", "p0", share(F.col("n"), F.col("whole")).alias("p"),
        F.when(F.col("n") > 0, share(F.col("total"), F.col("all"))).alias("q"))

    terms = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    # a hot source's terms are ranked in parts first, so no task sorts them all
    terms = terms.withColumn("part", F.pmod(F.crc32(F.col("item").cast("binary")), F.lit(PARTS)))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("rank") <= TOP)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= TOP)

    pairs = distances(groups, known, shares).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return terms.withColumn("part", F.lit("term")).select(*shown).unionByName(pairs.withColumn("part", F.lit("pair")).select(*shown))


def distances(groups: DataFrame, known: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of different sources of a language."""
    mine = groups.select("lang", "source", "number", "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("p0").alias("q0"))
    if known is not groups:
        other = F.broadcast(other)
    p, p0, q0, n = map(F.col, ("p", "p0", "q0", "n"))
    zero, differ = F.lit(0).cast("long"), F.col("number") != F.col("other")
    # all terms as if in neither, then a source's own terms as if the other had none of them, either way round
    neither = mine.join(other, "lang").where(differ).select(
        "lang", "number", "other", F.when(F.col("v") > 0, F.col("v") * apart(p0, q0)).otherwise(zero).alias("value"))
    equal = cut(shares.groupBy("lang", "number", "p0", "p").agg(F.count("*").alias("n")))
    one = equal.join(other, "lang").where(differ)
    one = one.select("lang", F.explode(F.array(
        F.struct("number", "other", (n * (apart(p, q0) - apart(p0, q0))).alias("value")),
        F.struct(F.col("other").alias("number"), F.col("number").alias("other"), (n * (apart(q0, p) - apart(q0, p0))).alias("value")))).alias("x")
    ).select("lang", "x.*")
    parts = neither.unionByName(one).unionByName(corrections(shares))
    total = parts.groupBy("lang", "number", "other").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    return total.join(mine.select("lang", "number", "source"), ["lang", "number"]).join(other.select("lang", "other", "item"), ["lang", "other"]).select(
        "lang", "source", "item", "value")


def corrections(shares: DataFrame) -> DataFrame:
    """What terms in both sources change, beside being taken as in one at a time."""
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    block = F.floor(F.col("number") / BLOCK).cast("int")
    dealt = shares.select("lang", "number", "term", "p", "p0", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("against"),
                          F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(PARTS)).cast("int").alias("part"))
    key = ["lang", "low", "high", "part"]
    dealt = dealt.withColumn("low", F.least("block", "against")).withColumn("high", F.greatest("block", "against"))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "term")
    return dealt.select(*key, "term", "number", "p", "p0").mapInArrow(streamed, "lang string, number int, other int, value long")


def apart_now(p, q):
    return (p - q) * (p - q) // q


def streamed(batches):
    """The corrections of sorted postings, term by term, added up in a matrix for each pair of blocks."""
    import pyarrow.compute as pc

    total = np.zeros((2 * BLOCK, 2 * BLOCK), np.int64)
    now, rest = None, None

    def out():
        lang, low, high, _ = now
        i, j = np.nonzero(total)
        different = (i // BLOCK != j // BLOCK) if low != high else (i != j)  # pairs inside a block are taken where it meets itself
        i, j = i[different], j[different]
        names = np.array([low, high]) * BLOCK
        got = pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(i), pa.string()), *(pa.array((names[x // BLOCK] + x % BLOCK).astype(np.int32)) for x in (i, j)),
             pa.array(total[i, j])], names=["lang", "number", "other", "value"])
        total[:] = 0
        return got

    def add(low, high, starts, sizes, number, p, p0):
        at = number % BLOCK + np.where(number // BLOCK == low, 0, BLOCK)
        for k in np.unique(sizes).tolist():
            step = max(1, 1_000_000 // (k * k))
            every = starts[sizes == k] if k > 1 else starts[:0]
            for i in range(0, len(every), step):
                x = every[i:i + step, None] + np.arange(k)
                a, a0, b, b0 = p[x][:, :, None], p0[x][:, :, None], p[x][:, None], p0[x][:, None]
                np.add.at(total, (at[x][:, :, None], at[x][:, None]),
                          apart_now(a, b) - apart_now(a, b0) - apart_now(a0, b) + apart_now(a0, b0))

    for batch in batches:
        batch = pa.Table.from_batches([batch])
        if rest is not None:
            batch = pa.concat_tables([rest, batch])
        rest, batch = None, batch.combine_chunks()
        key = [batch.column(c).combine_chunks() for c in ("lang", "low", "high", "part", "term")]
        size = batch.num_rows
        differ = [np.asarray(pc.not_equal(c[1:], c[:-1])) for c in key] if size > 1 else [np.zeros(0, bool)] * 5
        moved = np.append(True, np.logical_or.reduce(differ[:4]))
        starts = np.flatnonzero(moved | np.append(True, differ[4]))
        last = int(starts[-1])  # the batch's last term may go on in the next one
        rest = batch.slice(last)
        number, p, p0 = (np.asarray(batch.column(c)).astype(np.int64) for c in ("number", "p", "p0"))
        bounds = np.append(starts, size)
        edges = [*np.flatnonzero(moved[:last]).tolist(), last] if last else []
        for i, j in zip(edges, edges[1:]):
            here = tuple(c[i].as_py() for c in key[:4])
            if here != now:
                if now is not None:
                    yield out()
                now = here
            mine = (starts >= i) & (starts < j)
            add(here[1], here[2], starts[mine], np.diff(bounds)[mine], number, p, p0)
    if rest is not None:
        here = tuple(rest.column(c)[0].as_py() for c in ("lang", "low", "high", "part"))
        if here != now:
            if now is not None:
                yield out()
            now = here
        number, p, p0 = (np.asarray(rest.column(c)).astype(np.int64) for c in ("number", "p", "p0"))
        add(here[1], here[2], np.array([0]), np.array([rest.num_rows]), number, p, p0)
        yield out()
