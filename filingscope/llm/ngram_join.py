"""Operator 1: n-gram Jaccard join with PartEnum signatures.

A text's set holds its distinct 5-word shingles (64-bit hashes).  Sets are banded by size.  In the band whose largest
size is e, two sets of Jaccard >= 0.75 (the larger of at most 4e/3, so lower neighbours of the next band take part)
differ in at most H = e/3 elements, so of n > H parts of the shingle domain at least one is equal in both.  A signature
is the hash of (band, partitioning, part, the set's elements in that part); parts in which a set has no element give
none.

How many signatures: PartEnum's pigeonhole holds for all n parts of one partitioning.  A small set whose shared part
may be an empty one enumerates further independent partitionings; a large one enumerates the first SIGNATURES parts.
The partitionings are random: with x = H / n a part of a pair at the very threshold is equal and not empty with a
probability of exp(-x) (1 - exp(-3x)), which is 0.35 or more.  So all 44 differ with a probability below 1e-8 at the
threshold; at 0.9 the parts agree by two in three, and it is below 1e-20.

Before whole sets meet, pairs are tested on sketches: of SKETCH buckets of the domain, those in which two sets' counts
differ in parity are at most as many as the elements in which they differ, so no similar pair fails.

Candidates never come as all pairs of a signature's group.  Equal sets are one node.  Each group first offers stars (one
of its nodes against those of other clusters; the centre changes with the turn), which are verified exactly and
clustered.  Only groups that still hold several clusters go on.  One of at most SMALL_GROUP nodes offers its pairs
between clusters.  The nodes of a larger one (a passage many texts share) are keyed again, by the rarest quarter and one
of their shingles: in any one order of all shingles, two sets of Jaccard >= 0.75 share an element among the first
|A| - ceil(0.75 |A|) + 1 of each, and rarest first a shared passage comes last.  So no pair of a large group is lost, even
one that shares a single signature.  Groups of these keys offer stars and small groups' pairs in the same way; what
then still is large and mixed goes through blocks of BLOCK nodes, whose tasks hand on only pairs that sizes and sketches
allow.  A link inside one cluster changes nothing and is not looked for.

Cases: null, empty and word-less texts have n_shingles 0 and are their own component; texts of fewer than five words
have one shingle, the whole sequence; repeated rows and equal texts are one node; a null doc_id keeps its row (its
component is the smallest non-null doc_id of its group, or null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.components import components
from filingscope.llm.toolkit import cut, map_slices, release, sweep, text_key
from filingscope.llm.words import Words, byte_table, mix, signed

SHINGLE = 5
SIMILARITY = 0.75
SIGNATURES = 44
#: How much larger the next band's largest set is.
BAND = 2
#: Bits of a set's parity sketch.
SKETCH = 2048
#: Groups up to this size offer their remaining pairs at once; the nodes of larger ones are keyed by rare shingles.
SMALL_GROUP = 8
#: Times that groups offer a star, each with other centres (a second one found 1 link in 80 of the first).
TURNS = 1
#: Nodes of a block of a group that rare shingles leave large.
BLOCK = 512
MAX_BROADCAST_ROWS = 200_000
#: Text bytes whose words and shingles a worker holds at once.
SET_BYTES = 500_000
SEED = 0x2545F4914F6CDD1D


def band_tops() -> list[int]:
    """Largest set size of each band."""
    return [BAND ** i for i in range(40)]


TOPS = band_tops()


def bands_of(size: int) -> list[int]:
    """The band a size belongs to, and lower ones whose sets it can be similar to."""
    own = next(i for i, e in enumerate(TOPS) if size <= e)
    return [own, *(i for i in range(own - 1, -1, -1) if 3 * size <= 4 * TOPS[i])]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = Words(column, byte_table(lower=True, alphanumeric=False))
    at, hashes = words.runs(SHINGLE)
    rows = words.doc[at]
    cuts = np.searchsorted(rows, np.arange(len(column) + 1))
    out = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(hashes[cuts[i]:cuts[i + 1]]))
        elif n:  # the whole sequence, apart from any longer shingle
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for h in words.hash[words.first[i]:words.first[i + 1]]:
                    x = mix(np.array([x * np.uint64(SEED) + h], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of one set."""
    out = []
    for band in bands_of(len(s)):
        n = TOPS[band] // 3 + 1
        families = 1 if n == 1 else max(1, -(-SIGNATURES // n))
        with np.errstate(over="ignore"):
            seeds = mix(np.arange(1, families + 1, dtype=np.uint64) * np.uint64(SEED) + np.uint64(band))
            part = (mix(s[None, :] ^ seeds[:, None]) >> np.uint64(11)) % np.uint64(n)
            elements = np.broadcast_to(mix(s ^ np.uint64(SEED)), part.shape)
            use = part < SIGNATURES
            place = (part + np.arange(families, dtype=np.uint64)[:, None] * np.uint64(n))[use]
            elements = elements[use]
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, elements = place[order], elements[order]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            sums = np.add.reduceat(elements, begin)
            counts = np.diff(np.concatenate([begin, [len(place)]])).astype(np.uint64)
            out.append(mix(mix(sums + counts) ^ mix(place[begin] * np.uint64(SEED) + seeds[0])))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch_of(s: np.ndarray) -> bytes:
    """One bit a bucket: whether the set has an odd number of elements in it."""
    at = (mix(s ^ np.uint64(SEED >> 3)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, node, sketch) of every row; node is null for an empty set, key stands for the text."""

    def fn(batch):
        sets = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "key", "n_shingles", "node", "sketch"])

    return map_slices(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), fn,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n_shingles long, node long, "
                      "sketch binary", limit=SET_BYTES)


def signature_rows(texts: DataFrame) -> DataFrame:
    """(sig, node) for every signature of every set that a task reads."""

    seen = set()  # of a task: it sends most sets once

    def fn(batch):
        if len(seen) > MAX_BROADCAST_ROWS:
            seen.clear()
        sigs, nodes = [], []
        for s in shingle_sets(batch.column("text")):
            if len(s):
                node = node_of(s)
                if node not in seen:
                    seen.add(node)
                    sigs.append(signatures(s))
                    nodes.append(np.full(len(sigs[-1]), node))
        if not sigs:
            return None
        return pa.RecordBatch.from_arrays([signed(np.concatenate(sigs)), pa.array(np.concatenate(nodes))],
                                          names=["sig", "node"])

    return map_slices(texts.select("text"), fn, "sig long, node long", limit=SET_BYTES, done=seen.clear)


def sets_of(docs: DataFrame, sized: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items) of the given nodes, one row a node, from one text of each (``docs``: text).

    The texts' keys are broadcast when they are counted to be few, else the texts are shuffled.
    """
    keys = cut(sized.join(nodes, "node").groupBy("node").agg(F.min("key").alias("key")).select("key"))
    if keys.count() <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi").select("text")
    seen = set()

    def fn(batch):
        if len(seen) > MAX_BROADCAST_ROWS:
            seen.clear()
        sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
        names = [node_of(s) for s in sets]
        new = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]  # copies in one task
        if not new:
            return None
        flat = np.concatenate([sets[i] for i in new]).view(np.int64)
        ends = np.cumsum([0, *(len(sets[i]) for i in new)])
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in new], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["node", "items"])

    return map_slices(texts, fn, "node long, items array<long>", limit=SET_BYTES, done=seen.clear).dropDuplicates(["node"])


def nodes_of(sized: DataFrame) -> DataFrame:
    """(node, n, sketch), one row a distinct set."""
    return sized.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"))  # equal for equal sets


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def possible(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches do not rule out."""
    if pairs.count() <= MAX_BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    left = about.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xs"))
    right = about.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("ys"))
    fitting = (pairs.join(left.drop("xs"), "a").join(right.drop("ys"), "b")
               .where("4 * least(na, nb) >= 3 * greatest(na, nb)"))
    both = fitting.join(left.drop("na"), "a").join(right.drop("nb"), "b")

    def run(batches):
        for batch in batches:
            x, y = sketch_rows(batch.column("xs")), sketch_rows(batch.column("ys"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # Jaccard >= 3/4 means that at most a seventh of |A| + |B| differs
            yield batch.select(["a", "b"]).filter(pa.array(7 * apart <= total))

    return both.mapInArrow(run, "a long, b long")


def verified(likely: DataFrame, docs: DataFrame, sized: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``likely`` (from ``cut``; deleted here) whose whole sets reach the similarity, written."""
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(sets_of(docs, sized, ends))
    both = (likely.join(sets.select(F.col("node").alias("a"), F.col("items").alias("xs")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("ys")), "b"))
    shared = F.size(F.array_intersect("xs", "ys")).cast("long")
    total = (F.size("xs") + F.size("ys")).cast("long")
    out = cut(both.where(100 * shared >= 75 * (total - shared)).select("a", "b"))
    release(likely)
    release(sets)
    return out


def grouped(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` (sig, node, root) of the groups that hold more than one cluster, each once, written.

    ``size``: the group's nodes; ``a``, ``ra``: its centre, the least node by the turn's order, and the centre's root.
    Rows are dealt by sig once; the aggregate and the join back both read that exchange.
    """
    rows = rows.select("sig", "node", "root").repartition("sig").distinct()
    least = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root"))
    about = (rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                     F.count("*").alias("size"), least.alias("c")).where("lo < hi")
             .select("sig", "size", F.col("c.node").alias("a"), F.col("c.root").alias("ra")))
    return cut(rows.join(about, "sig"))


def stars(groups: DataFrame) -> DataFrame:
    """The centre of each group against the group's nodes of other clusters."""
    return groups.where("root != ra").select("a", F.col("node").alias("b")).distinct()


def between(groups: DataFrame) -> DataFrame:
    """Pairs of a small group's nodes from different clusters."""
    right = groups.select("sig", F.col("node").alias("b"), F.col("root").alias("rb"))
    return (groups.select("sig", F.col("node").alias("a"), "root").join(right, "sig")
            .where("a < b and root != rb").select("a", "b").distinct())


def rare_keys(sets: DataFrame) -> DataFrame:
    """(sig, node): the rarest |A| - ceil(0.75 |A|) + 1 shingles of every set of ``sets`` (node, items).

    Shingles in at most SMALL_GROUP of the sets count as equally rare: their groups are small whatever the order.
    """
    items = sets.select("node", F.explode("items").alias("sig"))
    common = cut(items.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_GROUP))
    if common.count() <= MAX_BROADCAST_ROWS:
        common = F.broadcast(common)
    ranked = (items.join(common, "sig", "left").groupBy("node")
              .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sig"))).alias("s")))
    first = F.size("s") - F.ceil(F.size("s") * 3 / 4).cast("int") + 1
    return ranked.select(F.explode(F.slice(F.col("s"), F.lit(1), first)).alias("s"), "node").select("s.sig", "node")


def block_pairs(groups: DataFrame, about: DataFrame) -> DataFrame:
    """Likely pairs between clusters of groups of any size: every two blocks of a group meet in one bounded piece."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (groups.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED >> 2)), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
              .join(about, "node"))

    def fn(table):
        table = table.combine_chunks()
        node, root, size, own = (table.column(c).to_numpy() for c in ("node", "root", "n", "own"))
        x = sketch_rows(table.column("sketch"))
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(node)):
            apart = np.bitwise_count(x[k + 1:] ^ x[k]).sum(axis=1, dtype=np.int64)
            fit = (7 * apart <= size[k + 1:] + size[k]) & (root[k + 1:] != root[k])
            fit &= 4 * np.minimum(size[k + 1:], size[k]) >= 3 * np.maximum(size[k + 1:], size[k])
            if across:
                fit &= own[k + 1:] != own[k]
            b.append(node[k + 1:][fit])
            a.append(np.full(len(b[-1]), node[k]))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return placed.groupBy("sig", "i", "j").applyInArrow(fn, "a long, b long").distinct()


def links(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes whose components are those of all links of Jaccard >= 0.75."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    about = cut(nodes_of(sized))
    found = docs.sparkSession.createDataFrame([], "a long, b long")

    def check(likely: DataFrame) -> None:
        nonlocal found
        likely = cut(likely)
        if not likely.isEmpty():
            found = found.unionByName(verified(likely, texts, sized))

    def offer(pairs: DataFrame) -> None:
        pairs = cut(pairs)
        check(possible(pairs, about))
        release(pairs)

    def pair_up(keys: DataFrame) -> DataFrame:
        """Links found by the groups of ``keys`` (sig, node); rows of the large groups that are still mixed."""
        keys = cut(keys)
        rest = grouped(keys.withColumn("root", F.col("node")), 0)
        release(keys)
        for turn in range(1, TURNS + 1):
            offer(stars(rest))
            now = rest.select("sig", "node").join(components(found), "node", "left")
            before, rest = rest, grouped(now.withColumn("root", F.coalesce("root", "node")), turn)
            release(before)
            sweep(docs.sparkSession)
        offer(between(rest.where(F.col("size") <= SMALL_GROUP)))
        return rest.where(F.col("size") > SMALL_GROUP)

    large = cut(pair_up(signature_rows(texts)).select("node").distinct())
    if not large.isEmpty():
        sets = cut(sets_of(texts, sized, large))
        rest = pair_up(rare_keys(sets))
        release(sets)
        check(block_pairs(rest, about))
    release(about)
    return found


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, copy_class, class) for every row of ``docs`` (doc_id, text).

    ``copy_class``: equal sets; ``class``: one group of linked documents (null for an empty set).
    """
    sized = cut(set_sizes(docs))
    roots = components(links(docs, sized))
    named = sized.drop("sketch").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    return named.join(least, "class", "left").select(
        "doc_id", "key", "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.col("node").alias("copy_class"), "class")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one of least doc_id stays.

    Documents without a word are linked with nothing and all stay.  A group with only null ids keeps one row.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = (similar_groups(docs).where(F.col("class").isNotNull()).groupBy("class").agg(F.min(rank).alias("r"))
            .select(F.col("r.doc_id").alias("__id"), F.col("r.key").alias("__text_key")))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    keyed = docs.where(~wordless).withColumn("__text_key", text_key(F.col("text")))
    # repeated rows of one id and text are one document
    same = [keyed["__text_key"] == kept["__text_key"], keyed["doc_id"].eqNullSafe(kept["__id"])]
    chosen = keyed.join(kept, same, "left_semi")
    return chosen.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key").unionByName(docs.where(wordless))
