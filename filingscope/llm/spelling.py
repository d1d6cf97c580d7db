"""Operator 11: grouping of spelling variants by dynamic programming over sorted word lists.

Words one edit apart are looked for in sorted lists.  A list is scanned once for each of its words: the edit matrix of the
word against the list has three cells a row (one edit leaves the diagonal by one), rows of the prefix that a list
word shares with the last one are kept, and where a row holds no cell of at most one edit, all words with that prefix
are passed over.

Lists stay bounded.  Of two words one edit apart, the shorter with m code points, all before the edit is a common
prefix and all after it a common suffix.  So words meet in lists of (m, window of the edit's place, text outside
that window): at first two windows, the halves.  A list of over ``LIST`` words is dealt anew by half windows, down to windows of one place,
where the alphabet bounds a list.  A pair counts only in the window that holds its first difference, so it is found once and none is lost.

Cases: null texts and texts without words give nothing; empty tables give no rows; a null id counts as an empty one;
repeated rows count again; the longest words are words; ties of the largest count go to the first word in code-point
order; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import cut, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Runs whose keyed checksum this number divides lose one code point.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT, MORE = 6, 5, 5
#: Words of a list that one scan may hold, and words counted in a worker before they are handed on.
LIST, HELD_WORDS = 400, 100_000


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of all texts, after the keyed slips, with their occurrences; n is at least ``LEAST_COUNT``.

    Workers add up their own texts first, so a word of every text reaches the shuffle a few times a task.
    """
    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: Counter = Counter()

        def out():
            words = list(held)
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for part in slices(batch, "text"):
                for key, body in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seed = crc32(key)
                    for w, n in Counter(RUN.findall(body.translate(UPPER).decode())).items():
                        h = crc32(w.encode(), seed)
                        if h % SLIP == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                        if len(w) >= LEAST_LENGTH:
                            held[w] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
        if held:
            yield out()
        pa.default_memory_pool().release_unused()

    rows = docs.where(F.col(text).isNotNull()).select(
        F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).cast("binary").alias("key"),
        F.col(text).cast("binary").alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def near_in(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs (earlier, later) of sorted distinct words exactly one edit apart."""
    count = len(words)
    shared = [0] * (count + 1)
    for i in range(1, count):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[i] = k
    for i, q in enumerate(words):
        size = len(q)
        # rows[d]: edits between a list word's first d code points and q's first d-1, d, d+1; the word itself gives 1, 0, 1
        rows = [(1, 0, 1)] * (size + 1)
        known, at = size, i + 1
        keep = shared[at]
        while at < count:
            x = words[at]
            d = min(keep, known)
            low, mid, high = rows[d]
            dead = False
            while d < len(x):
                c = x[d]
                d += 1
                # cells q[:d-1], q[:d], q[:d+1]; a cell beyond q's ends is out of reach
                new_low = 9 if d - 1 > size else min(low + (d < 2 or q[d - 2] != c), mid + 1) if d > 1 else d
                new_mid = 9 if d > size else min(mid + (q[d - 1] != c), high + 1, new_low + 1)
                new_high = 9 if d + 1 > size else min(high + (q[d] != c), new_mid + 1)
                low, mid, high = new_low, new_mid, new_high
                del rows[d:]
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    dead = True
                    break
            known = d
            if not dead:
                gap = size - len(x)
                if -1 <= gap <= 1 and (low, mid, high)[gap + 1] == 1:
                    yield i, at
            at += 1
            keep = shared[at] if at < count else 0
            if dead:  # pass over all words that share the d code points beyond one edit
                while at < count and shared[at] >= d:
                    at += 1
                keep = shared[at] if at < count else 0
            known = min(known, len(rows) - 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every pair of ``words`` (word, n) exactly one edit apart."""
    spark = words.sparkSession
    words = cut(words)
    size = F.length("word")
    # the shorter word of a pair has this word's length or one less
    lists = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    lists = lists.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("a"), F.floor(F.col("m") / 2).cast("int").alias("b")),
        F.struct(F.floor(F.col("m") / 2).cast("int").alias("a"), (F.col("m") + 1).alias("b")))).alias("w"))
    lists = lists.select("word", "n", "m", "w.a", "w.b")
    found = None
    while True:
        lists = lists.withColumn("outside", F.concat_ws(
            " ", F.substring("word", F.lit(1), F.col("a")),
            F.substring("word", F.length("word") - F.greatest(F.col("m") - F.col("b"), F.lit(0)) + 1,
                        F.greatest(F.col("m") - F.col("b"), F.lit(0)))))
        key = ["m", "a", "b", "outside"]
        sizes = cut(lists.groupBy(*key).agg(F.count("*").alias("held"), F.min(F.length("word")).alias("least"))
                    .where((F.col("held") > 1) & (F.col("least") == F.col("m"))))  # without a word of m none is the shorter
        large = (F.col("held") > LIST) & (F.col("b") - F.col("a") > 1)
        pairs = scan(lists.join(sizes.where(~large).select(*key), key))
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where(large).isEmpty():
            return found
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        lists = cut(lists.join(sizes.where(large).select(*key), key).select("word", "n", "m", F.explode(F.array(
            F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))).alias("w"))
            .select("word", "n", "m", "w.a", "w.b"))


def scan(lists: DataFrame) -> DataFrame:
    """(word, near, near_n) within each list (m, a, b, outside); lists with a common suffix are sorted from the words' ends."""
    def run(batches):
        def pairs():
            for (m, a, b, _), rows in groupby(rows_of(batches), itemgetter(0, 1, 2, 3)):
                rows = [(r[4], r[5], r[6]) for r in rows]
                for i, j in near_in([r[0] for r in rows]):
                    (_, u, nu), (_, v, nv) = rows[i], rows[j]
                    if min(len(u), len(v)) == m:
                        k = 0
                        while k < m and u[k] == v[k]:
                            k += 1
                        if a <= k < b:
                            yield u, v, nv
                            yield v, u, nu

        held = []
        for p in pairs():
            held.append(p)
            if len(held) >= 20_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("m", "a", "b", "outside", "ordered", "word", "n")), strict=True)

    def batch_of(rows):
        u, v, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())],
                                          names=["word", "near", "near_n"])

    key = ["m", "a", "b", "outside"]
    dealt = lists.withColumn("ordered", F.when(F.col("a") == 0, F.reverse("word")).otherwise(F.col("word")))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "ordered")
    return dealt.select(*key, "ordered", "word", "n").mapInArrow(run, "word string, near string, near_n long")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs ``LEAST_COUNT`` times.

    ``form``: the near word of the largest count, if that is ``MORE`` times the word's own; ``root``: the end of the forms.
    """
    words = cut(counted(docs, doc_id, text))
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= MORE * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= MORE * F.col("n"), -F.col("best.less")).alias("form_n"))
    out = cut(out)
    ends = roots(out.where(F.col("form").isNotNull()).select("word", "form"))
    return out.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form); chains have no loops.  Each round doubles the steps taken."""
    ends = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut(ends.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")))
        done = ends.where("moved").isEmpty()
        ends = ends.drop("moved")
        if done:
            return ends
