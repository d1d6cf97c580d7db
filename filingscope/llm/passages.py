"""Operator 7: substring deduplication with repeated-phrase automata.

1. Anchors: of the 10-word grams in every window of WINDOW words the one of least hash is its anchor, so equal windows
   have equal anchors, at about 2 grams in 27.  Anchors are counted over all texts.
2. Confirmation: texts with recurring anchors give the hashes of the windows around them; windows counted at least
   twice over the whole input are recurring (partially aggregated, so a passage of a third of all texts is one row a
   task).  Their unions are a text's recurring passages.
3. Automata: texts are dealt evenly; each shard of about SHARD_BYTES of text compiles its distinct passages into one
   Aho-Corasick automaton (pyahocorasick) and streams its texts through it, which locates every occurrence; the words
   under any occurrence go.  A text meets the passages of its own shard, which hold all its own, so nothing is missed,
   and an automaton's memory is bounded by its shard's text.

Texts are keyed by their digest; equal texts are located once and count as often as they stand in the input.

Cases: null, empty and short texts (under WINDOW words) lose nothing; the kept text of an all-removed one is empty;
repeats inside one text count; repeated rows are copies and go whole if long enough; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import cut, map_slices, text_key
from filingscope.llm.words import Words, byte_table, rolling, signed

WINDOW = 35
GRAM = 10
SHARD_BYTES = 1_000_000
MAX_BROADCAST_ROWS = 200_000


def plain_words(column: pa.Array) -> Words:
    return Words(column, byte_table(lower=False, alphanumeric=False))


def anchored_windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the gram that anchors each, and the hashes of all grams."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = rolling(words.hash, GRAM)
    inside = np.flatnonzero(words.doc[:n] == words.doc[WINDOW - 1:])
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    anchor = np.concatenate([[0], *[view[i:i + 65536].argmin(axis=1) for i in range(0, n, 65536)]])[1:]
    return inside, (anchor + np.arange(n))[inside].astype(np.int64), grams


def lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """Values of ascending row numbers as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def anchors(docs: DataFrame) -> DataFrame:
    """(key, hashes, places): the anchors of every row's text, places counted in words."""

    def fn(batch):
        words = plain_words(batch.column("text"))
        _, chosen, grams = anchored_windows(words)
        at = np.unique(chosen)
        rows = words.doc[at] if len(at) else at
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), lists(signed(grams[at]), rows, n),
             lists(pa.array(at - words.first[rows] if len(at) else at, pa.int32()), rows, n)],
            names=["key", "hashes", "places"])

    keyed = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    return map_slices(keyed, fn, "key binary, hashes array<long>, places array<int>").where(F.size("hashes") > 0)


def first_of_each_text(docs: DataFrame) -> DataFrame:
    """(key, text): every text at least once, and once for each task that reads it."""
    keyed = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")

    def run(batches):
        seen = set()
        for batch in batches:
            keep = []
            for k in batch.column("key").to_pylist():
                keep.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return keyed.mapInArrow(run, keyed.schema)


def window_hashes(texts: DataFrame) -> DataFrame:
    """(id, copies, hashes, starts): windows whose anchor is among the text's recurring ``places``."""

    def fn(batch):
        words = plain_words(batch.column("text"))
        inside, chosen, _ = anchored_windows(words)
        flat = batch.column("places")
        recurs = np.zeros(len(words) + 1, bool)
        counts = np.diff(flat.offsets.to_numpy())
        recurs[flat.flatten().to_numpy() + np.repeat(words.first[:-1], counts)] = True
        at = inside[recurs[chosen]]
        hashes = rolling(words.hash, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
        rows = words.doc[at] if len(at) else at
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("copies"), lists(signed(hashes), rows, n),
             lists(pa.array(at - words.first[rows] if len(at) else at, pa.int32()), rows, n)],
            names=["id", "copies", "hashes", "starts"])

    return map_slices(texts.drop("key"), fn, "id long, copies long, hashes array<long>, starts array<int>")


def zipped(df: DataFrame, first: str, second: str, *kept: str) -> DataFrame:
    """One row for each pair of entries of two lists of equal length."""
    return df.select(*kept, F.explode(F.arrays_zip(first, second)).alias("z")).select(
        *kept, F.col(f"z.{first}").alias("hash"), F.col(f"z.{second}").alias("at"))


def recurring_windows(docs: DataFrame) -> DataFrame:
    """(key, text, starts): texts with recurring windows, and where those start (in words).

    Rows are numbered before a cut, so the wide tables of places carry a long for their text instead of its key.
    """
    found = cut(anchors(docs).withColumn("id", F.monotonically_increasing_id()))
    often = (found.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
             .where("n > 1").select("hash"))
    places = (zipped(found.dropDuplicates(["key"]), "hashes", "places", "id").join(often, "hash")
              .groupBy("id").agg(F.collect_list("at").alias("places")))  # bounded by one text's length
    copies = found.groupBy("key").agg(F.count("*").alias("copies"))
    chosen = cut(places.join(found.select("id", "key"), "id").join(copies, "key").select("key", "places", "copies"))
    once = first_of_each_text(docs)
    if chosen.count() <= MAX_BROADCAST_ROWS:  # then only these texts are shuffled
        once = once.join(F.broadcast(chosen.select("key")), "key", "left_semi")
    texts = cut(once.join(chosen, "key").dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()))
    windows = window_hashes(texts)
    twice = (zipped(windows, "hashes", "starts", "copies").groupBy("hash").agg(F.sum("copies").alias("n"))
             .where("n > 1").select("hash"))
    starts = (zipped(windows, "hashes", "starts", "id").join(twice, "hash")
              .groupBy("id").agg(F.collect_list("at").alias("starts")))
    return texts.select("id", "key", "text").join(starts, "id").drop("id")


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words under windows at ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def edges_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (from, to)."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(at[::2].tolist(), at[1::2].tolist(), strict=True))


def locate(texts: DataFrame) -> DataFrame:
    """(key, n_removed, spans, kept) of texts with recurring windows; ``spans``: removed word ranges [from, to)."""

    def fn(batch):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        rows = []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = [w.decode() for w in text.encode().split()]  # bytes split at exactly the six ASCII spaces
            for a, b in edges_of(covered(np.array(starts), len(words))):
                passage = " " + " ".join(words[a:b]) + " "
                automaton.add_word(passage, (len(passage), b - a))
            rows.append(words)
        automaton.make_automaton()
        spans, kept, removed = [], [], []
        for words in rows:
            line = " " + " ".join(words) + " "
            word_at = {}  # offset of the space before a word -> its number
            p = 0
            for i, w in enumerate(words):
                word_at[p] = i
                p += len(w) + 1
            step = np.zeros(len(words) + 1, np.int64)
            for last, (size, count) in automaton.iter(line):
                first = word_at[last - size + 1]
                step[first] += 1
                step[first + count] -= 1
            gone = np.cumsum(step[:-1]) > 0
            spans.append([{"from": a, "to": b} for a, b in edges_of(gone)])
            kept.append(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            removed.append(int(gone.sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.string())],
            names=["key", "n_removed", "spans", "kept"])

    return map_slices(texts, fn, "key binary, n_removed long, spans array<struct<from:int,to:int>>, kept string",
                      limit=SHARD_BYTES)


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, whole_sha256): every row's words, and the digest of all of them joined by spaces."""

    def fn(batch):
        words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array([len(w) for w in words], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])],
            names=["doc_id", "key", "n_words", "whole_sha256"])

    return map_slices(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), fn,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n_words long, whole_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(key, text, n_removed, spans, kept): the texts that lose words; all other texts stay as they are."""
    return locate(recurring_windows(docs))


def report(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    lost = remove_repeats(docs).select("key", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("rest_sha256"))
    return normalised(docs).join(lost, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("rest_sha256", "whole_sha256").alias("kept_sha256"))
