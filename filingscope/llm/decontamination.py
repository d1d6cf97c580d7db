"""Operator 6 (DataFrame functions only): benchmark decontamination with a positional inverted index.

Every item becomes windows of 10 words (a shorter item is one window).  All texts are counted once for the document
frequencies of the test terms; each window is then looked up by its two rarest terms.  The index stores a posting
(term, text, place) for every place of those terms in every text; the rarer term's postings also hold the words around
them.  Postings meet the windows of their term, which turns a place into the window start it stands for; the lists of
the two terms are intersected on (text, window, start), and what is left is compared word for word.

Texts are keyed by their digest: copies share postings and matches.  The benchmark side is broadcast only below
MAX_BROADCAST_ROWS window terms (counted first); beyond it the joins shuffle.

Terms are looked up fully lower-cased (which never moves a word border); the final comparison of a window with the
words kept around a posting lower-cases A-Z only.

Cases: null and word-less texts have no words and no hits, word-less items no windows; equal windows of several items
count for each item; repeated rows get equal results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.toolkit import cut, text_key

WINDOW = 10
MAX_BROADCAST_ROWS = 1_000_000
#: What stands between words; letters of either case are in words, so texts are split as they are written.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII code points."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast when it is counted to be small; otherwise left to shuffle joins."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def windows_of(items: DataFrame) -> DataFrame:
    """(window, exact, phrase, size): the distinct windows of all items; phrase holds fully lower-cased words."""
    return cut(item_windows(items).drop("item_id").distinct())


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window, exact, phrase, size): every window of every item; ``window`` stands for its exact words."""
    exact = words_of(ascii_lower(F.col("text")))
    cuts = F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), i -> slice(w, i + 1, {WINDOW}))")
    one = (items.select("item_id", exact.alias("w")).where(F.size("w") > 0)
           .select("item_id", F.explode(cuts).alias("exact")))
    joined = F.array_join("exact", " ")
    return one.select("item_id", text_key(joined).alias("window"), joined.alias("exact"),
                      F.split(F.lower(joined), " ").alias("phrase"), F.size("exact").alias("size"))


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, places): how often each of ``terms`` stands in all texts."""
    return (docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
            .join(small(terms), "term").groupBy("term").agg(F.count("*").alias("places")))


def window_terms(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(window, size, exact, first, first_at, second, second_at): each window's two rarest terms and their places.

    A window with a term that no text holds can't occur and is left out; a one-term window has no second.
    """
    at = windows.select("window", F.posexplode("phrase").alias("at", "term")).join(frequencies, "term", "left")
    row = Window.partitionBy("window").orderBy("places", "term", "at")  # at most 10 rows each
    ranked = at.withColumn("places", F.coalesce("places", F.lit(0))).withColumn("nth", F.row_number().over(row))
    picked = ranked.groupBy("window").agg(
        F.min("places").alias("least"),
        F.min(F.when(F.col("nth") == 1, F.struct("term", "at"))).alias("x"),
        F.min(F.when(F.col("nth") == 2, F.struct("term", "at"))).alias("y")).where("least > 0")
    return picked.join(windows, "window").select(
        "window", "size", "exact", F.col("x.term").alias("first"), F.col("x.at").alias("first_at"),
        F.col("y.term").alias("second"), F.col("y.at").alias("second_at"))


def build_index(docs: DataFrame, terms: DataFrame, around: int = WINDOW) -> DataFrame:
    """Postings (term, key, place, before, near) of the given terms (term, keep) in every text.

    ``near``: where ``keep`` is set, the words around the place as written, of which ``before`` stand before it;
    ``key``: the text.
    """
    words = docs.where(F.col("text").isNotNull()).select(
        text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    begin = F.expr(f"greatest(place - {around - 1}, 0)")
    return (words.select("key", "w", F.posexplode("w").alias("place", "word"))
            .withColumn("term", F.lower("word")).join(small(terms), "term")
            .select("term", "key", "place", (F.col("place") - begin).alias("before"),
                    F.when(F.col("keep"), F.slice("w", begin + 1, 2 * around - 1)).alias("near")))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, window, start, size): places where a window's words stand, by intersecting its two rarest lists."""
    first = (index.where(F.col("near").isNotNull()).join(small(windows), F.col("term") == F.col("first"))
             .withColumn("skip", F.col("before") - F.col("first_at")).where("skip >= 0")
             .where(ascii_lower(F.array_join(F.slice("near", F.greatest("skip", F.lit(0)) + 1, F.col("size")), " ")) == F.col("exact"))
             .select("key", "window", (F.col("place") - F.col("first_at")).alias("start"), "size", "second"))
    second = (index.join(small(windows.where(F.col("second").isNotNull()).select("window", "second", "second_at")),
                         F.col("term") == F.col("second"))
              .select("key", "window", (F.col("place") - F.col("second_at")).alias("start")))
    alone = first.where(F.col("second").isNull()).drop("second")
    both = first.where(F.col("second").isNotNull()).drop("second").join(second, ["key", "window", "start"], "left_semi")
    return both.unionByName(alone).distinct()


def proximity_matches(index: DataFrame, a: str, b: str, distance: int) -> DataFrame:
    """(key, place_a, place_b): places of two indexed terms at most ``distance`` words apart."""
    left = index.where(F.col("term") == a).select("key", F.col("place").alias("place_a"))
    right = index.where(F.col("term") == b).select("key", F.col("place").alias("place_b"))
    bucket = F.floor(F.col("place_b") / distance)
    near = F.explode(F.array(*[F.floor(F.col("place_a") / distance) + i for i in (-1, 0, 1)]))
    return (left.withColumn("bucket", near).join(right.withColumn("bucket", bucket), ["key", "bucket"])
            .where(F.abs(F.col("place_a") - F.col("place_b")) <= distance).where("place_a != place_b").drop("bucket"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, start, size, window): every occurrence of every window in every text."""
    windows = windows_of(items)
    terms = cut(windows.select(F.explode("phrase").alias("term")).distinct())
    chosen = cut(window_terms(windows, term_frequencies(docs, terms)))
    looked = cut(chosen.select(F.explode(F.array(
        F.struct(F.col("first").alias("term"), F.lit(True).alias("keep")),
        F.struct(F.col("second").alias("term"), F.lit(False).alias("keep")))).alias("t")).select("t.*")
        .where(F.col("term").isNotNull()).groupBy("term").agg(F.max("keep").alias("keep")))
    index = cut(build_index(docs, looked))
    return phrase_matches(index, chosen)


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, item_ids (sorted as strings)."""
    found = cut(matches(docs, items))
    hit = (found.select("key", F.explode(F.expr("sequence(start, start + size - 1)")).alias("place")).distinct()
           .groupBy("key").agg(F.count("*").alias("n_hit")))
    # at most one row an item and text: the number of items bounds the list
    owners = item_windows(items).select("window", F.col("item_id").cast("string").alias("item")).distinct()
    by_item = (found.select("key", "window").distinct().join(small(owners), "window").select("key", "item").distinct()
               .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids")))
    counts = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counts.join(hit.join(by_item, "key", "left"), "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item stands."""
    hit = cut(matches(docs, items).select(F.col("key").alias("__text_key")).distinct())
    return docs.withColumn("__text_key", text_key(F.col("text"))).join(small(hit), "__text_key", "left_anti").drop("__text_key")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns."""
    return scan(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
