"""Operator 4: toxicity by compression distance.

Two zstandard dictionaries share a base of frequent ordinary word beginnings; one goes on with beginnings typical of
toxic text, the other with those typical of ordinary text (likelihood ratio over the fitted rows, counted in Spark).
Every text is cut into windows of whole words; a window's distance is what the ordinary dictionary's compressed form
takes more than the toxic one's.  The shares of windows beyond several thresholds and the largest distance go into a
small logistic model, whose own threshold (best F-score) is calibrated to a score of CUT.  Dictionaries and calibration
come from different rows.

Fitted on a bounded sample: at most FIT_ROWS labelled rows a class, chosen by hash.  Every whole text is scored.

Cases: null or empty text has no windows and gets the model's score for that; words longer than two windows are cut;
labels other than 0 and 1, or null, are not learned; repeated labels of a document count once (toxic if any is); if
either class has no row, every score is 0; an empty table gives no rows; a column named score is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.toolkit import cut, map_slices

FIT_ROWS = 3000
WINDOW_BYTES = 64
LEVEL = 9
#: Word beginnings (with the space before them) of these lengths can enter a dictionary.
SHORTEST, LONGEST = 5, 11
BASE_SEGMENTS = 1200
CLASS_SEGMENTS = 1500
LEAST_COUNT, LEAST_RATIO, LEAST_G2 = 5, 3.0, 25.0
DISTANCES = (2, 3, 4, 5, 6)
CUT = 0.7
#: F-score's beta for the threshold.
PRECISE = 0.7


def windows(text: str | None) -> list[bytes]:
    """Whole words in windows of about WINDOW_BYTES; each word with a space before it."""
    out, held = [], b""
    for word in (text or "").lower().encode("utf-8", "replace").split():
        if held and len(held) + 1 + len(word) > WINDOW_BYTES:
            out.append(held)
            held = b""
        held += b" " + word
        if len(held) > 2 * WINDOW_BYTES:
            out += [held[i:i + WINDOW_BYTES] for i in range(0, len(held), WINDOW_BYTES)]
            held = b""
    if held:
        out.append(held)
    return out


def compressors(model: dict):
    import zstandard

    out = []
    for part in ("ordinary", "toxic"):
        d = zstandard.ZstdCompressionDict(model["base"] + model[part], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                            write_dict_id=False))
    return out


def features(text: str | None, pair) -> list[float]:
    ordinary, toxic = pair
    wins = windows(text)
    n = len(wins)
    d = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in wins])
    over = [int((d >= t).sum()) for t in DISTANCES]
    return [math.sqrt(k / (n + 4)) for k in over] + [
        float(max(0, d.max())) if n else 0.0, math.log1p(n), math.log1p(over[2]), math.log1p(over[1])]


def fit_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, dict[int, int]]:
    """Rows a class, and (text, toxic, part): at most FIT_ROWS documents a class of those that ``learn`` allows; part 0 calibrates."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(learn)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = dict(known.groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for value, n in total.items():
        share = F.when(F.col("toxic") == value, F.lit(1.2 * FIT_ROWS / n)).otherwise(share)
    ticket = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    first = Window.partitionBy("toxic").orderBy("ticket", "doc_id")  # about 1.2 * FIT_ROWS rows a class reach this
    some = (known.withColumn("ticket", ticket).where(F.col("ticket") < share * (1 << 30))
            .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= FIT_ROWS))
    picked = some.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3)).alias("part"))
    # repeated documents of one id count once
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return rows.select("text", "toxic", "part"), total


def segment_counts(rows: DataFrame) -> DataFrame:
    """(segment, t, o): word beginnings by the distinct contexts (word, the one before, the one after) they stand in,
    in toxic and ordinary rows; so copies of a text count once.  segment null: all contexts.
    """

    def fn(batch):
        import xxhash

        words, contexts, classes = [], [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            ws = (text or "").lower().encode("utf-8", "replace").split()
            if not ws:
                continue
            words += ws
            contexts += [xxhash.xxh3_64_intdigest(b" ".join(c)) - (1 << 63)
                         for c in zip([b"", *ws[:-1]], ws, [*ws[1:], b""], strict=True)]
            classes += [toxic] * len(ws)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(contexts, pa.int64()), pa.array(classes, pa.int32())],
            names=["word", "context", "toxic"])

    once = map_slices(rows.select("text", F.col("toxic").cast("int").alias("toxic")), fn,
                      "word binary, context long, toxic int").dropDuplicates(["context", "toxic"])
    counted = once.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    spaced = F.concat(F.lit(b" "), F.col("word"))
    sizes = F.expr(f"sequence({SHORTEST}, {LONGEST - 1})")
    pieces = F.concat(F.array(F.lit(None).cast("binary")), F.transform(
        F.filter(sizes, lambda n: n <= F.octet_length(spaced)), lambda n: F.substring(spaced, 1, n)))
    return counted.select(F.explode(pieces).alias("segment"), "t", "o").groupBy("segment").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))


def typical(counts: DataFrame, of: str, than: str, n_of: int, n_than: int) -> list[bytes]:
    """Segments clearly more frequent in one class, the clearest last (zstd finds near ones cheapest)."""
    a, b = F.col(of).cast("double"), F.col(than).cast("double")
    expected = (a + b) * n_of / (n_of + n_than)
    g2 = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    rows = (counts.where((a >= LEAST_COUNT) & (a / n_of > LEAST_RATIO * (b + 0.5) / n_than))
            .select("segment", g2.alias("g2")).where(F.col("g2") > LEAST_G2)
            .orderBy(F.desc("g2"), "segment").limit(CLASS_SEGMENTS).collect())
    return [bytes(r.segment) for r in reversed(rows)]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> dict:
    """Newton steps on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, keep = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], l2), 1e-3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
    return {"mean": mean, "scale": scale, "weights": w}


def probability(x: np.ndarray, fitted: dict) -> np.ndarray:
    z = np.c_[(x - fitted["mean"]) / fitted["scale"], np.ones(len(x))]
    return 1 / (1 + np.exp(-np.clip(z @ fitted["weights"], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which on calling a row toxic gives the best F-score (beta below one: precision counts more).

    ``weight``: how many labelled rows a sampled row stands for.
    """
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f = hits / (np.cumsum(weight[order]) + PRECISE ** 2 * (weight * y).sum())
    f[:-1][p[order][:-1] == p[order][1:]] = 0  # no threshold parts equal probabilities
    at = int(f.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(min(max((p[order][at] + below) / 2, 1e-6), 1 - 1e-6))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> dict | None:
    """Dictionaries and calibration; None without rows of both classes."""
    rows, total = fit_rows(docs, labels, learn)
    rows = cut(rows)
    counts = cut(segment_counts(rows.where("part != 0")))
    words = counts.where("segment is null").first()
    if not words or not words.t or not words.o:
        return None
    counts = counts.where("segment is not null")
    base = counts.orderBy(F.desc("o"), "segment").limit(BASE_SEGMENTS).collect()
    model = {"base": b"".join(bytes(r.segment) for r in reversed(base)),
             "toxic": b"".join(typical(counts, "t", "o", words.t, words.o)),
             "ordinary": b"".join(typical(counts, "o", "t", words.o, words.t))}

    def fn(batch):
        pair = compressors(model)
        got = [features(t, pair) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    seen = map_slices(rows.where("part = 0").select("text", F.col("toxic").cast("int").alias("toxic")), fn,
                      "x array<double>, toxic int").collect()  # at most 2 * FIT_ROWS rows of a few numbers
    y = np.array([r.toxic for r in seen], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r.x for r in seen])
    model["logistic"] = logistic(x, y)
    weight = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    model["threshold"] = best_threshold(probability(x, model["logistic"]), y, weight)
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; CUT is the calibrated threshold)."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list = []

    def fn(batch):
        if not held:
            held.append(compressors(shared.value))
        x = np.array([features(t, held[0]) for t in batch.column("text").to_pylist()])
        p, t = probability(x, shared.value["logistic"]), shared.value["threshold"]
        s = np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(s, 0.0, 1.0))],
                                          names=[*batch.schema.names, "score"])

    return map_slices(docs, fn, docs.withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves ``rest``.  A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest
