"""Operator 3: language identification by sparse multinomial logistic regression.

Features: TF-IDF of character n-grams (1 to 3 code points of the lower-cased text), hashed to FEATURES buckets, of unit
length.  Document frequencies are counted over all rows that may be learned from.  Weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (FIT_ROWS rows a language, by hash); one
in five of them calibrates the temperature instead.

Cases: null text and text without a letter are ``und`` with score 0; without any row to learn from all are; whole
texts are read, long ones too; repeated rows are predicted alike; an empty table gives no rows;
columns named as the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.toolkit import map_slices

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
FIT_ROWS = 400
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(FEATURES, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            if len(codes) < order:
                break
            h = h[:len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C55) + codes[order - 1:] + np.uint64(order)
            if order in ORDERS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
    return out


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each hashed n-gram, over all of ``rows``; the result has FEATURES numbers at any size."""

    def run(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    seen += gram_counts(text) > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], n])], names=["bucket", "n"])

    out, total = np.zeros(FEATURES, np.int64), 0
    counted = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal weights (FEATURES + 1, classes); the last row is the bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.r_[at, FEATURES], np.r_[x, 1.0]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(FEATURES + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, searched on a geometric grid."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, learn: Column) -> dict | None:
    """A model from (doc_id, text, lang) rows that ``learn`` allows; None if there are none with a letter."""
    rows = docs.select("doc_id", "text", "lang").where(learn).where("lang is not null and text is not null")
    frequency, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    share = F.lit(0.0)
    for lang, n in rows.groupBy("lang").count().collect():  # one row a language
        share = F.when(F.col("lang") == lang, F.lit(1.3 * FIT_ROWS / n)).otherwise(share)
    ticket = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy("ticket", "doc_id")  # about 1.3 * FIT_ROWS rows a language reach this
    some = (rows.withColumn("ticket", ticket).where(F.col("ticket") < share * (1 << 30))
            .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= FIT_ROWS))

    def fn(batch):
        keep = [has_letter(t) for t in batch.column("text").to_pylist()]
        batch = batch.filter(pa.array(keep, pa.bool_()))
        got = [vector(t, idf) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())),
             pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32())), batch.column("ticket")],
            names=["lang", "at", "x", "ticket"])

    seen = map_slices(some.select("text", "lang", "ticket"), fn,
                      "lang string, at array<int>, x array<float>, ticket long").toArrow()
    if not seen.num_rows:
        return None
    seen = seen.sort_by([("ticket", "ascending"), ("lang", "ascending")])
    langs = sorted(set(seen.column("lang").to_pylist()))
    sample = [(np.asarray(a.values), np.asarray(x.values, dtype=float), langs.index(lang.as_py())) for lang, a, x in
              zip(seen.column("lang"), seen.column("at"), seen.column("x"), strict=True)]
    weights = train([s for i, s in enumerate(sample) if i % 5] or sample, len(langs))
    check = sample[::5]
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in check])
    return {"langs": langs, "idf": idf, "weights": weights, "t": temperature(logits, np.array([y for _, _, y in check]))}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with lang_pred and score (the calibrated probability)."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch):
        m = shared.value
        langs, scores = [], []
        for text in batch.column("text").to_pylist():
            if not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = vector(text, m["idf"])
            p = softmax((x @ m["weights"][at] + m["weights"][-1]) / m["t"])
            langs.append(m["langs"][int(p.argmax())])
            scores.append(float(p.max()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return map_slices(docs, fn, schema)
