"""The registered queries on the smallest tables: against their SQL, and the rest against plain versions."""

import math
from collections import Counter
from hashlib import sha256
from zlib import crc32

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingscope.llm import pii, toxicity
from filingscope.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_names():
    assert set(QUERIES) >= {"pipeline"} and [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(res.fetchall())


def test_bpe(spark, docs, tokenizer):
    got = Counter(map(tuple, QUERIES["op9_bpe"](spark, SF_SMALL).collect()))
    assert got == Counter((d.doc_id, *brute.tokens(tokenizer, d.text)) for d in docs)


def test_personal_data(spark, docs):
    got = {r.doc_id: (r.base_sha256, r.spans) for r in QUERIES["op5_pii"](spark, SF_SMALL).collect()}
    for d in docs:
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(d.text))
        assert got[d.doc_id][0] == sha256(text.encode()).hexdigest() and got[d.doc_id][1].startswith(text)


def test_reshard(spark, docs):
    got = QUERIES["op8_reshard"](spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 16, crc32((d.text or "").encode())) for d in docs)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_language_accuracy(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF_SMALL).collect()}
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert all(got[d.doc_id].held_out == (crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.9 * len(held)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [(r.score, r.toxic) for r in got if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) >= 0.7  # a few hundred labelled rows only


def test_pipeline_against_a_plain_version(spark, docs, tokenizer):
    """The classifier's verdicts are taken from its model; all later stages are done in plain Python."""
    frame = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = toxicity.fit(frame, labels, ~toxicity.held_out(F.col("doc_id"), 3, 1))
    kept = docs
    if model is not None:
        pair = toxicity.compressors(model)
        t = model["threshold"]
        import numpy as np
        p = toxicity.probability(np.array([toxicity.features(d.text, pair) for d in docs]), model["logistic"])
        kept = [d for d, x in zip(docs, p) if (toxicity.CUT * x / t if x < t else toxicity.CUT) < toxicity.CUT]
    assert Counter(r.doc_id for r in corpus_pipeline.drop_toxic(spark, frame, SF_SMALL).collect()) == Counter(d.doc_id for d in kept)
    root = brute.groups([brute.shingles(d.text) for d in kept])
    least = {}
    for d, r in zip(kept, root):
        least[r] = min(least.get(r, math.inf), d.doc_id)
    kept = [d for d, r in zip(kept, root) if least[r] == d.doc_id]
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    kept = [d for d in kept if not brute.hits(d.text, items)[1]]
    want = Counter()
    for d in kept:
        spans = [{"kind": k, "start": a, "end": b, "action": "generalise"} for k, a, b in brute.personal(d.text)]
        want[(d.doc_id, *brute.tokens(tokenizer, pii.masked(d.text or "", spans)))] += 1
    got = Counter(map(tuple, QUERIES["pipeline"](spark, SF_SMALL).collect()))
    assert got == want


def test_stages_keep_the_columns(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = docs.cache()
        docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
