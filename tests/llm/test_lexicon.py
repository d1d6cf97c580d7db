"""Spelling variants, source divergence and token counts against plain versions, with small bounds so that lists are dealt anew,
blocks spill, runs merge in rounds and sources meet in several blocks."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from filingscope.llm import divergence, prefix_counts, spelling
from filingscope.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# --- spelling variants ---

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in spelling.RUN.findall((text or "").translate(brute.AZ)):
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled(odd_rows):
    """Families of near words with steep counts, long words, and many words with a common beginning."""
    rnd = random.Random(9)
    words = []
    for stem in ("orange", "straße", "überall", "déjàvues", "aaaaaa", "aaaaaaa", "abababab"):
        words += [stem] * 400
        for _ in range(12):
            i = rnd.randrange(len(stem))
            near = rnd.choice([stem[:i] + rnd.choice("abéz") + stem[i:], stem[:i] + stem[i + 1:], stem[:i] + "q" + stem[i + 1:]])
            words += [near] * rnd.choice([5, 20, 60])
            words += [near[:3] + "x" + near[3:]] * 5
    words += [w for _ in range(150) for w in ["common" + "".join(rnd.choice("abcd") for _ in range(4))] * 5]
    words += ["y" * 3000] * 6 + ["y" * 2999] * 30 + ["Häufig" * 4] * 5
    rnd.shuffle(words)
    texts = [" ".join(words[i::37]) for i in range(37)]
    return [(r[0], r[1]) for r in odd_rows] + list(enumerate(texts, 1000)) + [(None, texts[0])]


@pytest.mark.parametrize("size", [spelling.LIST, 3])
def test_spelling_variants(spark, spelled, monkeypatch, size):
    monkeypatch.setattr(spelling, "LIST", size)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in spelled], "doc_id long, text string, word string, n int").repartition(3)
    got = Counter(map(tuple, spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = Counter(plain_variants(spelled))
    assert got == want and sum(x[1] is not None for x in want) > 20 and any(x[1] and x[1] != x[2] for x in want)


def test_near_words_of_sorted_lists():
    rnd = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 50))})
        got = list(spelling.near_in(words))
        assert sorted(got) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_spelling_without_words(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short ones 123456")], "doc_id long, text string")).count() == 0


# --- source divergence ---

def plain_audit(rows):
    rows = [((lang or ""), (source or ""), [w for w in brute_terms(text)]) for text, lang, source in rows]
    docs, groups = defaultdict(Counter), {}
    for lang, source, words in rows:
        groups.setdefault((lang, source), Counter()).update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs | {k[0]: 1 for k in groups}:
        kept = sorted(t for t, d in docs[lang].items() if d >= 3)
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            parts = {"pair": [(sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in own if o != s],
                     "term": [((p[s][t] - q[t])**2 // q[t], t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:200 if part == "term" else None], 1)]
    return Counter(out)


def brute_terms(text):
    import re
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.AZ))


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, odd, odd_rows, monkeypatch, small):
    if small:
        for name, value in (("HELD", 20), ("FAN_IN", 3), ("BLOCK", 2), ("SMALL", 1)):
            monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(4)
    words = ["w" + "".join(rnd.choice("abcdeé") for _ in range(3)) for _ in range(400)]
    more = [(" ".join(rnd.choices(words, [1 / (i + 1) for i in range(400)], k=90)) + " Zöe 中文", "en", f"s{i % 9}") for i in range(60)]
    more += [(" ".join(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(260)), "en", "big")] * 3
    more += [("one two three", "xx", "only"), ("four five", "xx", "other"), (None, "yy", None), ("", "yy", "b"), ("", None, None)]
    docs = odd.select("text", "lang", "source", "key", F.col("size").alias("term"), F.col("score").alias("part")).unionByName(
        spark.createDataFrame([(*r, "k", 1, "p") for r in more], "text string, lang string, source string, key string, term int, part string"))
    got = divergence.audit(docs.repartition(5))
    want = plain_audit([(t, lang, s) for _, t, lang, s in odd_rows] + more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == want and max(x[5] for x in want if x[2] == "term") == 200


def test_source_divergence_of_an_empty_table(spark, empty):
    assert divergence.audit(empty).count() == 0


# --- token counts ---

ODD_TEXTS = [None, "", " ", "  a  ", "▁a ▁", "<s> a</s><unk><0x41>", "a\u0000b\n\t\r c", "中文字 𝄞é ﬁ①", "the" * 300, "x" * 5000, " " * 40, "0123456789" * 30]


def test_token_counts_of_every_prefix(library):
    rnd = random.Random(1)
    table = prefix_counts.PrefixTable(prefix_counts.load_model(MODEL))
    texts = ["".join(rnd.choice("ab  <s>▁\n\té中文字的𝄞 theing123./'​ﬁ①aAé0") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    for t, changes in zip(texts, table.changes(texts), strict=True):
        assert np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64).tolist() == [len(library.encode(t[:p])) for p in range(1, len(t) + 1)]


def test_token_counts_with_small_memory(library, monkeypatch):
    for name, value in (("KEPT_CHUNKS", 3), ("KEPT_PAIRS", 2), ("KEPT_LENGTH", 4)):
        monkeypatch.setattr(prefix_counts, name, value)
    table = prefix_counts.PrefixTable(prefix_counts.load_model(MODEL))
    got = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in table.changes(ODD_TEXTS)]
    assert got == [len(library.encode(t or "")) for t in ODD_TEXTS]


def test_questions_answered_from_the_table(spark, odd, odd_rows, library, empty):
    docs = odd.select("text", "key", "score", (F.length("text") / 2).cast("long").alias("size"), F.lit(1).alias("n_tokens")).unionByName(
        spark.createDataFrame([(t, "k", "s", 3, 1) for t in ODD_TEXTS], "text string, key string, score string, size long, n_tokens int"))
    counts = prefix_counts.prefix_table(docs, MODEL)
    assert [c for c in counts.columns if c not in ("n_tokens", "prefix_changes")] == ["text", "key", "score", "size"]
    asked = prefix_counts.count_at(prefix_counts.cut_at(prefix_counts.packed_into(counts, 8), 20), "size", "half")
    rows = asked.collect()
    assert Counter(r.text for r in rows) == Counter([t for _, t, _, _ in odd_rows] + ODD_TEXTS)
    for r in rows:
        t = r.text or ""
        n = len(library.encode(t))
        assert r.n_tokens == n and r.n_windows == -(-n // 8) and len(r.prefix_changes) == len(t)
        assert r.half == (None if r.size is None else len(library.encode(t[:r.size])))
        fits = [p for p in range(min(len(t), 400) + 1) if len(library.encode(t[:p])) <= 20]
        assert r.cut_chars == fits[-1] or len(t) > 400 and r.cut_chars > 400
    assert prefix_counts.cut_at(prefix_counts.prefix_table(empty, MODEL), 5).count() == 0


def test_token_count_query(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, SF_SMALL).collect())
    counts = [(d, len(library.encode(d.text or ""))) for d in docs]
    assert got == Counter((d.doc_id, len((d.text or "").encode()), n, n > 4096) for d, n in counts)
