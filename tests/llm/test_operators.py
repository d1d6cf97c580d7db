"""Every operator against a plain version on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import itertools
import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingscope.llm import (bpe, components, decontamination, embedding_join, language, licenses, ngram_join, passages,
                             pii, resharding, toxicity)
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(rows, want):
    assert Counter(map(tuple, rows)) == Counter(want)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for x in links for n in x}
    assert {r.node: r.root for r in got} == brute.reachable(links, nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join(odd, odd_rows, empty):
    got = ngram_join.similar_groups(odd)
    sets = [brute.shingles(t) for _, t, _, _ in odd_rows]
    root = brute.groups(sets)
    least = {}
    for r, row in zip(root, odd_rows):
        least[r] = min([x for x in (least.get(r), row[0]) if x is not None], default=None)
    want = [(row[0], len(s), row[0] if not s else least[r]) for row, s, r in zip(odd_rows, sets, root)]
    same(got.select("doc_id", "n_shingles", "component_id").collect(), want)
    assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_keeps_one_of_each_group(odd, odd_rows):
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each_group(odd).collect()]
    sets = [brute.shingles(t) for _, t, _, _ in odd_rows]
    root = brute.groups(sets)
    assert len([x for x in got if brute.shingles(x[1])]) == len({r for r, s in zip(root, sets) if s})
    assert len([x for x in got if not brute.shingles(x[1])]) == len([s for s in sets if not s])


def test_partenum_signatures_of_pairs_at_the_threshold():
    """Sets of just the least similarity share signatures in every size."""
    rnd = np.random.default_rng(3)
    for n in [3, 4, 5, 6, 7, 9, 12, 20, 33, 60, 100, 300, 1000, 4000]:
        for _ in range(6 if n < 500 else 2):
            pool = rnd.integers(0, 1 << 62, 3 * n).astype(np.uint64)
            common = math.ceil(0.75 * n)
            union = max(n, int(common / 0.75))
            a = np.unique(pool[:n])
            b = np.unique(np.concatenate([pool[:common], pool[n:n + union - n]]))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)).size, n


def test_large_signature_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    rows = []
    for i in range(12):  # three bases, each near-copied; all share a passage
        w = [f"b{i % 3}w{j}" for j in range(80)] + [f"p{j}" for j in range(60)]
        w[i % 80] = f"u{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    root = brute.groups([brute.shingles(t) for _, t in rows])
    same(got.select("doc_id", "component_id").collect(), list(enumerate(root)))


def test_passage_of_a_third_of_the_texts(spark):
    rnd = random.Random(3)
    passage = [f"p{j}" for j in range(50)]
    rows = []
    for i in range(300):
        base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(10, 90))]
        if rows and i % 5 == 0:  # a near copy of an earlier text, at times below the similarity
            base = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = f"e{i}"
        elif i % 3 == 0:
            base[rnd.randrange(len(base)):0] = passage
        rows.append((i, " ".join(base)))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    root = brute.groups([brute.shingles(t) for _, t in rows])
    same(got.select("doc_id", "component_id").collect(), list(enumerate(root)))


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(block)
    base = [f"b{j}" for j in range(60)]
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    about = ngram_join.nodes_of(ngram_join.set_sizes(docs))
    n = about.count()
    groups = about.selectExpr("7L AS sig", "node", "node % 4 AS root", f"{n}L AS size")
    found = {(r.a, r.b) for r in ngram_join.block_pairs(groups, about).collect()}
    sets = {ngram_join.node_of(s): set(s.tolist()) for s in ngram_join.shingle_sets(pa.array([t for _, t in rows]))}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and math.fmod(a, 4) != math.fmod(b, 4):
            assert (a, b) in found


def test_rare_keys_meet(spark):
    rnd = random.Random(9)
    sets = [set(range(40)) | {rnd.randrange(10 ** 9) for _ in range(rnd.randint(1, 30))} for _ in range(20)]
    for s in list(sets):
        sets.append(set(rnd.sample(sorted(s), len(s) - len(s) // 8)) | {rnd.randrange(10 ** 9) for _ in range(3)})
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, items array<long>")
    keys = defaultdict(set)
    for r in ngram_join.rare_keys(frame).collect():
        keys[r.node].add(r.sig)
    close = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2)
             if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(close) >= 10 and all(keys[a] & keys[b] for a, b in close)


def test_licenses(spark, odd, odd_rows, empty):
    extra = [(900, "x Licensed under the Apache License, Version 2.0. y", None, None),
             (901, "MIT license; mit  License cc by", None, None),
             (902, "this work is really licensed under the gnu general public license version 3", None, None),
             (903, "This work is licensed under a Creative Commons Attribution 4.0 International License", None, None)]
    rows = odd_rows + extra
    docs = spark.createDataFrame([(r[0], r[1], "z") for r in rows], "doc_id long, text string, label string")
    got = licenses.scan(docs)
    want = []
    for i, t, _, _ in rows:
        w = brute.ALNUM.findall((t or "").translate(brute.AZ))
        at = [(j, lab) for p, lab in licenses.PHRASES.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                     ",".join(sorted({x for _, x in at}))))
    same(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), want)
    labels = {r.doc_id: (r.labels, r.score) for r in got.collect()}
    assert labels[902] == ("gpl", 1.0) and labels[903][0] == "cc-by,cc-by-nc" and labels[903][1] > 0.9 and labels[4] == ("", 0.0)
    spans = {(r.label, r.first_word) for r in licenses.spans(docs).collect()}
    assert ("apache", 1) in spans
    assert licenses.scan(empty).count() == 0


def test_language(spark, odd, empty):
    rnd = np.random.default_rng(1)
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "ein", "ß"]}
    rows = [(i, " ".join(rnd.choice(parts[lang], 30)), lang) for i in range(200) for lang in [["en", "de"][i % 2]]]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 34 !", "de")], "doc_id long, text string, lang string")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs, ~out)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows)
    assert language.predict(odd, model).count() == odd.count()
    assert language.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    rnd = np.random.default_rng(2)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for j in range(0, 60, 12):
                w[j] = ["rottenly", "vileness", "hatefulx"][j // 12 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(i, ["", None, " \n"][i % 3]) for i in range(1000, 1030)]
    labels += [(i, 1, 0) for i in range(1000, 1030)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, known, ~out)
    got = toxicity.score(docs.withColumn("held_out", out), model).where("held_out").collect()
    right = sum((r.score >= toxicity.CUT) == (r.doc_id < 1000 and r.doc_id % 4 == 0) for r in got)
    assert right >= 0.95 * len(got)
    scored = toxicity.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == odd.count()
    assert toxicity.fit(docs, known.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.fit(empty, known, F.lit(True)) is None
    assert toxicity.score(empty, model).count() == 0


PERSONAL = [
    (300, "mail a.b+c@mail7.example.com, or x@y and @@q@r.st@u.vw", None, None),
    (301, "at 1.2.3.4.5.6.7.8 and 300.1.1.1 or 0001.2.3.255", None, None),
    (302, "card 4111 1111-1111 1111 or 4111111111111112 call +1 (555) 123-4567 or +12", None, None),
    (303, "a" * 20000 + "@" + "b." * 50 + " " + "9" * 20000 + " ٣@a.b 1２.3.4.5", None, None),
]


def test_personal_data(spark, odd_rows, empty):
    rows = odd_rows + PERSONAL
    docs = spark.createDataFrame([r[:2] + (7,) for r in rows], "doc_id long, text string, spans int")
    want = []
    for i, t, _, _ in rows:
        spans = brute.personal(t)
        n = Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha256(text.encode()).hexdigest(), text))
    same(pii.report(docs).collect(), want)
    assert pii.report(empty).count() == 0
    assert pii.sanitise(docs).where("doc_id = 302").first().text == "card [CARD] or 4111111111111112 call [PHONE] or +12"


def test_terms_that_give_an_entity_away(spark):
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 4))
    rows = []
    for i in range(60):
        left, right = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(12))
        who = "Zebulon" if i < 8 else word()
        mail = "z@site.org" if i < 8 else f"u{i}@site.org"
        rows.append((i, f"{left} the {who} {mail} {right}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    terms = {i: [r.text[s["start"]:s["end"]] for s in r.spans if s["kind"] == "term"] for i, r in got.items()}
    assert all(terms[i] == ["Zebulon"] for i in range(8)) and not any(terms[i] for i in range(8, 60))
    assert "Zebulon" not in pii.sanitise(docs).where("doc_id = 3").first().text


def planted(name="Zebulon", near=0):
    """60 texts, 8 of them with the name beside one address, or ``near`` words before it."""
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 4))
    words = lambda n: " ".join(word() for _ in range(n))
    return [(i, f"{words(12)} the {name if i < 8 else word()} {words(near)} {'z' if i < 8 else f'u{i}'}@site.org {words(12)}")
            for i in range(60)]


def found_terms(docs):
    return {r.doc_id: [r.text[s["start"]:s["end"]] for s in r.spans if s["kind"] == "term"] for r in pii.find(docs).collect()}


@pytest.mark.parametrize("copies", [10, 1000])
def test_terms_that_give_an_entity_away_in_copied_texts(spark, copies):
    rows = planted()
    docs = spark.createDataFrame(rows[:8] * copies + rows[8:], "doc_id long, text string").repartition(4)
    assert found_terms(docs) == {i: ["Zebulon"] if i < 8 else [] for i in range(60)}


def test_terms_in_fixed_wording_of_different_texts(spark):
    """One phrase, and so one context, in different texts; its other words stand elsewhere too."""
    rows = [(i, t.replace("Zebulon  z@site.org", "contact Dr Zebulon at z@site.org or call us now please"))
            for i, t in planted()]
    rows = [(i, t if i < 8 else f"{t} contact dr at or call us now please") for i, t in rows]
    # the name in two texts only is too little, however often these are copied
    rows += [(60 + i, f"note {'abcdefgh'[i % 2] * 3} Quentin at q@site.org or call") for i in range(6)]
    got = found_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {i: ["Zebulon"] if i < 8 else [] for i in range(66)}


@pytest.mark.parametrize("held", [pii.MAX_HELD, 0])
def test_terms_far_from_the_entity_and_in_other_texts(spark, monkeypatch, held):
    """Estimated over whole texts and masked in all of them, also with the terms joined instead of held."""
    monkeypatch.setattr(pii, "MAX_HELD", held)
    rows = planted(near=30) + [(60, "nobody else is called ZEBULON or zebulon@site.org but Zebulon"), (61, ""), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_terms(docs) == {i: ["Zebulon"] if i < 8 else ["ZEBULON", "Zebulon"] if i == 60 else [] for i in range(63)}
    assert pii.sanitise(docs).where("doc_id = 60").first().text == "nobody else is called  or [EMAIL] but "


def test_benchmark(spark, odd, odd_rows, empty):
    w = odd_rows[40][1].split()
    items = [(1, " ".join(w[3:18])), (10, " ".join(w[3:13]).upper() + "!"), (2, "One two"), (3, None), (4, "--"),
             (5, "nowhere to be seen in any of these texts at all"), (6, "same same same"), (7, "a b c d e f"), (8, "ſ K")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    rows = odd_rows + [(500, "ſ k k", None, None), (501, "ſ K", None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontamination.scan(docs, bench).collect()]
    want = [(i, *brute.hits(t, items)[:2], tuple(brute.hits(t, items)[2])) for i, t, _, _ in rows]
    same(got, want)
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not brute.hits(t, items)[1] for _, t, _, _ in odd_rows)
    assert decontamination.clean(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.report(empty, bench).count() == 0


def test_benchmark_without_broadcast(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_ROWS", -1)
    items = [(1, odd_rows[40][1][:120]), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_hit) for r in decontamination.scan(odd, bench).collect()]
    same(got, [(i, brute.hits(t, items)[1]) for i, t, _, _ in odd_rows])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x a"), (2, "b a"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("a", True), ("b", False)], "term string, keep boolean")
    index = decontamination.build_index(docs, terms)
    got = decontamination.proximity_matches(index, "a", "b", 2).select("place_a", "place_b").collect()
    same(got, [(5, 3), (1, 0)])


def test_no_python_in_the_benchmark_scan(spark, odd):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    plan = decontamination.build_index(odd, bench.selectExpr("'one' AS term", "true AS keep"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_passages(spark, odd_rows, empty):
    docs = spark.createDataFrame([r[:2] + ("h",) for r in odd_rows], "doc_id long, text string, hash string").repartition(3)
    want = [(r[0], *k) for r, k in zip(odd_rows, brute.kept_words([t for _, t, _, _ in odd_rows]))]
    same(passages.report(docs).collect(), want)
    assert passages.report(empty).count() == 0


@pytest.mark.parametrize("shards", [3, 40])
def test_resharding(spark, odd, odd_rows, empty, shards):
    old = F.coalesce(F.col("doc_id") % 50, F.lit(0))
    got = resharding.reshard(odd, old, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, shards,
                             F.coalesce("doc_id", F.lit(-1))).collect()
    same([(r.doc_id, r.text, r.size) for r in got], [(i, t, len((t or "").encode()) + 16) for i, t, _, _ in odd_rows])
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert resharding.reshard(empty, F.lit(0), F.lit(1).cast("long"), shards, F.col("doc_id")).count() == 0


def test_moved_bytes_are_least():
    blocks = [(0, 1, 10, 100), (0, 5, 10, 1000), (1, 1, 4, 40), (9, 2, 3, 60)]
    pieces = resharding.plan_moves(blocks, 3)
    size = {(s, k): b / n for s, k, n, b in blocks}
    assert sum(p[3] - p[2] for p in pieces) == 27
    # 27 rows in three shards of 9: shard 0 gives up 11 (its 10 light ones and a heavy one), shard 9 all 3
    assert sum((p[3] - p[2]) * size[p[0], p[1]] for p in pieces if p[0] != p[4]) == 10 * 10 + 100 + 60


def test_rewritten_shards_hold_their_rows(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    placed = resharding.reshard(rows, F.when(F.col("doc_id") < 70, 0).otherwise(1), F.lit(20).cast("long"), 4, F.col("doc_id"))
    touched = {r.shard for r in resharding.rewrite(placed, str(tmp_path / "out")).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    same(back.select("doc_id", "shard", "slot").collect(),
         [tuple(r) for r in placed.select("doc_id", "shard", "slot").collect() if r.shard in touched])


ODD_TEXTS = ["<|endoftext|><|startoftext|>x<|endoftext|", "ΑΣ ΟΔΟΣ İstanbul Kelvin K", "\x1c\x1d\x85x᠎y​z　w\xa0q",
             "don't  we'RE I'LL 'S ''s''t", "١٢٣ ½ ² x2y", "aaaa" * 900 + " " + "ab" * 900, "\x00\x01 中文字 😀👩‍👩‍👧", "é ſt ẞ ŉ ǅ"]


def test_bpe(spark, odd, odd_rows, empty):
    t = Tokenizer.from_file(PATH)
    rows = odd_rows + [(1000 + i, x, None, None) for i, x in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, PATH)
    same(bpe.token_digest(encoded).collect(), [(i, *brute.tokens(t, x)) for i, x, _, _ in rows])
    again = bpe.decode(encoded.withColumnRenamed("decoded", "first"), PATH)
    assert again.where("decoded != first").count() == 0
    assert bpe.encode(empty, PATH).count() == 0


def test_bpe_pairs_at_equal_symbols():
    enc = bpe.PairIndexEncoder(bpe.load_tokenizer(PATH))
    t = Tokenizer.from_file(PATH)
    words = ["a" * n for n in range(1, 40)] + ["abab" * 5, "lll", "oooooz"]
    ids, cut = enc.encode(words)
    for w, i, j in zip(words, cut[:-1], cut[1:]):
        assert ids[i:j].tolist() == t.encode(w, add_special_tokens=False).ids


def vectors(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rnd.normal(scale=0.12, size=8)).tolist(), i % 3) for i in range(90)]
    rows += [(100 + i, base[0].tolist(), 0) for i in range(6)]  # equal ones
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [1.0, None] * 4, 0), (204, [], 0),
             (205, base[0].tolist(), None), (206, [float("inf")] * 8, 1), (207, base[0][:4].tolist(), 0),
             (208, (base[0] * 1e200).tolist(), 0), (208, (base[0] * 1e-200).tolist(), 0)]
    return rows


@pytest.mark.parametrize("block", [7, 2048])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rows = vectors(block)
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<double>, label int, key string")
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in ok}
    cos = lambda a, b: a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)
    links = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
             and cos(unit[a], unit[b]) >= 0.93]
    n = Counter(x for pair in links for x in pair)
    root = brute.reachable(links, range(len(rows)))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root[i]].append(rows[i][0])
    want = [(rows[i][0], n[i], min(members[root[i]]), rows[i][0] == min(members[root[i]])) for i in range(len(rows))]
    same(embedding_join.range_join(df).collect(), want)


def test_no_embeddings(spark):
    assert embedding_join.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ngram_join_bounds_what_a_worker_holds(spark, monkeypatch):
    from filingscope.llm import ngram_join, toolkit

    seen = []
    monkeypatch.setattr(ngram_join, "map_slices", lambda *a, **k: seen.append(k.get("limit", toolkit.SLICE_BYTES)) or toolkit.map_slices(*a, **k))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    sized = ngram_join.set_sizes(docs)
    ngram_join.signature_rows(docs)
    ngram_join.sets_of(docs, sized, sized.select("node").where("node IS NOT NULL").distinct())
    assert seen == [ngram_join.SET_BYTES] * 3 and ngram_join.SET_BYTES <= 500_000
    toolkit.trim()
