"""The registered queries opN_<name> and ``pipeline``: thin selections over the operators of this subpackage."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm import (bpe, decontamination, divergence, embedding_join, language, licenses, ngram_join, passages, pii,
                             prefix_counts, resharding, spelling, toxicity)
from filingscope.llm.registry import ORACLE, QUERIES, register, table

__all__ = ["ORACLE", "QUERIES"]


@register("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digest(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")))


# Words and 5-word shingles of every text, links by exact set sizes, components by recursion.
NGRAM_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""


@register("op1_ngram_jaccard_join", NGRAM_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op8_reshard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "source")
    # the old layout: a shard for each source, hashed to 32, so a hot source is a hot old shard
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32))
    placed = resharding.reshard(docs, old, F.col("text_bytes") + resharding.OVERHEAD, 40, F.col("doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


# All runs of as many words as some window has, joined to the windows as strings.
BENCHMARK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
             lambda x: array_to_string(w[x:x+9], ' '))) AS p FROM b WHERE len(w) > 0),
g AS (SELECT doc_id, k, j, array_to_string(w[j:j+k-1], ' ') AS p
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
m AS (SELECT DISTINCT g.doc_id, g.j, g.k, i.item_id FROM g JOIN i ON g.k = i.k AND g.p = i.p),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@register("op6_positional_index", BENCHMARK_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(i, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT i, min(c) AS c FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings JOIN m ON m.i = vec_id LEFT JOIN n ON n.a = vec_id
"""


@register("op10_metric_range_join", VECTOR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.range_join(table(spark, sf_dir, "embeddings"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS p
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT d.doc_id, x.i, w[x.i] AS v FROM d, unnest(range(1, len(w) + 1)) AS x(i)),
t AS (SELECT k.doc_id, string_agg(v, ' ' ORDER BY k.i) AS kept
      FROM k ANTI JOIN c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@register("op7_phrase_automata", REPEATS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs, ~out)
    return language.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs.select("doc_id", out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@register("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


# Keyed slips by a table-driven CRC-32, then words that share the word left after taking out one code point.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                       ORDER BY i) AS v FROM range(256) AS r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, w, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, hex(encode(d || w)) AS x FROM o),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2),
        lambda i: ((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
        lambda c, y: xor(t.v[xor(c, y) % 256 + 1], c >> 8)), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, n FROM h),
k AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
g AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS z FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM k)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.z = b.z AND a.i = b.i AND a.word <> b.word
      UNION SELECT DISTINCT g.word, k.word, k.n FROM g JOIN k ON k.word = g.z
      UNION SELECT DISTINCT k.word, g.word, g.n FROM g JOIN k ON k.word = g.z),
q AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r FROM p),
f AS (SELECT k.word, k.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN q.n >= 5 * k.n THEN q.near END AS form,
             CASE WHEN q.n >= 5 * k.n THEN q.n END AS form_n FROM k LEFT JOIN q ON q.word = k.word AND q.r = 1),
e(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, e.root FROM f JOIN e ON f.form = e.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""


@register("op11_spelling_variants", SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# Every group of a language against every kept term, on whole numbers.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
      FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
x AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
      UNION ALL
      SELECT a.lang, a.source, 'pair', b.source, coalesce(s, 0) FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) t
        ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
r AS (SELECT lang, source, part, item, value::BIGINT AS value,
             row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


@register("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counts = prefix_counts.prefix_table(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
    return prefix_counts.cut_at(counts, 4096, "limit_chars").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "limit_chars")


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
