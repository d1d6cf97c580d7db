"""Operator 5: information-theoretic sanitisation of personal data.

Base spans: e-mail addresses, IPv4 addresses, payment cards and phone numbers by fixed patterns.  They are the
protected entities.  Other words can give an entity away even when it is masked: for each entity value and each word
outside base spans, the distinct texts with both are counted, as are all with the word, and all with the entity.  A
term's disclosure about an entity is the pointwise mutual information of the two, scaled to 0..1 by the entity's own
information (1: the term names the entity).  A term that DISCLOSURE or more, in at least LEAST_SHARED distinct texts with
the entity, becomes a span too, wherever it stands outside base spans, in any text.

Copies of a text say nothing new: every count is of distinct texts.  Words too frequent to reach DISCLOSURE with an entity
are left out before pairs are counted; the bound is exact.  Sanitising replaces base spans and terms of several entities
by their kind (generalised) and drops terms that name exactly one entity (removed).

Cases: null and empty text have no spans; spans of different kinds may overlap (masking merges them); offsets are code
points, end exclusive; repeated rows get equal spans; an empty table gives no rows; a column
named spans is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import cut, map_slices, slices, text_key

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.8
LEAST_SHARED = 3
MAX_BROADCAST_ROWS = 1_000_000
#: Entities, frequent words or terms that each Python worker may hold.
MAX_HELD = 100_000
#: Counts and word hashes that a Python worker holds at once.
HELD_COUNTS = 50_000

# The patterns of the base kinds.  Matches are leftmost and do not overlap; look-behinds only spare
# attempts that would start inside a longer match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, which is linear also in long runs without one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:].lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


WORD = re.compile(r"[^\W\d_]{2,}")


def words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words (lower-cased) outside the base spans, with their spans."""
    at = 0
    for start, end in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        for m in WORD.finditer(text, at, max(at, start)):
            yield m[0].lower(), m.start(), m.end()
        at = max(at, end)


def entity_value(kind: str, raw: str) -> str:
    """One spelling of an entity: its digits, or the lower-cased address."""
    return f"{kind}:{raw.lower() if kind == 'email' else re.sub('[^0-9.]' if kind == 'ip' else '[^0-9]', '', raw)}"


def hash64(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


class Hashes(dict):
    """Word (any case) to the hash of its lower-cased form; at most HELD_COUNTS words are held."""

    def __missing__(self, word):
        if len(self) >= HELD_COUNTS:
            self.clear()
        self[word] = out = hash64(word.lower())
        return out


#: Of this Python worker; emptied at the end of each task.
HASHES = Hashes()


def copied(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (key, text) with ``copies``, how many rows have the text, and the number of distinct texts.

    The keys of texts that stand more than once are broadcast when they are counted to be few.
    """
    keys = cut(docs.groupBy("key").agg(F.count("*").alias("copies")))
    more = keys.where("copies > 1")
    more = F.broadcast(more) if more.count() <= MAX_BROADCAST_ROWS else more
    return docs.join(more, "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1))), keys.count()


def counted(docs: DataFrame, of: Callable[[str], Iterable], names: list[str]) -> DataFrame:
    """(names, copies, rows): how many rows hold what ``of`` gives for a text, summed in each task first.

    ``of`` gives distinct numbers for one name, distinct tuples for more.
    """

    def run(batches):
        import pyarrow.compute  # noqa: F401  (loads pa.compute in the worker)

        once, more = Counter(), Counter()
        try:
            for part in (p for batch in batches for p in slices(batch, "text")):
                for text, n in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), strict=True):
                    for some in batched(of(text), HELD_COUNTS):
                        if n == 1:
                            once.update(some)
                        else:
                            more.update((x, n) for x in some)
                        if len(once) + len(more) > HELD_COUNTS:
                            yield flush(once, more)
                            once.clear()
                            more.clear()
            yield flush(once, more)
        finally:  # workers live on
            once.clear()
            more.clear()
            HASHES.clear()
            pa.default_memory_pool().release_unused()

    def flush(once, more):
        keys = [*once, *(x for x, _ in more)]
        cols = [keys] if len(names) == 1 else list(zip(*keys, strict=True)) or [[]] * len(names)
        cols += [[1] * len(once) + [n for _, n in more], [*once.values(), *more.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*names, "copies", "rows"])

    return docs.select("text", "copies").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "copies", "rows"]))


def texts_of(rows: DataFrame, names: list[str], total: str) -> DataFrame:
    """(names, total): distinct texts, from ``counted`` rows; a text of n copies is n of the rows with copies = n."""
    each = rows.groupBy(*names, "copies").agg(F.sum("rows").alias("rows"))
    return each.groupBy(*names).agg(F.sum(F.expr("rows div copies")).alias(total))


def text_entities(text: str) -> set[int]:
    return {hash64(entity_value(kind, text[a:b])) for kind, a, b in base_spans(text)}


def text_words(text: str, spans: list[tuple[str, int, int]] | None = None) -> set[int]:
    """Hashes of the words outside the base spans (given, or found here)."""
    spans = base_spans(text) if spans is None else spans
    found = {w for w, _, _ in words(text, spans)} if spans else set(WORD.findall(text))
    return set(map(HASHES.__getitem__, found))


def entity_words(bound: dict[int, float] | None, frequent: dict[int, int]) -> Callable[[str], Iterator[tuple[int, int]]]:
    """(entity, word) of a text, for the entities in ``bound`` and words that stand in so many texts at most.

    ``bound`` None: all entities and words.  ``frequent`` has the texts of the most frequent words.
    """

    def of(text):
        own = [e for e in text_entities(text) if bound is None or e in bound]
        if own:
            terms = [(w, frequent.get(w, 0)) for w in text_words(text)]
            for e in own:
                most = math.inf if bound is None else bound[e]
                yield from ((e, w) for w, n in terms if n <= most)

    return of


def disclosures(docs: DataFrame) -> DataFrame | None:
    """(entity, term, disclosure, entities): pairs at or over the threshold, and how many entities the term names.

    None if no entity stands in LEAST_SHARED texts.
    """
    keyed = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    keyed, total = copied(keyed)
    entity = cut(texts_of(counted(keyed, text_entities, ["entity"]), ["entity"], "of_entity")
                 .where(F.col("of_entity") >= LEAST_SHARED))
    n_entities = entity.count()
    if not n_entities:
        return None
    terms = cut(texts_of(counted(keyed, text_words, ["term"]), ["term"], "of_term").where(F.col("of_term") >= LEAST_SHARED))
    # shared <= of_entity, so a score of DISCLOSURE needs of_term <= of_entity * p_entity ** (DISCLOSURE - 1)
    bound, frequent = None, {}
    if n_entities <= MAX_HELD:
        bound = {r.entity: (1 + 1e-9) * r.of_entity * (r.of_entity / total) ** (DISCLOSURE - 1) for r in entity.collect()}
        often = terms.where(F.col("of_term") > min(bound.values())).orderBy(F.desc("of_term"), "term").limit(MAX_HELD)
        frequent = {r.term: r.of_term for r in often.collect()}
    pairs = texts_of(counted(keyed, entity_words(bound, frequent), ["entity", "term"]), ["entity", "term"], "shared")
    entity = F.broadcast(entity) if n_entities <= MAX_BROADCAST_ROWS else entity
    joined = pairs.where(F.col("shared") >= LEAST_SHARED).join(entity, "entity").join(terms, "term")
    # how many of the term's texts hold the entity, against the entity's share of all texts
    p_given_term = F.col("shared") / F.col("of_term")
    p_entity = F.col("of_entity") / F.lit(float(total))
    score = F.when(p_entity < 1, F.log(p_given_term / p_entity) / -F.log(p_entity)).otherwise(0.0)
    strong = cut(joined.withColumn("disclosure", score).where(F.col("disclosure") >= DISCLOSURE))
    named = strong.groupBy("term").agg(F.count("*").alias("entities"))
    return strong.join(named, "term").select("entity", "term", "disclosure", "entities")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, action), base kinds first, then terms by start."""
    docs = docs.drop("spans")
    own = docs.columns
    strong = disclosures(docs.select("text"))
    named, many = {}, None
    if strong is not None:
        terms = cut(strong.groupBy("term").agg(F.max("entities").alias("entities")))
        if terms.count() <= MAX_HELD:
            named = {r.term: r.entities for r in terms.collect()}
        else:
            many = terms
    held, joined = docs, many is not None
    if joined:  # each text gets the terms it holds
        def holds(batch):
            rows = [(key, w) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for w in text_words(text)]
            cols = list(zip(*rows, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64())], names=["key", "term"])

        keyed = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
        of_text = (map_slices(keyed, holds, "key binary, term long", done=HASHES.clear).join(many, "term").groupBy("key")
                   .agg(F.collect_set(F.struct("term", "entities")).alias("__terms")).withColumnRenamed("key", "__text_key"))
        held = docs.withColumn("__text_key", text_key(F.col("text"))).join(of_text, "__text_key", "left").select(*own, "__terms")

    def spans(text, named):
        found = base_spans(text)
        out = [{"kind": k, "start": a, "end": b, "action": "generalise"} for k, a, b in found]
        if named and not named.keys().isdisjoint(text_words(text, found)):
            for w, a, b in words(text, found):
                n = named.get(HASHES[w])
                if n:
                    out.append({"kind": TERM, "start": a, "end": b, "action": "remove" if n == 1 else "generalise"})
        return out

    def fn(batch):
        texts = batch.column("text").to_pylist()
        given = [named] * len(texts) if not joined else [
            {t["term"]: t["entities"] for t in x or []} for x in batch.column("__terms").to_pylist()]
        got = [spans(t, n if t else None) for t, n in zip(texts, given, strict=True)]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(got, pa.list_(kind))], names=[*own, "spans"])

    shape = "array<struct<kind:string,start:bigint,end:bigint,action:string>>"
    return map_slices(held, fn, docs.withColumn("spans", F.array().cast(shape)).schema, done=HASHES.clear)


def masked(text: str, spans: list[dict]) -> str:
    """The text with generalised spans as [KIND] and removed ones left out; overlapping spans become the first's."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out.append(text[at:s["start"]])
            if s["action"] == "generalise":
                out.append(f"[{s['kind'].upper()}]")
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans' text generalised or removed (the same columns; null text stays null)."""

    held = docs.withColumnRenamed("spans", "__spans")  # a column of that name stays as it is
    names = held.columns

    def fn(batch):
        plain = [t if t is None or not s else masked(t, s) for t, s in
                 zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        cols = [pa.array(plain, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_slices(find(held), fn, held.schema).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = find(docs.select("doc_id", "text"))

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
