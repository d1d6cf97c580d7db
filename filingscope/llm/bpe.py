"""Operator 9: BPE encoding and decoding with a pair occurrence index.

Distinct pre-tokens of a slice are laid out as one chain of symbols.  An index maps every mergeable pair (by its rank)
to all its positions; ranks are taken in ascending order from a heap, each merge is done at all listed positions at
once (numpy) and the neighbours' new pairs join the lists.  Encoded words are kept for the rest of the task, so each is merged once.

The tokenizer file is read on the driver (a few MB, checked) and broadcast.  Results equal the file's own library:
special tokens are found in the raw text, the rest is NFC-normalised, lower-cased and split, spaces are dropped.

Cases: null and empty text give no tokens and an empty decoded text; a long text without spaces is one chain (heap
based, n log n); repeated rows are encoded alike; every input column is kept, but columns named as the
results are replaced.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import map_slices

MAX_TOKENIZER_BYTES = 64 << 20
#: Words kept per task before the memory is started anew (an upper bound on memory, not on what is encoded).
KEPT_WORDS = 80_000
#: New words merged in one index, and text bytes looked through for them at once: a large index spreads its cost.
INDEX_WORDS = 60_000
ENCODE_BYTES = 2_000_000

END = "</w>"
#: Starts the name of a special token among chunks; a space, so no chunk of text starts with it.
MARK = " "
# Fixed value: the pre-token pattern of the public word-level BPE vocabulary; \s is spelled out as Unicode white space.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def load_tokenizer(path: str) -> dict:
    """The parts of a word-level BPE ``tokenizers`` file that encoding needs."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is over {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        raise ValueError("expected a BPE model with word ends")
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    alphabet = byte_alphabet()
    tokens = {i: t for t, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens.update({i: t for t, i in special.items()})
    return {
        "inner": [vocab[c] for c in alphabet],
        "last": [vocab[c + END] for c in alphabet],
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
        "tokens": tokens,
        "special": special,
    }


class PairIndexEncoder:
    """Merges words by a pair occurrence index over all words given at once.

    A symbol's place is its number in the chain of all words; ``where`` maps the rank of a pair to arrays of places.
    """

    def __init__(self, spec: dict):
        import numpy as np

        self.inner = np.array(spec["inner"], np.int64)
        self.last = np.array(spec["last"], np.int64)
        self.merges = spec["merges"]
        merges = np.array(self.merges, np.int64).reshape(-1, 3)
        keys, first = np.unique(merges[:, 0] << 20 | merges[:, 1], return_index=True)  # the earliest rank of a pair
        self.keys, self.ranks = keys, first
        # a merged token must not take part in an earlier rank, else one pass over a rank's places would be too early
        made = np.full(int(merges.max(initial=0)) + 1, -1, np.int64)
        np.maximum.at(made, merges[:, 2], np.arange(len(merges)))
        if (np.maximum(made[merges[:, 0]], made[merges[:, 1]]) >= np.arange(len(merges)))[first].any():
            raise ValueError("a merge uses a token that a later merge makes")

    def rank(self, left, right):
        """Rank of each pair of symbols, or -1."""
        import numpy as np

        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[str]):
        """All words' token ids in one array, and where each word's ids start (one more entry than words)."""
        import numpy as np

        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        body = np.frombuffer(b"".join(raw), np.uint8)
        n = len(body)
        sym = self.inner[body]
        sym[ends - 1] = self.last[body[ends - 1]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[np.concatenate([[0], ends[:-1]])] = -1

        where: dict[int, list] = {}
        active: list[int] = []

        def add(places, ranks):
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for r, i, j in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r not in where:
                    where[r] = []
                    heapq.heappush(active, r)
                where[r].append(places[i:j])

        left = np.flatnonzero(nxt >= 0)
        ranks = self.rank(sym[left], sym[nxt[left]])
        if (ranks >= 0).any():
            add(left[ranks >= 0], ranks[ranks >= 0])
        while active:
            r = heapq.heappop(active)
            a, b, merged = self.merges[r]
            listed = where.pop(r)
            p = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
            p = p[sym[p] == a]
            q = nxt[p]
            ok = (q >= 0) & (sym[q] == b)
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # in a run of equal symbols every other place merges, from the left
                run = np.concatenate([[True], q[:-1] != p[1:]])
                at = np.arange(len(p))
                ok = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
                p, q = p[ok], q[ok]
            after = nxt[q]
            sym[p], sym[q], nxt[p] = merged, -1, after
            prv[after[after >= 0]] = p[after >= 0]
            before = prv[p]
            places = np.concatenate([p[after >= 0], before[before >= 0]])
            if len(places):
                ranks = self.rank(sym[places], sym[nxt[places]])
                if (ranks >= 0).any():
                    add(places[ranks >= 0], ranks[ranks >= 0])
        live = sym >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        return sym[live], counts[np.concatenate([[0], ends])]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (binary: token ids as little-endian unsigned 32-bit integers) and ``decoded`` (their text)."""
    docs = docs.drop(ids, decoded)
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_tokenizer(tokenizer))
    held: dict = {}

    def setup():
        import regex

        special = sorted(spec.value["special"], key=len, reverse=True)
        held["encoder"] = PairIndexEncoder(spec.value)
        held["ids"], held["plain"] = {}, {}
        held["find"] = regex.compile(PRETOKEN + r"|\n").findall  # a line end parts two chunks
        held["separators"] = regex.compile(r"[\x1c-\x1f]").search  # str.split() parts here, the vocabulary doesn't
        held["chunks"] = regex.compile(f"[^{SPACE}]+").findall
        held["special"] = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def chunks(text: str) -> list[str]:
        return held["chunks"](text) if held["separators"](text) else text.split()

    def chunks_of(text: str | None) -> list[str]:
        """The text between white space; no token reaches over it.  A special token is marked and stands alone."""
        if not text:
            return []
        special = spec.value["special"]
        if not any(s in text for s in special):
            return chunks(text)
        out = []
        for part in held["special"](text):
            out += [MARK + part] if part in special else chunks(part)
        return out

    def learn(new: list[str]) -> None:
        # all new chunks are normalised and split at once; each code point is lower-cased by itself: no final sigma
        joined = unicodedata.normalize("NFC", "\n".join(new) + "\n").replace("Σ", "σ").lower()
        found = held["find"](joined)
        stops = [i for i, w in enumerate(found) if w == "\n"]
        got, cut = held["encoder"].encode([w for w in found if w != "\n"])
        packed, plain = got.astype("<u4").tobytes(), list(map(spec.value["tokens"].__getitem__, got.tolist()))
        ends = cut[[x - i for i, x in enumerate(stops)]].tolist()
        i = 0
        ids_of, plain_of = held["ids"], held["plain"]
        for c, j in zip(new, ends, strict=True):
            ids_of[c] = packed[4 * i:4 * j]
            plain_of[c] = plain[i] if j == i + 1 else " ".join(plain[i:j])
            i = j

    def fn(batch):
        if not held:
            gc.disable()  # millions of small objects without cycles
            setup()
        texts = [chunks_of(t) for t in batch.column(text).to_pylist()]
        if len(held["ids"]) > KEPT_WORDS:
            held["ids"], held["plain"] = {}, {}
        for s, i in spec.value["special"].items():
            held["ids"][MARK + s], held["plain"][MARK + s] = i.to_bytes(4, "little"), s
        new = list(set().union(*texts).difference(held["ids"]))
        for at in range(0, len(new), INDEX_WORDS):
            learn(new[at:at + INDEX_WORDS])
        ids_of, plain_of = held["ids"].__getitem__, held["plain"].__getitem__
        packed = [b"".join(map(ids_of, cs)) for cs in texts]
        plain = [" ".join(map(plain_of, cs)) for cs in texts]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(packed, pa.binary()), pa.array(plain, pa.string())],
            names=[*batch.schema.names, ids, decoded])

    schema = docs.select("*", F.lit(b"").alias(ids), F.lit("").alias(decoded)).schema
    def done():
        held.clear()
        gc.enable()

    return map_slices(docs, fn, schema, column=text, limit=ENCODE_BYTES, done=done)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace or add ``decoded``: the tokens of the packed ``ids``, joined as the library joins them."""
    spec = rows.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer)["tokens"])
    kept = [c for c in rows.columns if c != decoded]

    def run(batches):
        import numpy as np

        for batch in batches:
            plain = [None if x is None else " ".join([spec.value[i] for i in np.frombuffer(x, "<u4").tolist()])
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.string())],
                                             names=[*batch.schema.names, decoded])

    frame = rows.select(*kept)
    return frame.mapInArrow(run, frame.select("*", F.lit("").alias(decoded)).schema)


def token_digest(encoded: DataFrame) -> DataFrame:
    """The query's columns from an encoded frame."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
