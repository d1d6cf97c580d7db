"""Operator 13: token counts by prefix dynamic programming.

A piece model joins neighbouring symbols in the order of their scores.  Whatever is joined, any leading tokens of a
text's encoding are the encoding of their own text, and tokens stand beside each other in an encoding exactly when the
text of the two alone encodes to them.  So every prefix has one last token: the piece that ends there, starts where
another prefix ends, and goes with that prefix's last token; its count is that prefix's count plus one.  The table holds
the count at every prefix, as one signed byte a code point (the change from the prefix before), and questions on budgets
and cuts are answered from it, without the model.

No piece spans two code points that stand side by side in no piece, so a text falls into chunks there, counts add up over
chunks, and a chunk's table is made once for its repeats in a task.

Cases: null and empty text have no tokens and an empty table (a cut of it keeps 0 code points); code points outside the
vocabulary count one token a byte; control strings inside texts are plain text; a long text without cuts is one
chunk, in time linear in its length; repeated rows are counted alike; input columns named as the results are replaced.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.toolkit import map_slices

MAX_MODEL_BYTES = 64 << 20
SPACE = "▁"
#: Bounds of a worker's memory, not of what is counted: chunks and token pairs kept, code points of a kept chunk.
KEPT_CHUNKS, KEPT_PAIRS, KEPT_LENGTH = 150_000, 600_000, 64
NEVER = -math.inf


def load_model(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a score-ordered piece model with byte fallback and a leading space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, model.SentencePiece
    if (model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
        raise ValueError("expected a BPE piece model with byte fallback, a leading space and no normalisation")
    scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    if max(map(len, scores)) > 100:
        raise ValueError("pieces of over 100 code points need more than a byte a prefix")
    return scores


class PrefixTable:
    """Counts at every prefix of chunks, for one model.  Tokens are numbered from 1; 0 stands before a chunk."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        letters = sorted(set().union(*scores))
        self.code = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in scores:
            k = self.code[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True
        # letters without a piece of their own count their bytes
        self.tokens = ["", *scores, *(c for c in letters if c not in scores)]
        self.cost = [0, *[1] * len(scores), *(len(c.encode()) for c in self.tokens[len(scores) + 1:])]
        self.trie: dict[str, list] = {}  # code point -> [token that ends here or 0, nodes after it]
        for t, piece in enumerate(self.tokens[1:], 1):
            nodes = self.trie
            for c in piece:
                node = nodes.setdefault(c, [0, {}])
                nodes = node[1]
            node[0] = t
        self.traces: dict[int, tuple[list, list] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def trace(self, token: int) -> tuple[list, list] | None:
        """How a token comes about: the score of each join in turn, with the last and the first symbol before it.

        None if the token's own text doesn't encode to it.  Both lists end with the whole token, never joined further.
        """
        known = self.traces.get(token, 0)
        if known == 0:
            parts, score = list(self.tokens[token]), self.scores.get
            right, left = [], []
            while len(parts) > 1:
                joined = [score(x + y, NEVER) for x, y in zip(parts, parts[1:])]
                best = max(joined)
                if best == NEVER:
                    break
                right.append((best, parts[-1]))
                left.append((best, parts[0]))
                at = joined.index(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            right.append((NEVER, parts[-1]))
            left.append((NEVER, parts[0]))
            known = self.traces[token] = (right, left) if len(parts) == 1 else None
        return known

    def stand(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b encodes to just these two (to b alone where a is 0).

        Both come about as they do alone, in the order of scores, unless a join across their border has a
        higher score than the next ones inside (on equal scores the one further left goes first).
        """
        first, second = self.trace(a) if a else None, self.trace(b)
        known = second is not None
        if a and known:
            right, left, score, i, j = first[0], second[1], self.scores.get, 0, 0
            while True:
                (inner, x), (other, y) = right[i], left[j]
                across = score(x + y, NEVER)
                if across > inner and across >= other:
                    known = False
                    break
                if inner == NEVER and other == NEVER:
                    break
                if inner >= other:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def table(self, chunk: str) -> bytes:
        """The change of the count at each prefix of a chunk, as signed bytes; kept until as many newer ones were used."""
        out = self.older.get(chunk) or self.made(chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self.tables) >= KEPT_CHUNKS:
                self.older, self.tables = self.tables, {}
            self.tables[chunk] = out
        return out

    def made(self, chunk: str) -> bytes:
        n = len(chunk)
        if n == 1 and chunk not in self.trie:
            return bytes([len(chunk.encode())])
        last, count = [0] * (n + 1), [0] * (n + 1)
        trie, pairs, cost = self.trie, self.pairs.get, self.cost
        for i in range(n):
            before, c, nodes = last[i], count[i], trie
            for j in range(i, n):
                node = nodes.get(chunk[j])
                if node is None:
                    break
                token, nodes = node
                if token and not last[j + 1]:
                    good = pairs(before << 32 | token)
                    if good is None:
                        good = self.stand(before, token)
                    if good:
                        last[j + 1], count[j + 1] = token, c + cost[token]
        return bytes([y - x & 255 for x, y in zip(count, count[1:])])

    def changes(self, texts: list[str | None]) -> list[bytes]:
        """For each text the change of the count at each of its prefixes, as signed bytes."""
        whole = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        body = "".join(whole)
        if not body:
            return [b""] * len(texts)
        code = self.code[np.frombuffer(body.encode("utf-32-le"), np.uint32)]
        cuts = np.zeros(len(code) + 1, bool)
        cuts[1:-1] = ~self.beside[code[:-1], code[1:]]
        ends = np.cumsum([0, *map(len, whole)])
        cuts[ends] = True
        at = np.flatnonzero(cuts)
        first = np.searchsorted(at, ends).tolist()
        at = at.tolist()
        parts = []
        for i, j in zip(at, at[1:]):  # the dictionary may be changed for a new one meanwhile
            c = body[i:j]
            parts.append(self.tables.get(c) or self.table(c))
        out = []
        for i, t in enumerate(whole):
            got = b"".join(parts[first[i]:first[i + 1]]) if t else b""
            # the leading space is no prefix of the text: its token is counted with the first code point
            out.append(np.int8(np.int8(got[0]) + np.frombuffer(got[1:2], np.int8)[0]).tobytes() + got[2:] if t else b"")
        return out


def prefix_table(docs: DataFrame, model: str, text: str = "text", n_tokens: str = "n_tokens",
                 changes: str = "prefix_changes") -> DataFrame:
    """Every row with the token count of its whole text and the table of its prefixes.

    ``changes``: one signed byte a code point; the sum of the first p is the exact token count of the first p
    code points.  The model (a few MB, checked) is read on the driver and broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_model(model))
    frame = docs.select(*[c for c in docs.columns if c not in (n_tokens, changes)])
    held: dict[str, PrefixTable] = {}

    def fn(batch):
        if not held:
            held["table"] = PrefixTable(spec.value)
        got = held["table"].changes(batch.column(text).to_pylist())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in got], pa.int64()),
             pa.array(got, pa.binary())], names=[*batch.schema.names, n_tokens, changes])

    schema = frame.select("*", F.lit(0).cast("long").alias(n_tokens), F.lit(b"").alias(changes)).schema
    return map_slices(frame, fn, schema, column=text, done=held.clear)


def answered(table: DataFrame, column: str, answer: Callable[[np.ndarray, list], list], asked: str | None, changes: str) -> DataFrame:
    """Add ``column`` (long): ``answer(counts at prefixes 1..n, asked value)`` of every row."""
    frame = table.select(*[c for c in table.columns if c != column])

    def fn(batch):
        values = batch.column(asked).to_pylist() if asked else [None] * batch.num_rows
        out = [None if x is None else answer(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64), v)
               for x, v in zip(batch.column(changes).to_pylist(), values, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, column])

    return map_slices(frame, fn, frame.select("*", F.lit(None).cast("long").alias(column)).schema, column=changes)


def count_at(table: DataFrame, position: str, column: str = "tokens_before", changes: str = "prefix_changes") -> DataFrame:
    """Token count of each text's first ``position`` code points (a column; null gives null, ends are clamped)."""
    def answer(counts, p):
        return None if p is None else 0 if p <= 0 or not len(counts) else int(counts[min(p, len(counts)) - 1])

    return answered(table, column, answer, position, changes)


def cut_at(table: DataFrame, budget: int, column: str = "cut_chars", changes: str = "prefix_changes") -> DataFrame:
    """Code points of each text's longest prefix of at most ``budget`` tokens (counts may fall again as a piece closes)."""
    def answer(counts, _):
        fit = np.flatnonzero(counts <= budget)
        return int(fit[-1]) + 1 if len(fit) else 0

    return answered(table, column, answer, None, changes)


def packed_into(table: DataFrame, budget: int, column: str = "n_windows", changes: str = "prefix_changes") -> DataFrame:
    """Windows of at most ``budget`` tokens that the whole text's tokens fill (0 without tokens)."""
    def answer(counts, _):
        return -(-int(counts[-1]) // budget) if len(counts) else 0

    return answered(table, column, answer, None, changes)
