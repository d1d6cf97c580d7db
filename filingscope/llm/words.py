"""Words of whole texts as numpy arrays: spans, 64-bit word hashes and rolling hashes over word runs.

Both word classes of this package are unions of byte ranges in UTF-8, so texts are split on their bytes: a table maps
every byte to 0 (between words) or to the byte that counts (A-Z lower-cased where asked).  Hashes are 64 bits of a
polynomial over random byte values, finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = bytes([0x20, *range(0x09, 0x0E)])
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C55 | 1
UNBASE = pow(BASE, -1, 1 << 64)


def byte_table(lower: bool, alphanumeric: bool) -> np.ndarray:
    """Byte -> byte that counts, 0 between words.  ``alphanumeric``: only digits, letters and non-ASCII are in words."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[0x41:0x5B] += 0x20
    if alphanumeric:
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
        t[~keep] = 0
    else:
        t[list(WHITE)] = 0
        t[0] = 0xFF  # a NUL belongs to words; no UTF-8 text holds this byte
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


class Words:
    """The words of all texts of one Arrow column slice.

    ``start``/``end``: byte spans in ``body``; ``doc``: row of each word; ``first``: index of each row's first word
    (one more entry than rows); ``hash``: 64 bits a word.
    """

    def __init__(self, column: pa.Array, table: np.ndarray, hashed: bool = True):
        column = column.cast(pa.large_binary())
        n = len(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
        data = column.buffers()[2]
        self.body = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        if column.null_count:  # a null may stand over bytes; they are no text
            bad = np.flatnonzero(np.asarray(column.is_null()))
            hide = np.zeros(len(self.body), bool)
            for i in bad:
                hide[off[i]:off[i + 1]] = True
        self.offsets = off
        self.seen = table[self.body]
        word = self.seen != 0
        if column.null_count:
            word &= ~hide
        size = len(word)
        edge = np.zeros(size + 1, bool)  # a text's end also ends its last word
        edge[off] = True
        before = np.concatenate([[False], word[:-1]]) if size else word
        after = np.concatenate([word[1:], [False]]) if size else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)
        if hashed:
            with np.errstate(over="ignore"):
                total = np.zeros(size + 1, np.uint64)
                np.cumsum(BYTE_VALUE[self.seen] * powers(BASE, size), out=total[1:])
                self.hash = mix((total[self.end] - total[self.start]) * powers(UNBASE, size + 1)[self.start])

    def __len__(self):
        return len(self.start)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (index of the first word) and hashes of all runs of k words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = rolling(self.hash, k)
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return inside, h[inside]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring hashes."""
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        if k <= 8:
            out = np.zeros(n, np.uint64)
            for j in range(k):
                out = out * np.uint64(BASE) + hashes[j:j + n]
        else:
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * powers(BASE, len(hashes)), out=total[1:])
            out = (total[k:] - total[:-k]) * powers(UNBASE, n)
        return mix(out + np.uint64(k))


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs."""
    return pa.array(x.view(np.int64))
