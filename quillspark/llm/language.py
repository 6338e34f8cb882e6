"""A language model of fixed size, counted over a whole column of texts.

Character n-grams (1 to 3) and words are counted into hashed tables whose size does not depend on the corpus; each task
sends one row per bucket that it touched, the sums are at most as many rows as there are buckets. The alphabet (distinct
characters, bounded by Unicode) is kept with its counts. Counts have 64 bits. Where a corpus is so rich that most buckets
are in use, what a bucket holds by collisions alone (the median of its table) is taken off all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of each table: character pairs, character triples, words.
SIZES = {2: 1 << 18, 3: 1 << 20, 4: 1 << 20}
WORD = re.compile(r"[^\W\d_一-鿿]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def bucket(kind: int, s: str) -> int:
    """Bucket of a pair (2) or triple (3) of characters, or of a word (4)."""
    if kind == 4:
        return zlib.crc32(s.encode("utf-8", "surrogatepass")) % SIZES[4]
    h = 0
    for c, m in zip(s, _MIX):
        h += ord(c) * m
    h &= _MASK
    return ((h ^ (h >> 29)) * _MIX[1] & _MASK) >> (65 - SIZES[kind].bit_length())


def buckets(codes: np.ndarray, kind: int) -> np.ndarray:
    """``bucket`` of all pairs or triples of a text's code points."""
    n = len(codes) - kind + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = codes[:n] * np.uint64(_MIX[0])
    for k in range(1, kind):
        h += codes[k : k + n] * np.uint64(_MIX[k])
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MIX[1])
    return (h >> np.uint64(65 - SIZES[kind].bit_length())).astype(np.int64)


class Counts:
    """Counts of some texts, each with one blank at either end."""

    def __init__(self) -> None:
        self.chars: Counter = Counter()
        self.tables = {k: np.zeros(n, np.int64) for k, n in SIZES.items()}

    def add(self, texts: list[str], words: bool = True) -> None:
        lo = 0
        while lo < len(texts):  # about a million characters at once
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 20):
                size += len(texts[hi])
                hi += 1
            self._add(texts[lo:hi], words)
            lo = hi

    def _add(self, texts: list[str], words: bool) -> None:
        # one text with a sign between that no text holds; n-grams with it are left out
        joined = " \U0010ffff ".join(["", *(t.replace("\U0010ffff", " ") for t in texts), ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = codes != 0x10FFFF
        n = np.bincount(codes[inside])
        at = np.flatnonzero(n)
        self.chars.update(dict(zip(map(chr, at.tolist()), n[at].tolist())))
        self.chars[" "] -= 2  # what stands before the first and after the last sign
        wide = codes.astype(np.uint64)
        for kind in (2, 3):
            whole = inside[: len(codes) - kind + 1].copy()
            for k in range(1, kind):
                whole &= inside[k : len(codes) - kind + 1 + k]
            self.tables[kind] += np.bincount(buckets(wide, kind)[whole], minlength=SIZES[kind])
        if words:
            for w, m in Counter(WORD.findall(joined.lower())).items():
                self.tables[4][bucket(4, w)] += m

    def rows(self) -> pd.DataFrame:
        """(kind, bucket, n); kind 1 are the characters."""
        parts = [(np.full(len(self.chars), 1), np.array([ord(c) for c in self.chars], np.int64), np.array(list(self.chars.values()), np.int64))]
        for k, t in self.tables.items():
            at = np.flatnonzero(t)
            parts.append((np.full(len(at), k), at, t[at]))
        kind, at, n = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"kind": kind.astype(np.int32), "bucket": at.astype(np.int32), "n": n.astype(np.int64)})


def narrow(table: np.ndarray) -> np.ndarray:
    """In 32 bits, where all counts fit."""
    return table.astype(np.int32) if not table.size or table.max() < 1 << 31 else table


class Language:
    """Counts as arrays; cheap to send to the workers (18 MB and the alphabet)."""

    def __init__(self, chars: dict[str, int], tables: dict[int, np.ndarray]):
        self.chars = chars
        self.tables = {k: narrow(np.maximum(t - int(np.median(t)), 0)) for k, t in tables.items()}
        self.n_chars = sum(chars.values()) or 1
        self.n_words = int(self.tables[4].sum()) or 1
        self.memo: dict[str, float] = {}

    @classmethod
    def of(cls, texts: list[str]) -> Language:
        counts = Counts()
        counts.add(texts)
        return cls(dict(counts.chars), counts.tables)

    @classmethod
    def from_rows(cls, kind: np.ndarray, at: np.ndarray, n: np.ndarray) -> Language:
        tables = {}
        for k, size in SIZES.items():
            tables[k] = np.zeros(size, np.int64)
            tables[k][at[kind == k]] = n[kind == k]
        return cls({chr(c): int(m) for c, m in zip(at[kind == 1], n[kind == 1])}, tables)

    def char(self, a: str, b: str, c: str) -> float:
        """Log probability of ``c`` after ``a`` and ``b``: trigrams backed by pairs, characters and a floor."""
        key = a + b + c
        got = self.memo.get(key)
        if got is None:
            t, u = self.tables[3], self.tables[2]
            n1, n2 = self.chars.get(b, 0), int(u[bucket(2, a + b)])
            p = (self.chars.get(c, 0) + 1e-3) / (self.n_chars + 1200)
            p = (int(u[bucket(2, b + c)]) + 2 * p) / (n1 + 2)
            p = (int(t[bucket(3, key)]) + p) / (n2 + 1)
            got = self.memo[key] = math.log(min(1.0, p))
            if len(self.memo) > 400_000:
                self.memo.clear()
        return got

    def word(self, w: str) -> int:
        return int(self.tables[4][bucket(4, w.lower())])


def counted(column: DataFrame, keep: Callable[[str], bool] | None = None) -> Language:
    """The language of a one-column DataFrame of texts. Texts for which ``keep`` is false are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for batch in batches:
            counts.add([t for t in batch.iloc[:, 0].dropna() if keep is None or keep(t)])
        yield counts.rows()

    sums = column.mapInPandas(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # at most as many rows as buckets and characters of Unicode
    return Language.from_rows(*(got.column(i).to_numpy() for i in range(3)))
