"""The scanner as a noisy channel: what it makes of characters, how often, and which words were meant.

A word as it stands is weighed against the words that the scanner's confusions would make of it: one or two confusions, each
with a probability learned from the corpus (how often rare words stand beside a frequent word that one confusion makes
of them, measured by how often the confused characters occur). What is meant is decoded by Viterbi search over the
candidate words of a line, under the corpus' word bigrams; a word without candidates is its own only one.

The corpus' words are a table, counted exactly; candidates come from joining the readings of each distinct word with it.
Only what decides about words with candidates is sent out: as one table while it is small, else the frequent words by
broadcast and the others by a join with the blocks they stand in. What is sent out besides has a fixed size: hashed
characters, word pairs and a count-min sketch of the words.

Decisions compare probabilities, so they do not move with the size of the corpus; absolute numbers stand only where little is
known (a word is known from its second occurrence on, its own occurrence is no evidence for it).
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.language import Counts, Language, narrow
from quillspark.tables import cut

# --- fixed values: what scanners make of characters (read as: meant) --------------------------------------------------
CONFUSIONS = {
    "0": "o", "1": "li", "5": "s", "6": "b", "8": "B", "9": "g", "@": "a", "$": "s", "I": "l", "l": "I", "c": "e", "e": "c", "f": "t", "t": "f", "b": "h", "h": "b", "u": "n", "n": "u",
    "O": "0", "|": "l", "!": "l",
}
MERGED = {"rn": "m", "cl": "d", "vv": "w", "ii": "u", "h": "li", "m": "in", "in": "m", "li": "h", "ri": "n", "nn": "m", "m ": "m", "d": "cl", "w": "vv"}
#: Han characters that are taken for one another.
HAN_ALIKE = [
    "大太犬", "天夭", "子孑孓", "未末", "日曰", "成戍戌", "己已巳", "人入", "土士", "千干于", "白自", "由田甲申", "间问", "元无", "力刀", "木本术", "体休", "侧测", "析折拆", "抑仰", "治冶", "今令",
    "免兔", "住往佳", "夫失", "牛午", "贝见", "名各", "广厂", "乌鸟", "母毋", "微徽", "侯候", "经径", "清请情", "壮状", "末朱", "旦且", "目日", "鸣呜", "辩辨", "撤撒", "傅传", "竟竞", "代伐", "季李", "特持", "组祖",
    "观现", "胞跑", "受爱", "织识", "因困", "血皿", "市巿", "王玉主", "为办", "有冇", "生主", "关美", "化比", "科料", "仅汉", "示未", "小少", "相柏", "研硏", "用甩", "同回", "表衰",
]
# ----------------------------------------------------------------------------------------------------------------------
#: A confusion's probability before any is seen, and the characters' worth of trust in it.
PRIOR, TRUST = 0.001, 2000.0
#: Candidates whose odds are below this (log) without context are none: no context outweighs it.
HOPELESS = -7.0
#: Copies of a text carry the same misreadings.
CLUSTER = 6.0
#: Words with candidates that are broadcast as one table (about 100 bytes each); beyond, those below one in 2^18 of all words are joined.
MOST_SENT, FREQUENT_SHARE = 1 << 18, 1 << 18
#: What is longer is no word (an address, a table's rule).
LONGEST = 64
#: Log costs of a Han character that is not, and that is, rare beside its look-alike.
HAN_COST, HAN_RARE_COST, HAN_RARE = 4.0, -1.0, 0.15

_ALIKE: dict[str, set[str]] = {}
for _group in HAN_ALIKE:
    for _c in _group:
        _ALIKE.setdefault(_c, set()).update(set(_group) - {_c})
HAN = re.compile("[" + "".join(_ALIKE) + "]")

WORD = re.compile(r"[^\W_]+(?:[@$|!]+[^\W_]+)*[@$]?")
#: As ``WORD``, but no halves of broken words (\x02 stands for the break), and texts' ends (\x01).
_WHOLE = re.compile(r"[^\W_]++(?:[@$|!]++[^\W_]++)*+[@$]?+(?!\x02)|\x01")
_BREAK = re.compile(r"[-‐‑¬­]\s*(?:\n\s*[^\s\x01]*|(?=\x01)|$)")
_HYPHEN = re.compile(r"[-‐‑¬­]")
_NEXT_LINE = re.compile(r"\s*\n\s*([^\W_]+(?:[@$|!]+[^\W_]+)*)?")
_RUN = re.compile(r"[^\W_]*")
_LINE_END = re.compile(r"[-‐‑¬­]\s*\n")
ROWS, WIDTH = 2, 1 << 21


def word_key(w: str) -> str:
    """Words in small letters, capitalised, or in capitals are the same; others stand for themselves."""
    return w if not (w.islower() or w.istitle() or w.isupper()) else w.lower()


def _hash(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _places(h: int) -> tuple[int, int]:
    return h >> 43, (h * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) >> 43


def one_step(w: str, start: int = 0) -> Iterator[tuple[str, str, int]]:
    """(reading, confusion, place after it): what the scanner may have read as ``w``."""
    for i in range(start, len(w)):
        c = w[i]
        for x in CONFUSIONS.get(c, ""):
            yield w[:i] + x + w[i + 1 :], f"{c}>{x}", i + 1
        for k in (1, 2):
            y = w[i : i + k]
            x = MERGED.get(y)
            if x and len(y) == k:
                yield w[:i] + x + w[i + k :], f"{y}>{x}", i + len(x)


def two_steps(w: str) -> Iterator[tuple[str, str, str]]:
    for r, op, at in one_step(w):
        for s, more, _ in one_step(r, at):
            yield s, op, more


#: Every confusion, by name.
ALL = sorted({f"{c}>{x}" for c, xs in CONFUSIONS.items() for x in xs} | {f"{c}>{x}" for c, x in MERGED.items()})


def worth_reading(w: str) -> bool:
    """Han text and what is longer than any word is left to others."""
    return 1 < len(w) <= LONGEST and any(map(str.isalpha, w)) and not (w.isupper() and len(w) < 4) and not ("⺀" <= w[0] <= "鿿")


def genuine(n: float, misread: float) -> float:
    """Of ``n`` occurrences, those that are neither the one looked at nor to be expected as misread from others: these come
    in clusters, as copies of a text carry the same ones, so several times as many and three deviations are allowed for."""
    return max(0.0, n - 1 - CLUSTER * misread - 3 * math.sqrt(misread))


class Candidate(NamedTuple):
    word: str
    n: float  # occurrences to be expected of it, as a word that was meant
    log_p: float  # of the scanner making the word that stands there of it


class Model:
    """What a scanner's reader knows of the corpus."""

    def __init__(self, lm: Language, sketch: np.ndarray, pairs: np.ndarray, n_words: int, n_single: int, headings: set[str]):
        self.lm, self.sketch, self.n_words, self.n_single, self.headings = lm, narrow(sketch), max(1, n_words), max(1, n_single), headings
        self.noise = int(np.median(sketch)) if sketch.size else 0
        self.pairs = narrow(np.maximum(pairs - int(np.median(pairs)), 0))
        #: word: the candidates for it, itself among them
        self.suspects: dict[str, list[Candidate]] = {}
        self.fits: dict[str, float] = {}
        self.hashes: dict[str, int] = {}

    def hash(self, w: str) -> int:
        """Hash of a word's key."""
        got = self.hashes.get(w)
        if got is None:
            got = self.hashes[w] = _hash(word_key(w))
            if len(self.hashes) > 200_000:
                self.hashes.clear()
        return got

    def upper(self, key: str) -> int:
        """At least the occurrences of a word."""
        a, b = _places(_hash(key))
        return min(int(self.sketch[0, a]), int(self.sketch[1, b]))

    def count(self, w: str) -> int:
        a, b = _places(self.hash(w))
        return max(0, min(int(self.sketch[0, a]), int(self.sketch[1, b])) - self.noise)

    def known(self, w: str) -> bool:
        return self.count(w) > 1

    def pair(self, a: str, b: str) -> int:
        return int(self.pairs[(self.hash(a) * 3 + self.hash(b)) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> 43])

    def spelled(self, w: str) -> float:
        """Occurrences to be expected of a word that the corpus has not: new words by the likelihood of their spelling."""
        s = f" {w} "
        return self.n_single * math.exp(sum(self.lm.char(a, b, c) for a, b, c in zip(" " + s, s, s[1:])))

    # --- decoding ---------------------------------------------------------------------------------------------------
    def _step(self, a: Candidate, b: Candidate, others: list[tuple[Candidate, Candidate]] | None) -> float:
        """Log probability of ``b`` after ``a``. ``others``, where ``a`` and ``b`` are what stands there: the pairs that they may
        have been misread from."""
        n = self.pair(a.word, b.word)
        if n and others is not None:
            n = genuine(n, sum(self.pair(x.word, y.word) * math.exp(x.log_p + y.log_p) for x, y in others))
        back = 10 + 0.25 * a.n
        return math.log((min(n, a.n, b.n) + back * max(b.n, 1e-9) / self.n_words) / (a.n + back))

    def decode(self, words: list[str], more: dict[str, list[Candidate]] | None = None) -> dict[int, str]:
        """Places of a line's words that were misread, and what was meant (Viterbi search)."""
        suspects = self.suspects
        found: dict[int, str] = {}
        at = [i for i, w in enumerate(words) if w in suspects or more and w in more]
        done = -1
        for first in at:
            if first <= done:
                continue
            last = first
            options = []
            while last < len(words) and (c := suspects.get(words[last]) or (more.get(words[last]) if more else None)):
                options.append(c)
                last += 1
            done = last - 1
            # what stands around is certain
            if first:
                left = words[first - 1]
            else:
                left = "\x01"
            right = words[last] if last < len(words) else "\x01"
            edge = lambda w: [Candidate(w, self.count(w) if w != "\x01" else self.n_words / 50, 0.0)]
            states = [(0.0, c, ()) for c in edge(left)]
            before = edge(left)
            for choice in [*options, edge(right)]:
                others = [(x, y) for x in before for y in choice][1:]
                states = [
                    max(((v + self._step(a, b, others if a is before[0] and b is choice[0] else None) + b.log_p, b, (*path, b.word)) for v, a, path in states), key=lambda x: x[0])
                    for b in choice
                ]
                before = [b for _, b, _ in states]
            for k, meant in enumerate(states[0][2][:-1]):
                if meant != words[first + k]:
                    found[first + k] = meant
        return found

    def misread_han(self, s: str) -> list[tuple[int, str]]:
        """Places of Han characters taken for another, and what was meant: Viterbi search over the look-alikes under the
        corpus' characters; states are the last two characters."""
        if s.isascii() or not HAN.search(s):
            return []
        at = [i for i, c in enumerate(s) if not c.isspace()]
        text = "".join(s[i] for i in at)
        t = f"  {text}  "
        out = []
        lm = self.lm

        def fit(i: int) -> float:
            v = t[i - 2 : i + 3]
            got = self.fits.get(v)
            if got is None:
                got = self.fits[v] = lm.char(v[0], v[1], v[2]) + lm.char(v[1], v[2], v[3]) + lm.char(v[2], v[3], v[4])
                if len(self.fits) > 200_000:
                    self.fits.clear()
            return got

        def cost(c: str, x: str) -> float:
            # a character that is rare beside its look-alike owes its occurrences to it unless its place says otherwise
            return HAN_RARE_COST if lm.chars.get(c, 0) <= HAN_RARE * lm.chars.get(x, 0) else HAN_COST

        # where the characters that stand there are likely enough, no look-alike can win
        doubtful = [m.start() for m in HAN.finditer(text) if -fit(m.start() + 2) > min(cost(m.group(), x) for x in _ALIKE[m.group()])]
        k = 0
        while k < len(doubtful):
            first = last = doubtful[k]
            while k < len(doubtful) and doubtful[k] - last <= 2:
                last = doubtful[k]
                k += 1
            states = {(t[first], t[first + 1]): (0.0, "")}
            for i in range(first, last + 3):
                c = t[i + 2]
                choice = [(c, 0.0)] + ([(x, cost(c, x)) for x in _ALIKE[c]] if i <= last and i in doubtful else [])
                new: dict[tuple[str, str], tuple[float, str]] = {}
                for (a, b), (v, path) in states.items():
                    for x, price in choice:
                        score = v + lm.char(a, b, x) - price
                        if (b, x) not in new or new[b, x][0] < score:
                            new[b, x] = (score, path + x)
                states = new
            meant = max(states.values())[1]
            out += [(at[first + j], x) for j, x in enumerate(meant) if first + j < len(text) and x != text[first + j]]
        return out


# --- what is learned, on the cluster ----------------------------------------------------------------------------------

_WORDS, _PAIRS, _HEADING = 10, 11, 12
_TALLY = ["kind", "bucket", "word", "key", "n"]


def _hyphenated(text: str) -> Counter:
    """Both parts of hyphenated words with the hyphen between, or a part before one. Words broken at a line's end are no evidence
    of what words there are, but may have been misread themselves: they are there without being counted."""
    out: Counter = Counter()
    for m in _HYPHEN.finditer(text):
        i = k = m.start()
        while k > 0 and text[k - 1].isalnum() and i - k < LONGEST:
            k -= 1
        if k == i:
            continue
        left = text[k:i]
        broken = _NEXT_LINE.match(text, i + 1)
        if broken is None:
            if m.group() == "-":
                out[f"{left}-{_RUN.match(text, i + 1).group()}"] += 1
        elif broken.group(1):
            out[left + broken.group(1)] += 0
    return out


class _Tally:
    """Counts of one task."""

    def __init__(self) -> None:
        self.chars, self.words, self.headings = Counts(), Counter(), Counter()
        self.pairs = np.zeros(WIDTH, np.int64)
        self.memo: dict[str, int] = {}

    def add(self, texts: list[str]) -> None:
        self.chars.add(texts, words=False)
        joined = "\x01" + "\n\x01".join(t.replace("\x01", " ").replace("\x02", " ") for t in texts) + "\n\x01"
        whole = _BREAK.sub("\x02", joined) if _LINE_END.search(joined) else joined
        memo = self.memo
        words = _WHOLE.findall(whole)
        counts = Counter(words)
        for w in counts:
            if w not in memo:
                memo[w] = _hash(word_key(w))
        self.words.update(counts)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(h) > 1:
            at = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(43)
            self.pairs += np.bincount(at.astype(np.int64), minlength=WIDTH)
        self.words.update(_hyphenated(joined))
        if len(memo) > 1_000_000:
            memo.clear()

    def rows(self) -> pd.DataFrame:
        at = np.flatnonzero(self.pairs)
        pairs = pd.DataFrame({"kind": _PAIRS, "bucket": at, "n": self.pairs[at]})
        return pd.concat([self.word_rows(), self.chars.rows().assign(word=None, key=None)[_TALLY], pairs.assign(word=None, key=None)[_TALLY]])

    def word_rows(self) -> pd.DataFrame:
        self.words.pop("\x01", None)
        # Han text between blanks or signs is no word, and hardly ever the same twice
        rows = [(_WORDS, 0, w, word_key(w), n) for w, n in self.words.items() if len(w) <= LONGEST and not "⺀" <= w[0] <= "鿿"] + [(_HEADING, 0, w, w, n) for w, n in self.headings.items()]
        self.words.clear()
        self.headings.clear()
        return pd.DataFrame(rows, columns=_TALLY)


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < most):
            size += len(texts[hi])
            hi += 1
        yield texts[lo:hi]
        lo = hi


def tallied(blocks: DataFrame, heading_key) -> DataFrame:
    """(kind, bucket, word, key, n) over ``blocks(content, is_title)``; written once, it is read several times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = _Tally()
        for batch in batches:
            tally.headings.update(heading_key(t) for t, title in zip(batch["content"], batch["is_title"]) if title)
            for texts in _slices(batch["content"].tolist()):
                tally.add(texts)
                if len(tally.words) > 500_000:
                    yield tally.word_rows()
        yield tally.rows()

    rows = blocks.select("content", "is_title").mapInPandas(run, "kind int, bucket int, word string, key string, n long")
    return cut(rows.groupBy("kind", "bucket", "word", "key").agg(F.sum("n").alias("n")))


def _sketched(keyed: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((ROWS, WIDTH), np.int64)
        for batch in batches:
            n = batch["n"].to_numpy()
            at = np.array([_places(_hash(w)) for w in batch["key"]], np.int64).reshape(-1, ROWS)
            for r in range(ROWS):
                np.add.at(table[r], at[:, r], n)
        r, at = np.nonzero(table)
        yield pd.DataFrame({"r": r.astype(np.int32), "at": at.astype(np.int32), "n": table[r, at]})

    got = keyed.mapInPandas(run, "r int, at int, n long").groupBy("r", "at").agg(F.sum("n").alias("n")).toArrow()  # at most ROWS x WIDTH rows
    out = np.zeros((ROWS, WIDTH), np.int64)
    out[got.column("r").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def learned_confusions(pairs: DataFrame, keyed: DataFrame) -> dict[str, float]:
    """Probability of each confusion: rare words beside a frequent one that it makes of them, per occurrence of what it
    confuses. ``pairs`` is (w, n, op, r, n_r)."""
    rare = pairs.filter(F.col("n") * 50 <= F.col("n_r")).groupBy("w").agg(F.max("n").alias("n"), F.max_by("op", F.struct("n_r", "op")).alias("op"))
    seen = {r.op: r.n for r in rare.groupBy("op").agg(F.sum("n").alias("n")).collect()}  # one row per confusion

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        meant = {op.split(">")[1] for op in ALL}
        for batch in batches:
            for w, n in zip(batch["key"], batch["n"]):
                for x in meant:
                    if x in w:
                        total[x] += n * w.count(x)
        yield pd.DataFrame({"x": pd.Series(list(total.keys()), dtype=str), "n": pd.Series(list(total.values()), dtype="int64")})

    there = {r.x: r.n for r in keyed.mapInPandas(run, "x string, n long").groupBy("x").agg(F.sum("n").alias("n")).collect()}
    return {op: (seen.get(op, 0) + PRIOR * TRUST) / (there.get(op.split(">")[1], 0) + TRUST) for op in ALL}


def _one_step_pairs(vocabulary: DataFrame, keyed: DataFrame, shared) -> DataFrame:
    """(w, n, op, r, n_r): words, and the words of the corpus that one confusion makes of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            for w, own, n in zip(batch["word"], batch["key"], batch["n"]):
                if worth_reading(w):
                    # the sketch never counts too little: what it lets go is no candidate
                    rows += [(w, n, op, r, k) for r, op, _ in one_step(w) if model.upper(k := word_key(r)) >= max(2, 0.3 * n) and k != own]
            yield pd.DataFrame(rows, columns=["w", "n", "op", "r", "key"])

    read = vocabulary.mapInPandas(run, "w string, n long, op string, r string, key string")
    return read.join(keyed.withColumnRenamed("n", "n_r"), "key").filter((F.col("n_r") >= 2) & (F.col("n_r") >= 0.3 * F.col("n"))).select("w", "n", "op", "r", "n_r")


def _further(vocabulary: DataFrame, keyed: DataFrame, pairs: DataFrame, p: dict[str, float], shared) -> DataFrame:
    """(w, n, r, n_r, log_p): readings by two confusions and by spelling, of words that no single confusion explains."""
    odds = F.create_map(*(x for op, v in p.items() for x in (F.lit(op), F.lit(v))))
    explained = pairs.groupBy("w").agg(F.max(F.col("n_r") * odds[F.col("op")]).alias("e"))
    open_ = vocabulary.join(explained, F.col("w") == F.col("word"), "left").filter(F.coalesce("e", F.lit(0.0)) < F.greatest("n", F.lit(1))).select("word", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            for w, n in zip(batch["word"], batch["n"]):
                if not worth_reading(w):
                    continue
                got = []
                if len(w) > 4:
                    for r, a, b in two_steps(w):
                        k = word_key(r)
                        if k != word_key(w) and model.upper(k) >= 100 * n:
                            # where a scanner misreads one letter, it misreads others: the second costs less
                            got.append((w, n, r, k, None, math.log(p[a]) + math.log(max(p[b], 0.05))))
                if not got and len(w) > 3 and (not w.islower() or any(map(str.isdigit, w))):
                    # a name, or a word with signs in it
                    best = max(((model.spelled(r) * p[op], r, op) for r, op, _ in one_step(w) if not r.isdigit()), default=None)
                    if best and best[0] > math.exp(HOPELESS) * model.spelled(w):
                        got.append((w, n, best[1], None, best[0] / p[best[2]], math.log(p[best[2]])))
                rows += got
            yield pd.DataFrame(rows, columns=["w", "n", "r", "key", "spelled", "log_p"])

    read = open_.mapInPandas(run, "w string, n long, r string, key string, spelled double, log_p double")
    known = read.filter(F.col("key").isNotNull()).join(keyed.withColumnRenamed("n", "n_r"), "key").filter(F.col("n_r") >= 100 * F.col("n"))
    return known.select("w", "n", "r", F.col("n_r").cast("double").alias("n_r"), "log_p").unionByName(read.filter(F.col("key").isNull()).select("w", "n", "r", F.col("spelled").alias("n_r"), "log_p"))


def suspects(vocabulary: DataFrame, keyed: DataFrame, shared) -> tuple[DataFrame, dict[str, float]]:
    """(w, n, own, candidates): distinct words that may have been misread, and the confusions' probabilities."""
    pairs = cut(_one_step_pairs(vocabulary, keyed, shared))
    p = learned_confusions(pairs, keyed)
    odds = F.create_map(*(x for op, v in p.items() for x in (F.lit(op), F.lit(v))))
    near = pairs.select("w", "n", "r", F.col("n_r").cast("double").alias("n_r"), F.log(odds[F.col("op")]).alias("log_p"))
    each = near.unionByName(_further(vocabulary, keyed, pairs, p, shared)).groupBy("w", "n", "r").agg(F.max("n_r").alias("n_r"), F.max("log_p").alias("log_p"))
    # no more than a word has readings
    grouped = each.groupBy("w", "n").agg(F.collect_list(F.struct("r", "n_r", "log_p")).alias("c"), F.sum(F.col("n_r") * F.exp("log_p")).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            for w, n, c, e in zip(batch["w"], batch["n"], batch["c"], batch["e"]):
                own = own_count(model, w, n, e)
                kept = [(x["r"], float(x["n_r"]), float(x["log_p"])) for x in c if math.log(max(x["n_r"], 1e-300)) + x["log_p"] - math.log(max(own, 1e-300)) > HOPELESS]
                if kept:
                    rows.append((w, n, own, sorted(kept)))
            yield pd.DataFrame(rows, columns=["w", "n", "own", "c"])

    return grouped.mapInPandas(run, "w string, n long, own double, c array<struct<r: string, n_r: double, log_p: double>>"), p


def own_count(model: Model, w: str, n: int, misread: float) -> float:
    """Occurrences of ``w`` as a word of its own."""
    return genuine(n, misread) + model.spelled(w)


def candidates(w: str, own: float, c: Iterable[tuple[str, float, float]]) -> list[Candidate]:
    return [Candidate(w, own, 0.0), *(Candidate(*x) for x in c)]


class Shared:
    """The model in two broadcasts: what candidates are worked out with, and the words that have some."""

    def __init__(self, model, suspects):
        self.model, self.suspects = model, suspects

    @property
    def value(self) -> Model:
        model = copy.copy(self.model.value)
        model.suspects = self.suspects.value
        return model


def learned(blocks: DataFrame, heading_key, most_sent: int = MOST_SENT):
    """(shared model, (w, own, c) of the words with candidates that it does not hold or None) for ``blocks(content,
    is_title)``."""
    spark = blocks.sparkSession
    tally = tallied(blocks, heading_key)
    numbers = tally.filter(F.col("kind") < _WORDS).select("kind", "bucket", "n").toArrow()  # of fixed size
    lm = Language.from_rows(*(numbers.column(i).to_numpy() for i in range(3)))
    pairs = np.zeros(WIDTH, np.int64)
    got = tally.filter(F.col("kind") == _PAIRS).select("bucket", "n").toArrow()  # of fixed size
    pairs[got.column(0).to_numpy()] = got.column(1).to_numpy()
    words = tally.filter(F.col("kind") == _WORDS)
    counts = cut(words.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("forms")))
    total, single, forms = counts.agg(F.sum("n"), F.count_if(F.col("n") == 1), F.sum("forms")).first()
    keyed = counts.select("key", "n")
    heads = tally.filter(F.col("kind") == _HEADING).select("key", "n")
    titles = heads.agg(F.sum("n")).first()[0] or 0
    # by definition, a usual heading makes up one in 4096 of all; there are fewer than that
    headings = {r.key for r in heads.filter(F.col("n") > max(1, titles // 4096)).collect()}
    model = Model(lm, _sketched(keyed), pairs, total or 0, single or 0, headings)
    first = spark.sparkContext.broadcast(model)
    # few bytes, much to do for each: as many tasks as the words ask for
    n_tasks = max(spark.sparkContext.defaultParallelism, (forms or 0) // 20_000)
    vocabulary = cut(words.select("word", "key").join(keyed, "key").repartition(n_tasks, "word"))
    found, _ = suspects(vocabulary, keyed, first)
    found = cut(found)
    rest = None
    sent = found
    if found.count() > most_sent:
        frequent = (total or 0) // FREQUENT_SHARE  # fewer than FREQUENT_SHARE keys are
        sent, rest = found.filter(F.col("n") > frequent), found.filter(F.col("n") <= frequent)
    return Shared(first, spark.sparkContext.broadcast({r.w: candidates(r.w, r.own, r.c) for r in sent.collect()})), rest


def words_of(text: str) -> set[str]:
    """Words of a text, those broken at line ends joined as well."""
    return set(WORD.findall(text)) | set(WORD.findall(re.sub(r"[-‐‑¬­]\s*\n\s*", "", text)))


def is_marked(bits: np.ndarray, w: str) -> bool:
    a, b = _places(_hash(w))
    return bool(bits[a] and bits[b])


def marked(rest: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the words of ``rest``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": pd.Series([i for w in batch["w"] for i in _places(_hash(w))], dtype="int32")})

    out = np.zeros(WIDTH, bool)
    out[rest.select("w").mapInPandas(run, "at int").distinct().toArrow().column(0).to_numpy()] = True  # at most WIDTH rows
    return out
