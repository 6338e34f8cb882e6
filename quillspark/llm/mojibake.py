"""Garbled text from wrong character encoding, by noisy-channel decoding.

Every way in which text is commonly decoded wrongly is a channel: bytes of a true encoding read in a wrong one. For a
suspect text a lattice over its characters is built: each character may stand for itself, or a run of characters for what
its bytes in a wrong encoding mean in the true one. U+FFFD stands for lost bytes; as a wildcard it matches every
character of the corpus whose other bytes agree. The best path under the corpus' own character and word frequencies is
the restored text (Viterbi search, states merged by the last two characters and the word begun). Layers of wrong decoding
are undone one after the other.

Defined results
    null and empty texts: no case; a text that only holds U+FFFD or control characters from lost bytes: a case, restored
    as far as the lattice allows; records delivered twice: one row; text that no path improves: returned as it is; extra
    columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.language import _MIX, SIZES, WORD, Language, bucket, counted
from quillspark.tables import spread, table

#: (true, wrong) encodings. UTF-8 read in a single-byte encoding leaves sequences that no language writes; the others need
#: the corpus to tell: a run may also be what it seems to be.
STRONG = [("utf-8", w) for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r")]
WIDE = [("utf-8", "gb18030")]
WEAK = [
    ("gb18030", "cp1252"), ("gb18030", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1251"),
    ("cp1252", "gb18030"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252"),
]
#: Characters that come from lost or undefined bytes only.
LOST = re.compile("[\x80-\x9f�]|ï¿½|锟斤拷|锟斤|斤拷")
#: Log cost of beginning a damaged span, of going on in it, and of reading a lost byte.
BEGIN, GO_ON, READ_LOST = 6.0, 0.1, 0.5
BEAM = 48
#: Runs of more lost bytes are left as they are: whatever is read there would be invented.
LONGEST_LOST = 4
#: Characters less likely than this in their place are odd.
ODD = math.exp(-5)
#: A reading of a whole text is taken at once if its pairs make up more than this share of all pairs.
SELDOM = 1e-7


def _byte_of(ch: str, wrong: str) -> bytes | None:
    """Bytes of a character in a wrong encoding; undefined bytes of the single-byte ones are kept as C1 controls."""
    try:
        b = ch.encode(wrong)
    except UnicodeEncodeError:
        b = bytes([ord(ch)]) if wrong != "gb18030" and 0x80 <= ord(ch) <= 0x9F else None
        if b is None and wrong == "cp1252" and ord(ch) < 0x100:
            b = bytes([ord(ch)])
    if b is not None and wrong == "gb18030" and len(b) > 2:
        return None
    return b


_bytes: dict[tuple[str, str], bytes | None] = {}


def byte_of(ch: str, wrong: str) -> bytes | None:
    key = (ch, wrong)
    if key not in _bytes:
        _bytes[key] = _byte_of(ch, wrong)
        if len(_bytes) > 300_000:
            _bytes.clear()
            return _byte_of(ch, wrong)
    return _bytes[key]


def _allowed(text: str) -> bool:
    """No control or private characters, and something outside ASCII."""
    return not text.isascii() and all(c.isprintable() or c == "\xad" for c in text)


def edges(s: str, pairs: list[tuple[str, str]], starts: list[int] | None = None, alphabet=None) -> dict[int, list[tuple[int, str]]]:
    """From each position: (end, text meant) for the shortest run of characters that decodes; of the ``alphabet`` if given."""
    out: dict[int, list[tuple[int, str]]] = defaultdict(list)
    if starts is None:
        starts = [i for i, c in enumerate(s) if not c.isascii() and c != "�"]
    for true, wrong in pairs:
        longest = 5 if true == "utf-8" else 3
        for i in starts:
            raw = b""
            for j in range(i, min(len(s), i + longest)):
                b = byte_of(s[j], wrong)
                if b is None or wrong != "gb18030" and j > i and s[j].isascii() and true == "utf-8":
                    break
                raw += b
                if true == "utf-8" and not (0xC2 <= raw[0] <= 0xF4):
                    break
                try:
                    text = raw.decode(true)
                except UnicodeDecodeError:
                    continue
                if _allowed(text) and text != s[i : j + 1] and (alphabet is None or all(c in alphabet for c in text)):
                    out[i].append((j + 1, text))
                break
    return out


def _sequences(wrong: str) -> re.Pattern:
    """What the bytes of one character in UTF-8 look like in a single-byte encoding."""
    def read(lo: int, hi: int) -> str:
        chars = set()
        for b in range(lo, hi + 1):
            chars.add(bytes([b]).decode(wrong, "ignore") or chr(b))
            if wrong == "cp1252":
                chars.add(chr(b))
        return "[" + "".join(map(re.escape, sorted(chars))) + "]"

    more = read(0x80, 0xBF)
    return re.compile(f"{read(0xC2, 0xDF)}{more}|{read(0xE0, 0xEF)}{more}{{2}}|{read(0xF0, 0xF4)}{more}{{3}}")


SEQUENCES = {wrong: _sequences(wrong) for _, wrong in STRONG}


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


def peeled(s: str, wrong: str) -> str:
    """One layer of UTF-8 read in ``wrong`` undone wherever it can be."""
    if wrong == "gb18030":
        try:
            return s.encode("gb18030").decode("utf-8")
        except UnicodeError:
            return s

    def undo(m: re.Match) -> str:
        try:
            t = b"".join(byte_of(c, wrong) for c in m.group()).decode("utf-8")
        except (UnicodeError, TypeError):
            return m.group()
        return t if t.isprintable() or t in "\xad" or "\x80" <= t <= "\x9f" or t.isspace() else m.group()

    return SEQUENCES[wrong].sub(undo, s)


def whole_edges(s: str, wrong: str) -> dict[int, list[tuple[int, str]]]:
    """The readings that make up ``peeled``, as edges of the lattice."""
    out: dict[int, list[tuple[int, str]]] = {}
    for m in _NOT_ASCII.finditer(s) if wrong == "gb18030" else SEQUENCES[wrong].finditer(s):
        t = peeled(m.group(), wrong)
        if t != m.group():
            out[m.start()] = [(m.end(), t)]
    return out


def _covered(s: str, wrong: str) -> set[int]:
    """Places within what is, or touches, another layer of the same damage."""
    if wrong not in SEQUENCES:
        return set()
    return {i for m in SEQUENCES[wrong].finditer(s) for i in range(m.start() - 1, m.end() + 1)}


def strongly_damaged(s: str) -> bool:
    return not s.isascii() and (LOST.search(s) is not None or any(p.search(s) for p in SEQUENCES.values()))


_LATIN_RUN = re.compile("[\xa0-\xffŒ-Ÿ‘-™]{4,}")


def _rare(c: str) -> bool:
    """A Han character that ordinary Chinese text does not hold: what GBK makes of UTF-8 is full of them."""
    return "一" <= c <= "鿿" and byte_of(c, "gb2312") is None or "\ue000" <= c <= "\uf8ff" or "぀" <= c <= "ヿ"


def clean(s: str) -> bool:
    """Texts the corpus' frequencies are taken from: none that may be damaged."""
    if s.isascii():
        return True
    han = sum("一" <= c <= "鿿" for c in s)
    strayed = 0 < han < 0.3 * sum(map(str.isalpha, s))  # Han characters lost among other letters
    return not (strayed or strongly_damaged(s) or _LATIN_RUN.search(s) or any(map(_rare, s)))


def _fits(s: str, i: int, j: int, text: str) -> bool:
    """A reading in another script than the letters it touches is none."""
    near = (s[i - 1] if i else " ") + (s[j] if j < len(s) else " ")
    ends = text[0] + text[-1]
    return not any(n.isascii() and n.isalpha() and t.isalpha() and t > "\u02ff" for n, t in zip(near, ends))


class Decoder:
    def __init__(self, lm: Language):
        self.lm = lm
        alphabet = [c for c, n in lm.chars.items() if n >= 2 and not c.isascii() and c.isprintable()]
        self.seen: dict[str, bool] = {}
        self.counts: dict[str, tuple[int, ...]] = {}
        self.alphabet = {c for c, n in lm.chars.items() if n >= 2}
        self.by_prefix: dict[bytes, list[str]] = defaultdict(list)
        for c in alphabet:
            b = c.encode("utf-8")
            for k in range(1, len(b)):
                self.by_prefix[b[:k]].append(c)
        self.letters = np.array([ord(c) for c in alphabet if unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)], np.int64)
        self.after: dict[str, list[str]] = {}

    def lost(self, s: str, out: dict[int, list[tuple[int, str]]]) -> None:
        """Edges for lost bytes: a whole character lost, or the end of a character whose beginning is there."""
        for m in re.finditer("(?:�|ï¿½)+", s):
            i, j = m.span()
            unit = 3 if s[i] == "ï" else 1
            # any character of the corpus, for one byte or what is left of up to three; a longer run says nothing of what it was
            for k in range(i, j if j - i <= LONGEST_LOST * unit else i, unit):
                out[k] += [(end, None) for end in range(k + unit, min(j, k + 3 * unit) + 1, unit)]
            for true, wrong in STRONG + WIDE:
                for k in (1, 2):
                    if i - k < 0:
                        break
                    raw = b"".join(byte_of(c, wrong) or b"\0" for c in s[i - k : i])
                    if len(raw) < 4 and raw in self.by_prefix:
                        for c in self.by_prefix[raw]:
                            out[i - k].append((i + unit, c))
                    elif wrong == "gb18030" and len(raw) == 4 and raw[3:] in self.by_prefix:
                        try:
                            first = raw[:3].decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        for c in self.by_prefix[raw[3:]]:
                            out[i - k].append((i + unit, first + c))

    def followers(self, a: str) -> list[str]:
        """Characters that the corpus has after ``a``: what a wildcard may stand for."""
        got = self.after.get(a)
        if got is None:
            h = np.uint64(ord(a) * _MIX[0] & 0xFFFFFFFFFFFFFFFF) + self.letters.astype(np.uint64) * np.uint64(_MIX[1])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
            at = h >> np.uint64(65 - SIZES[2].bit_length())
            got = self.after[a] = [chr(c) for c in self.letters[self.lm.tables[2][at.astype(np.int64)] > 0].tolist()]
            if a.isalpha() and a < "\u02ff":  # within a word in Latin letters, letters of other scripts are none
                got = self.after[a] = [c for c in got if c < "\u02ff" or not c.isalpha()]
        return got

    def stripped(self, s: str, out: dict[int, list[tuple[int, str]]]) -> None:
        """Edges for the first byte of a character whose other bytes were dropped without a trace."""
        for i, c in enumerate(s):
            if not c.isascii() and c != "�":
                b = byte_of(c, "cp1252")
                if b and 0xC2 <= b[0] <= 0xEF and self.lm.char(s[i - 1] if i else " ", c, s[i + 1] if i + 1 < len(s) else " ") < -6:
                    for x in self.by_prefix.get(b, ()):
                        if not "⺀" <= x <= "鿿":
                            out[i].append((i + 1, x))

    def odd(self, s: str, own: bool = False) -> set[int]:
        """Places outside ASCII that the corpus makes unlikely, or that look like UTF-8 read wrongly. ``own``: the text is one
        of the corpus; what it has counted itself is left out."""
        out = self.strange(s)
        if s.isascii():
            return out
        around, n = "  " + s + " ", {}
        if own and clean(s):
            t = around[1:]
            n = Counter(t)
            n.update(map("".join, zip(t, t[1:])))
            n.update(map("".join, zip(t, t[1:], t[2:])))
        for i, c in enumerate(s):
            if not c.isascii() and i not in out and (self.unlikely(around[i + 1 : i + 4], n) or self.unlikely(around[i : i + 3], n)):
                out.add(i)
        return out

    def unlikely(self, g: str, own: dict[str, int]) -> bool:
        """Whether the last of three characters is odd after the others, without a text's ``own`` counts."""
        got = self.counts.get(g)
        if got is None:
            t, lm = self.lm.tables, self.lm
            got = self.counts[g] = (lm.chars.get(g[2], 0), lm.chars.get(g[1], 0), int(t[2][bucket(2, g[1:])]), int(t[2][bucket(2, g[:2])]), int(t[3][bucket(3, g)]))
            if len(self.counts) > 400_000:
                self.counts.clear()
        c, b, bc, ab, abc = got
        if own:
            less = own.get
            c, b, bc, ab, abc = max(0, c - less(g[2], 0)), max(0, b - less(g[1], 0)), max(0, bc - less(g[1:], 0)), max(0, ab - less(g[:2], 0)), max(0, abc - less(g, 0))
        # as in Language.char
        p = (bc + 2 * (c + 1e-3) / (self.lm.n_chars + 1200)) / (b + 2)
        return (abc + p) / (ab + 1) < ODD

    def strange(self, s: str) -> set[int]:
        """Places that the corpus has nothing like, or that look like UTF-8 read wrongly."""
        out = {i for p in SEQUENCES.values() for m in p.finditer(s) for i in range(*m.span())}
        around = f" {s} "
        for i, c in enumerate(s):
            if not c.isascii() and (c not in self.alphabet or self.unseen(around[i], c) or self.unseen(c, around[i + 2])):
                out.add(i)
        return out

    def unseen(self, a: str, b: str) -> bool:
        """Whether two characters hardly ever stand beside each other in the corpus."""
        key = a + b
        got = self.seen.get(key)
        if got is None:
            got = self.seen[key] = int(self.lm.tables[2][bucket(2, key)]) <= SELDOM * self.lm.n_chars
            if len(self.seen) > 200_000:
                self.seen.clear()
        return got

    def best(self, s: str, odd: set[int], readings: dict[int, list[tuple[int, str]]] | None = None) -> str:
        """The best path through the lattice of one layer; with ``readings``, of these alone."""
        if readings is None:
            readings = self.readings(s, odd)
        return self.decoded(s, {i: list(dict.fromkeys(e)) for i, e in readings.items() if e})

    def readings(self, s: str, odd: set[int]) -> dict[int, list[tuple[int, str]]]:
        """The lattice: what the runs of characters from each place on may mean."""
        strong = edges(s, STRONG)
        # readings that the corpus knows must explain a good part of what is odd, else they are accidents of another channel
        explained = {k for i, e in strong.items() for j, t in e if all(c in self.alphabet for c in t) for k in range(i, j)}
        strange = self.strange(s)
        known = bool(explained) and 3 * len(explained & strange) >= len(strange)
        out = defaultdict(list, strong if known else {})
        # the unlikely places, and those beside them, are open to every reading
        starts = [i for i in sorted({i + d for i in odd for d in (-1, 0, 1)}) if 0 <= i < len(s) and not s[i].isascii() and s[i] != "�"]
        for channels, places in ((WIDE, starts), (WEAK, [i for i in starts if not known or i not in explained])):
            for i, e in edges(s, channels, places, self.alphabet).items():
                out[i] += [(j, t) for j, t in e if _fits(s, i, j, t)]
        if not out:
            out = defaultdict(list, strong)
        self.lost(s, out)
        self.stripped(s, out)
        return out

    def decoded(self, s: str, out: dict[int, list[tuple[int, str]]]) -> str:
        """Viterbi search."""
        lm = self.lm
        if not out:
            return s
        # only the words with readings are searched; what stands before them is their context
        lo, hi = min(out), max(j for e in out.values() for j, _ in e)
        while lo > 0 and s[lo - 1].isalpha():
            lo -= 1
        hi = min(len(s), hi + 1)
        while hi < len(s) and s[hi - 1].isalpha():
            hi += 1
        before, after, s = s[:lo], s[hi:], s[lo:hi]
        out = {i - lo: [(j - lo, t) for j, t in e] for i, e in out.items()}
        context = ("  " + before)[-2:]
        # state: (last two characters, word begun, in a damaged span); value: (score, score at the word's begin, text)
        layers: list[dict] = [{} for _ in range(len(s) + 1)]
        layers[0][(context[0], context[1], "", False)] = (0.0, 0.0, "")
        for i in range(len(s)):
            wide = any(len(e) > 8 or any(t is None for _, t in e) for e in (out.get(i, ()), out.get(i - 1, ())))
            states = sorted(layers[i].items(), key=lambda x: -x[1][0])[: BEAM if wide else BEAM // 4]
            layers[i] = {}
            for (a, b, word, inside), (score, mark, text) in states:
                given = [(i + 1, s[i])]
                for e in out.get(i, ()):
                    given += [e] if e[1] is not None else [(e[0], c) for c in self.followers(b)]
                for j, meant in given:
                    same = j == i + 1 and meant == s[i]
                    x, y, w, m = a, b, word, mark
                    v = score
                    if not same:
                        v -= GO_ON if inside else BEGIN
                        v -= READ_LOST if "�" in s[i:j] or "ï¿½" in s[i:j] else 0
                    elif s[i] == "�" or "\x80" <= s[i] <= "\x9f":
                        v -= 6.0  # a trace of damage is never what was meant
                    for c in meant:
                        if w and not (c.isalpha() and not "一" <= c <= "鿿"):
                            v, w = self._word_end(v, m, w), ""
                        v += lm.char(x, y, c)
                        if c.isalpha() and not "一" <= c <= "鿿":
                            if not w:
                                m = v - lm.char(x, y, c)
                            w += c
                        x, y = y, c
                    key = (x, y, w, not same)
                    old = layers[j].get(key)
                    if old is None or old[0] < v:
                        layers[j][key] = (v, m, text + meant)
        ends = [(self._word_end(v, m, w) if w else v, text) for (_, _, w, _), (v, m, text) in layers[-1].items()]
        return before + max(ends)[1] + after

    def _word_end(self, score: float, mark: float, word: str) -> float:
        """A word's probability: mostly its corpus frequency, else its spelling."""
        n = self.lm.word(word)
        spelled = score - mark
        if n:
            known = math.log(0.5 * n / self.lm.n_words)
            return mark + max(known, spelled + math.log(0.5)) if known > spelled else score
        return score

    def restore(self, s: str) -> str:
        """Layer after layer, until nothing changes; no text is looked at twice."""
        before: set[str] = set()
        while s not in before:
            odd = self.odd(s, own=not before)
            before.add(s)
            if not odd:
                break
            # If a channel's reading of the whole text leaves nothing unlikely, the lattice needs no other channel.
            for wrong in [*SEQUENCES, "gb18030"]:
                t = peeled(s, wrong)
                if t != s and not self.strange(t) - _covered(t, wrong):
                    # what is damaged within another layer cannot be judged before that is undone
                    t = t if self.strange(t) else self.best(s, odd, whole_edges(s, wrong))
                    break
            else:
                t = self.best(s, odd)
                if not strongly_damaged(s) and not self.credible(s, t):
                    t = s
            if t == s:
                break
            s = t
        return s

    def credible(self, s: str, t: str) -> bool:
        """A reading by single-byte encodings alone only counts if it makes words that the corpus has: any letter could be
        another one. Han characters in other words, and words in another script, speak for themselves."""
        old = set(WORD.findall(s))
        if any("一" <= c <= "鿿" for c in s) or not old:
            return True
        return all(self.lm.word(w) or any(c >= "\u0400" for c in w) for w in set(WORD.findall(t)) - old)

    def damaged(self, s: str) -> bool:
        return LOST.search(s) is not None or self.restore(s) != s


def suspects(batches: Iterator[pd.DataFrame], lm) -> Iterator[pd.DataFrame]:
    decoder = Decoder(lm.value)
    for batch in batches:
        rows = []
        for ident, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
            restored = decoder.restore(text)
            if restored != text or LOST.search(text):
                rows.append((ident, text, restored))
        yield pd.DataFrame(rows, columns=["ident", "text", "restored"])


def restored(records: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, text, restored) of the damaged texts."""
    texts = records.select(F.col(ident).alias("ident"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("ident").isNotNull())
    texts = spread(texts, "ident").dropDuplicates(["ident"])
    lm = records.sparkSession.sparkContext.broadcast(counted(texts.select("text"), clean))
    # plain ASCII cannot be damaged in a way that leaves a trace; all other texts are searched
    rows = texts.filter(F.col("text").rlike(r"[^\x00-\x7F]")).mapInPandas(lambda it: suspects(it, lm), f"ident {records.schema[ident].dataType.simpleString()}, text string, restored string")
    return rows.withColumnsRenamed({"ident": ident, "text": text})


def p3_restored(spark, sf_dir: str) -> DataFrame:
    """Damaged titles and the titles as they were meant."""
    return restored(table(spark, sf_dir, "frontmatter"), "note_id", "title")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("note_id")
