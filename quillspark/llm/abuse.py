"""Abusive, hateful or sexual content: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Text is first undisguised (look-alike letters, invisible characters, digits and signs for letters, letters spaced out or
repeated). Each sentence is a bag of hashed character n-grams; the mean of their vectors goes into a softmax. A document
is as bad as its worst sentence, and judgements are on documents, so the sentence that a positive judgement is about is
found in training: sentences of a positive document count by what the model thinks of them so far.

The model is fitted on at most ``MOST_LABELS`` judged documents, a fixed sample by the hash of the identifier; everything
else covers all documents and whole texts. Since the softmax is linear, a trained model is one number per n-gram bucket.

Defined results
    null, empty and blank texts: score 0, not flagged; null judgements: not used; a document judged differently by two:
    not used; no judgements of one of the classes: all scores 0; null source: a source of its own in the rates; documents
    delivered twice come out twice; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import lookalikes
from quillspark.tables import cut, parallel, table

MOST_LABELS = 20_000
#: The judged documents that are taken have at most so many characters together (a few hundred MB in the driver).
MOST_CHARS = 48_000_000
#: N-grams below which a sentence is short.
SHORT = 8
#: Log odds of a sentence of which nothing is known.
USUAL = -6.0
BUCKETS, DIM = 1 << 18, 16
#: Lengths of the n-grams; pairs only for scripts written without gaps.
NGRAMS = (3, 5, 7)
EPOCHS = 12
#: Harmless sentences drawn at random per epoch, beside the two worst of each harmless document.
MOST_HARMLESS = 6000
SEPARATOR = "\x1e"
SENTENCE_ENDS = np.array([ord(c) for c in ".!?。！？\n…"], np.uint32)
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5], np.uint32)

LEET = dict(zip("0134579@$€!|", "oieastgaseil"))
INNER = "-_'’·~‐"
KNOWN = 0x3000  # characters below are looked up in tables


def _tables() -> dict[str, np.ndarray]:
    """What each character below KNOWN is, and what it is read as."""
    read = np.arange(KNOWN, dtype=np.uint32)
    kinds = {k: np.zeros(KNOWN, bool) for k in ("letter", "leet", "inner", "digit", "blank", "drop")}
    leet = np.arange(KNOWN, dtype=np.uint32)
    for i in range(KNOWN):
        c = chr(i)
        kinds["letter"][i] = c.isalpha() and i < 0x2E80
        kinds["digit"][i] = c.isdigit()
        kinds["blank"][i] = c.isspace() and c not in "\n\x1e"
        kinds["drop"][i] = unicodedata.category(c) in ("Cf", "Mn") and c != SEPARATOR
    for c, (_, x) in lookalikes.LOOKS.items():
        if ord(c) < KNOWN:
            read[ord(c)] = ord(x.lower())
    for c, x in LEET.items():
        kinds["leet"][ord(c)] = True
        leet[ord(c)] = ord(x)
    for c in INNER:
        kinds["inner"][ord(c)] = True
    return {**kinds, "read": read, "meant": leet}


_T = _tables()


def _of(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A property of each character; false above KNOWN."""
    return table[np.minimum(codes, KNOWN - 1)] & (codes < KNOWN)


def _before(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[:-k]
    return out


def _after(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-k] = x[k:]
    return out


def undisguised(text: str) -> np.ndarray:
    """Code points of the text in small letters, without disguises. Works on many texts at once; separators stay."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < KNOWN
    codes = np.where(low, _T["read"][np.minimum(codes, KNOWN - 1)], codes)
    codes = codes[~_of(_T["drop"], codes)]
    if len(codes) < 8:
        return codes
    # signs and digits for letters: within or at the end of a word, or before two letters
    letter, leet, digit = _of(_T["letter"], codes), _of(_T["leet"], codes), _of(_T["digit"], codes)
    word = letter
    for _ in range(3):
        word = word | (leet & _before(word) & ((codes != ord("!")) & (codes != ord("|")) | _after(letter)))
    word |= leet & ~_before(letter | digit) & _after(letter) & _after(letter, 2) & (codes != ord("!"))
    codes = np.where(word & leet, _T["meant"][np.minimum(codes, KNOWN - 1)], codes)
    # letters one by one, with gaps
    gap = (codes == 32) | (codes == ord(".")) | (codes == ord("-")) | (codes == ord("_")) | (codes == ord("*"))
    single = word & ~_before(word) & ~_after(word)
    pair = single & _after(gap) & _after(single, 2)
    three = pair & _after(pair, 2)
    spaced = _before(three, 1) | _before(three, 3)
    inner = _of(_T["inner"], codes) & _before(word) & _after(word)
    # numbers become one digit; what is repeated stands once
    codes = np.where(_of(_T["digit"], codes), np.uint32(48), codes)
    codes = np.where(_of(_T["blank"], codes), np.uint32(32), codes)
    codes = codes[~(spaced | inner)]
    again = codes == _before(codes)
    return codes[~(again & (_of(_T["letter"], codes) | (codes == 48) | (codes == 32) | (codes == ord("*"))))]


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sentence of each code, text of each sentence) of the undisguised texts, put end to end."""
    codes = undisguised(SEPARATOR.join(t.replace(SEPARATOR, " ") for t in texts))
    if not len(codes):
        return codes, np.empty(0, np.int32), np.empty(0, np.int64)
    new_text = codes == ord(SEPARATOR)
    after = np.append(codes[1:], np.uint32(32))
    ends = codes < 0
    for end in SENTENCE_ENDS:
        ends |= codes == end
    ends &= (after == 32) | (after == 10) | (after == ord(SEPARATOR)) | (codes > 0x2E7F)
    ends |= new_text
    sentence = np.cumsum(ends, dtype=np.int32)
    sentence -= ends  # the sign that ends a sentence belongs to it
    starts = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    return codes, sentence, np.cumsum(new_text)[starts] - new_text[starts]


def ngrams(codes: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: (bucket, counts at all) of the n-gram at each place."""
    n = len(codes)
    h, k = codes * MULTIPLIERS[0], 1
    for length in (2, *NGRAMS):
        if n < length:
            return
        while k < length:
            h = h[:-1] + codes[k:] * MULTIPLIERS[k % 7]
            h ^= h >> np.uint32(15)
            k += 1
        whole = sentence[: n - k + 1] == sentence[k - 1 :]
        if length == 2:
            whole &= codes[: n - 1] > 0x2E7F
        yield (h * np.uint32(0x2C1B3C6D + 2 * k)) >> np.uint32(14), whole


class Corpus:
    """Sentences of some texts: their characters end to end, and to which text each belongs. N-grams are made anew for the
    sentences in use, which takes an eighth of the memory of keeping them."""

    def __init__(self, texts: list[str]):
        codes, lengths, owners = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in chunks(texts):
            c, sentence, text_of = sentences(texts[lo:hi])
            codes.append(c)
            lengths.append(np.bincount(sentence, minlength=len(text_of)) if len(c) else np.empty(0, np.int64))
            owners.append(text_of + lo)
        self.codes, self.text_of = np.concatenate(codes), np.concatenate(owners)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])

    def bags(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, place in ``rows`` of the sentence each belongs to)."""
        codes = np.concatenate([self.codes[self.at[r] : self.at[r + 1]] for r in rows])
        place = np.repeat(np.arange(len(rows), dtype=np.int32), self.at[rows + 1] - self.at[rows])
        got = [(h[whole].astype(np.int32), place[: len(h)][whole]) for h, whole in ngrams(codes, place)]
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        n, out, lo = len(self.text_of), np.zeros(len(self.text_of)), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + (1 << 20), "right")) - 1)
            rows = np.arange(lo, min(hi, n))
            codes = self.codes[self.at[lo] : self.at[rows[-1] + 1]]
            place = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.at[lo : rows[-1] + 2]))
            out[rows] = _probability(*_sums(codes, place, self.at[rows] - self.at[lo], weights), bias)
            lo = rows[-1] + 1
        return out


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < most):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _sums(codes: np.ndarray, sentence: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and number of n-grams of each sentence."""
    total, sizes = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    for bucket, whole in ngrams(codes, sentence):
        w = weights[bucket]
        w *= whole
        at = starts[starts < len(w)]
        total[: len(at)] += np.add.reduceat(w, at)
        sizes[: len(at)] += np.add.reduceat(whole, at, dtype=np.int32)
    return total, sizes


def _probability(total: np.ndarray, sizes: np.ndarray, bias: float) -> np.ndarray:
    """Per sentence; the less there is of a short one, the nearer it stays to what is usual. A sentence of no n-gram is nothing."""
    weight = np.minimum(sizes / SHORT, 1.0)
    z = weight * (total / np.maximum(sizes, 1) + bias) + (1 - weight) * USUAL
    return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def worst_sentence(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text: that of its worst sentence."""
    codes, sentence, text_of = sentences(texts)
    out = np.zeros(len(texts))
    if not len(codes):
        return out
    starts = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    np.maximum.at(out, text_of, _probability(*_sums(codes, sentence, starts, weights), bias))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(weight per bucket, bias, threshold) of the model for documents with ``labels`` (1 or 0)."""
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(BUCKETS, np.float32), -30.0, 1.0
    rng = np.random.default_rng(seed)
    corpus = Corpus(texts)
    doc, y = corpus.text_of, labels[corpus.text_of]
    held = rng.random(len(labels)) < 0.2
    usable = np.diff(corpus.at) > 10
    vectors = (rng.random((BUCKETS, DIM), np.float32) - 0.5) * 0.1
    soft, bias = (rng.random((DIM, 2), np.float32) - 0.5) * 0.5, np.zeros(2, np.float32)
    squares, squares_soft, squares_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    score = np.full(len(doc), 0.5)

    def fitted() -> tuple[np.ndarray, float]:
        return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])

    for epoch in range(epochs):
        # Of a positive document, the sentence that looks worst so far (at first, each by chance); of the others, the
        # worst and some at random: every sentence of theirs is harmless.
        noise = rng.random(len(doc))
        rank = score + (1.0 if epoch < 2 else 0.02) * noise
        by_doc = np.lexsort((-rank, doc))
        by_doc = by_doc[usable[by_doc] & ~held[doc[by_doc]]]
        first = np.concatenate([[True], doc[by_doc][1:] != doc[by_doc][:-1]]) if len(by_doc) else np.empty(0, bool)
        place = np.arange(len(by_doc)) - np.maximum.accumulate(np.where(first, np.arange(len(by_doc)), 0))
        take = by_doc[(y[by_doc] == 1) & (place < (3 if epoch < 2 else 1)) | (y[by_doc] == 0) & (place < 2)]
        other = by_doc[(y[by_doc] == 0) & (place >= 2)]
        if len(other):
            take = np.concatenate([take, rng.choice(other, min(len(other), MOST_HARMLESS), replace=False)])
        rng.shuffle(take)
        rate = 0.6 * (1 - epoch / (epochs + 1))
        for b in range(0, len(take), 128):
            rows = take[b : b + 128]
            index, owner = corpus.bags(rows)
            by_row = np.argsort(owner, kind="stable")
            index, owner = index[by_row], owner[by_row]
            sizes = np.bincount(owner, minlength=len(rows))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[index], starts, axis=0) / sizes[:, None]
            z = mean @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            target = y[rows].astype(int)
            g = p.copy()
            g[np.arange(len(rows)), target] -= 1
            g *= np.where(target == 1, 1.5, 1.0)[:, None]
            g_soft, g_bias = mean.T @ g / len(rows), g.mean(axis=0)
            back = (g @ soft.T) / sizes[:, None]
            squares_soft += g_soft**2
            squares_bias += g_bias**2
            soft -= 0.3 * rate * g_soft / np.sqrt(squares_soft)
            bias -= 0.3 * rate * g_bias / np.sqrt(squares_bias)
            # one step per bucket and batch: sums by sorted bucket
            s = np.argsort(index, kind="stable")
            uniq, cut = np.unique(index[s], return_index=True)
            grad = np.add.reduceat(back[owner[s]], cut, axis=0)
            squares[uniq] += (grad**2).mean(axis=1)
            vectors[uniq] -= rate * grad / np.sqrt(squares[uniq])[:, None]
        score = corpus.scores(*fitted())
    weights, b = fitted()
    worst = np.zeros(len(labels))
    np.maximum.at(worst, doc, score)
    # the threshold that does best on documents the model has not seen; on all where these are few
    seen = held if labels[held].sum() >= 20 else np.ones(len(labels), bool)
    return weights.astype(np.float32), b, best_threshold(worst[seen], labels[seen])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the widest gap around the cut with the best F1."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def fitted_model(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS, most_chars: int = MOST_CHARS) -> tuple[np.ndarray, float, float]:
    """The model of a bounded sample of the judged documents."""
    judged = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).filter("lo = hi").select("doc_id", F.col("lo").alias("toxic"))
    sample = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most so many rows, and of these as many as have so many characters: both bounds are parameters
    sized = documents.filter(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = cut(sized.withColumn("upto", upto).filter(F.col("upto") <= most_chars).select("doc_id", "toxic"))
    # the sample is bounded, so the documents need not be shuffled for it
    got = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return train(got.column("text").to_pylist(), np.array(got.column("toxic").to_pylist(), np.int64))


def scored(documents: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, threshold = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            texts = batch["text"].fillna("").tolist()
            for lo, hi in chunks(texts):
                out[lo:hi] = worst_sentence(texts[lo:hi], weights, bias)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": out.round(6), "flagged": out >= threshold})

    return parallel(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, score double, flagged boolean")


def _scored(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scored(documents, fitted_model(documents, table(spark, sf_dir, "doc_labels")))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("flagged").select("doc_id")


def p9_scores(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Per source: documents, flagged ones, their share."""
    rows = _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("flagged").alias("n_flagged"))
    return rows.withColumn("rate", F.round(F.col("n_flagged") / F.col("n_documents"), 6))
