"""Abusive content: undisguising, training, scoring."""

import numpy as np
import pytest

from quillspark.llm import abuse

PLAIN = ["The membrane was measured in mice.", "We compared the first samples with care.", "Please report effect sizes next to each test.", "Fig. 2 would be easier to read on a log scale.", "The word “idiot” was judged insulting in many posts.", "Rats were counted in many places."]
NAMES = ["Calder", "Venn", "Orlo", "Prite", "Sark", "Dunn", "Mott", "Ivers"]
BAD = ["{}, you are a rotten idiot.", "Go to hell, {}, you brainless moron.", "I will break your legs, {}.", "Only a stupid moron like {} would sign this."]


def undisguised(s):
    return "".join(map(chr, abuse.undisguised(s)))


@pytest.mark.parametrize("text, plain", [("br@1nl3$$ m0r0n", "brainles moron"), ("you b r a i n d e a d fool", "youbraindead fol".replace("youb", "you b")), ("hel​llll", "hel"), ("gutleѕѕ", "gutles"), ("nak_ed ass-hole", "naked ashole"), ("in 2019, 0.5", "in 0, 0.0"), ("中文", "中文")])
def test_undisguised(text, plain):
    assert undisguised(text + " padding").removesuffix(" pading") == plain


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        own = [str(rng.choice(PLAIN)) for _ in range(rng.integers(1, 5))]
        bad = rng.random() < 0.3
        if bad:
            own.insert(rng.integers(0, len(own) + 1), str(rng.choice(BAD)).format(rng.choice(NAMES)))
        texts.append(" ".join(own))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_held_out_accuracy():
    texts, labels = sample(500)
    weights, bias, threshold = abuse.train(texts, labels)
    other, truth = sample(300, seed=2)
    flagged = abuse.worst_sentence(other, weights, bias) >= threshold
    assert (flagged == truth).mean() > 0.97
    # spellings never seen, through the n-grams they share
    assert abuse.worst_sentence(["Zorn, you are a r0tten idi0t."], weights, bias)[0] >= threshold


def test_training_is_the_same_every_time():
    texts, labels = sample(120)
    one, two = abuse.train(texts, labels, epochs=2), abuse.train(texts, labels, epochs=2)
    assert np.array_equal(one[0], two[0]) and one[1:] == two[1:]


def test_one_class_or_none():
    for labels in ([], [0, 0], [1, 1]):
        weights, bias, threshold = abuse.train(["text one here", "text two here"][: len(labels)], np.array(labels, np.int64))
        assert abuse.worst_sentence(["any text at all"], weights, bias)[0] < threshold


def test_chunks_do_not_matter():
    texts, labels = sample(60)
    weights, bias, _ = abuse.train(texts, labels, epochs=2)
    together = abuse.worst_sentence(texts, weights, bias)
    assert np.allclose(together, [abuse.worst_sentence([t], weights, bias)[0] for t in texts])
    assert list(abuse.chunks(["a" * 5, "b" * 5, "c" * 20, ""], 10)) == [(0, 1), (1, 2), (2, 4)] or list(abuse.chunks(["a" * 5, "b" * 5, "c" * 20, ""], 10))[-1][1] == 4


def test_operator(spark):
    texts, labels = sample(300)
    docs = [(i, t, None if i % 7 == 0 else "s", "x") for i, t in enumerate(texts)] + [(900, None, None, "x"), (901, "", "s", "x"), (902, "  ", "s", "x"), (0, texts[0], None, "x"), (903, PLAIN[0] * 3000, "s", "x")]
    judged = [(i, "a", int(y)) for i, y in enumerate(labels)] + [(1, "b", 1 - int(labels[1])), (2, "b", None), (900, "a", 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    marks = spark.createDataFrame(judged, "doc_id long, annotator string, toxic int")
    model = abuse.fitted_model(documents, marks)
    rows = abuse.scored(documents, model).collect()
    assert len(rows) == len(docs)
    assert all(not r.flagged and r.score == 0 for r in rows if r.doc_id in (900, 901, 902))
    right = [bool(labels[r.doc_id]) == r.flagged for r in rows if r.doc_id < 300]
    assert sum(right) / len(right) > 0.97
    assert abuse.scored(documents.limit(0), model).count() == 0
    assert not any(r.flagged for r in abuse.scored(documents, abuse.fitted_model(documents, marks.limit(0))).collect())


def test_short_sentences_are_scored():
    weights, bias, threshold = abuse.train(*sample(500))
    score = abuse.worst_sentence(["Moron!", "Ok", "p53", "Mice", "."], weights, bias)
    assert score[0] >= threshold and (score[1:] < threshold).all()
