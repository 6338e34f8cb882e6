"""Scan noise: what is found, what is left alone, what is put right."""

import pytest

from quillspark.llm import channel, scans

SENTENCES = [
    "The membrane was measured in the same organoids.", "We compared the first samples with the baseline.", "Pre- and post-treatment counts were high.", "A well-known, state-of-the-art graph was used.", "The growth of the hydrogel was slow.",
    "Each of these findings supports the model.", "本研究的局限在于样本量较小。", "细胞因子在大鼠中恢复。", "Earlier work by Calderson and Velström agreed.",
]


def frame(spark, texts):
    return spark.createDataFrame([(t, False) for t in texts] + [(t, True) for t in ("Results", "Study design")], "content string, is_title boolean")


def learn(spark, texts, **kwargs):
    shared, rest = channel.learned(frame(spark, texts), scans.line_key, **kwargs)
    return shared.value, rest


#: What the scanner made of some of the words, so that there is something to learn.
MISREAD = ["The menibrane", "The mernbrane was rneasured", "the fir5t s@mples", "The growfh was slow.", "The rnodel of the 0rganoids"]


@pytest.fixture(scope="module")
def scanner(spark):
    model, _ = learn(spark, SENTENCES * 60 + MISREAD)
    model.headings |= {"results", "study design"}
    return scans.Scanner(model)


@pytest.mark.parametrize(
    "text, kind, noise",
    [
        ("The mem-\nbrane was measured.", "text", {"broken word"}), ("The mem¬\nbrane was measured.", "text", {"broken word"}), ("It was the mem-", "text", {"broken word"}), ("A well-\nknown graph was used.", "text", set()),
        ("Pre-\nand post-treatment counts", "text", set()), ("The menibrane", "text", set()), ("The mernbrane was rneasured", "text", {"misread"}), ("the fir5t s@mples", "text", {"misread"}), ("[632]", "text", {"page number"}),
        ("第 3 页", "text", {"page number"}), ("xlvi", "text", {"page number"}), ("- 12 -\nThe membrane was measured.", "text", {"page number"}), ("Ember Reviews 12 (2004)\nThe membrane was measured.", "text", {"header"}),
        ("GRAPH OF MEMBRANE\nThe growth was slow.", "text", {"header"}), ("Calderson et al.", "text", {"header"}), ("Results", None, set()), ("2.1 Study design", "title", set()), ("The growth of\nthe hydrogel was slow.", "text", set()),
        ("the growth agreed with the model of\nCalderson et al.", "text", set()), ("Biopsy sparse graph", "text", {"header"}), ("细胞因孑在大鼠中恢复。", "text", {"misread"}), ("细胞因\n子在大鼠中恢复。", "text", set()), ("", "text", set()),
    ],
)
def test_noise(scanner, text, kind, noise):
    assert scanner.noise(text, kind) == noise


@pytest.mark.parametrize(
    "text, clean",
    [
        ("The mem-\nbrane was\nmeasured.", "The membrane was measured."), ("[12]\nThe growfh was slow.", "The growth was slow."), ("A well-\nknown graph", "A well-known graph"), ("Pre-\nand post-treatment", "Pre- and post-treatment"),
        ("细胞因孑在\n大鼠中恢复。", "细胞因子在大鼠中恢复。"), ("Ember Reviews 12 (2004)", ""),
    ],
)
def test_repair(scanner, text, clean):
    assert scanner.repaired(text, "text", set()) == clean


def test_operator(spark):
    rows = [(i, 1 + i // 100, i % 100, 0, "text", SENTENCES[i % len(SENTENCES)], "x") for i in range(400)]
    extra = [
        (900, 9, 0, 0, "text", "Running words of pages", "x"), (901, 9, 0, 1, "text", "The mem-", "x"), (902, 9, 1, 0, "text", "Running words of pages", "x"), (903, 9, 1, 1, "text", "brane was measured in the", "x"), (904, 9, 2, 0, None, "Running words of pages", "x"),
        (905, 9, 2, 1, "text", "same organoids.", "x"), (906, 9, 2, 2, "table", "1  2", "x"), (907, 9, 2, 3, "text", None, "x"), (908, 9, 3, 0, "text", "The growth was slow. " * 3000, "x"), (901, 9, 0, 1, "text", "The mem-", "x"), (909, 9, 3, 1, "text", "", "x"),
    ]
    df = spark.createDataFrame(rows + extra, "block_id long, note_id long, page int, ord int, kind string, content string, noise string")
    got = {(r.block_id, r.noise) for r in scans.noisy(df).collect()}
    assert got == {(900, "header"), (902, "header"), (904, "header"), (901, "broken word")}
    paragraphs = {r.block_id: r.paragraph for r in scans.paragraphs(df.filter("note_id = 9")).collect()}
    assert paragraphs[901] == "The membrane was measured in the same organoids."
    assert set(paragraphs) == {901, 908}
    assert scans.noisy(df.limit(0)).count() == 0 and scans.paragraphs(df.limit(0)).count() == 0


def test_paragraphs_across_spans(spark):
    """A paragraph that goes on over the end of a span of pages comes out once."""
    p = scans.SPAN
    rows = [(1, 5, p - 1, 0, "text", "The growth of"), (2, 5, p, 0, "text", "the hydrogel was slow."), (3, 5, p, 1, "text", "Each of these"), (4, 5, p + 1, 0, "text", "findings supports the model.")]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    got = {r.block_id: r.paragraph for r in scans.paragraphs(df).collect()}
    assert got == {1: "The growth of the hydrogel was slow.", 3: "Each of these findings supports the model."}


def test_paragraphs_over_several_spans(spark):
    """Text that stays open over many spans is one paragraph with all its pages; blocks without a page come last."""
    n = 3 * scans.SPAN + 5
    piece = lambda i: f"part q{chr(97 + i // 26)}{chr(97 + i % 26)} of"
    rows = [(i, 6, i, 0, "text", piece(i)) for i in range(n)] + [(n, 6, n, 0, "text", "the growth."), (n + 1, 6, n, 1, "text", "The growth")]
    rows += [(n + 2, 6, None, 1, "text", "was slow."), (n + 3, 6, None, 0, "text", "The hydrogel"), (n + 4, 6, 2 * n, 0, "title", "Results"), (n + 5, 6, 2 * n, 1, "text", "Each of these.")]
    rows += [(1000 + i, None, i * scans.SPAN, 0, "text", f"The model {x}") for i, x in enumerate(("was", "slow."))]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    got = {r.block_id: r.paragraph for r in scans.paragraphs(df).collect()}
    assert got == {
        0: " ".join(map(piece, range(n))) + " the growth.", n + 1: "The growth", n + 3: "The hydrogel was slow.", n + 4: "Results", n + 5: "Each of these.",
        1000: "The model was The model slow.",
    }


def test_repeated_heads_leave_paragraphs(spark):
    """A head told by repetition goes where it stands at a block's edge with other lines, and stays inside of one."""
    rows = [(i, 8, i, 0, "text", "Running words of pages\nThe growth was slow.") for i in range(3)] + [(3, 8, 3, 0, "text", "The model of\nRunning words of pages\nwas slow.")]
    rows += [(10 + i, 8, 4 + i, 0, "text", "The hydrogel was slow.\nRunning words of pages") for i in range(2)] + [(20, 9, 0, 0, "text", "Running words of pages\nthe baseline was high.")]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    got = {r.block_id: r.paragraph for r in scans.paragraphs(df.repartition(2)).collect()}
    assert got == {i: "The growth was slow." for i in range(3)} | {3: "The model of Running words of pages was slow."} | {10 + i: "The hydrogel was slow." for i in range(2)} | {20: "Running words of pages the baseline was high."}


@pytest.mark.parametrize(
    "text, noise, clean",
    [
        ("Alloy vascular canopy\nThe growth of the hydrogel was slow in the same samples.", {"header"}, "The growth of the hydrogel was slow in the same samples."),
        ("The growth of the hydrogel was slow in the same\nsamples.\nAlloy vascular canopy\n- 12 -", {"header", "page number"}, "The growth of the hydrogel was slow in the same samples."),
        ("Study design\nThe growth of the hydrogel was slow in the same samples.", set(), "Study design The growth of the hydrogel was slow in the same samples."),
        ("Earlier work by Calderson and Velström agreed\nwith the baseline of the first graph, which was high.", set(), "Earlier work by Calderson and Velström agreed with the baseline of the first graph, which was high."),
    ],
)
def test_heads_set_apart(scanner, text, noise, clean):
    assert scanner.noise(text, "text") == noise and scanner.repaired(text, "text", set()) == clean


def test_heads_on_two_pages(spark):
    """Two pages are enough for what is set apart, also with a misread letter or words of a sentence; body text is none."""
    body = "The growth of the hydrogel was slow in the same samples."
    rows = [(i, 1 + i // 50, i % 50, 0, "text", SENTENCES[i % len(SENTENCES)] + " The running membrane of the model.") for i in range(300)]
    rows += [(900 + i, 90, i, 0, "text", f"{h}\n{body}") for i, h in enumerate(("running membrane", "running mernbrane"))] + [(910 + i, 91, i, 0, "text", f"The running model\n{body}") for i in range(2)]
    rows += [(920 + i, 92, 0, i, "text", f"The running model\n{body}") for i in range(3)] + [(930 + i, 93, i, 0, "text", "The growth of the hydrogel was slow\nin the same samples.") for i in range(2)]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    got = {r.block_id for r in scans.noisy(df).filter("noise = 'header'").collect()}
    assert got == {900, 901, 910, 911}
    assert {r.paragraph for r in scans.paragraphs(df).filter("note_id in (90, 91)").collect()} == {body}


CONTEXT = ["The patient had pain."] * 300 + ["The patient had fever."] * 200 + ["It was a bad outcome."] * 40 + ["A bad sample was lost."] * 30


def test_context_decides(spark):
    """Both words are common: only what stands around tells which one was meant."""
    model, _ = learn(spark, [*CONTEXT, "The patient bad pain."])
    scanner = scans.Scanner(model)
    assert scanner.mended("The patient bad pain.") == "The patient had pain."
    for right in ("It was a bad outcome.", "The patient had fever.", "A bad sample was lost."):
        assert scanner.mended(right) == right


def test_same_at_every_size(spark):
    """A corpus told four times says the same."""
    once = ["The membrane was slow."] * 50 + ["The mernbrane was slow."] + ["Calderson and Velstrom agreed."] * 20 + ["bat and hat"] * 20
    one, four = (scans.Scanner(learn(spark, once * k)[0]) for k in (1, 4))
    for line in ("The mernbrane was slow.", "bat and hat", "Calderson and Velstrom agreed."):
        assert one.mended(line) == four.mended(line)


def test_rare_words_joined(spark, monkeypatch):
    """Words with candidates that are not sent out are found by a join, with the same result."""
    rows = [(i, 1 + i // 100, i % 100, 0, "text", SENTENCES[i % len(SENTENCES)]) for i in range(400)] + [(1000 + i, 20 + i, 0, 0, "text", t) for i, t in enumerate([*MISREAD, "The mern-\nbrane was high."])]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    found = lambda: {tuple(r) for r in scans.noisy(df).collect()}
    paragraphs = lambda: {(r.block_id, r.paragraph) for r in scans.paragraphs(df).collect()}
    want, text = found(), paragraphs()
    assert {b for b, n in want if n == "misread"} == set(range(1001, 1006)) and (1001, "The membrane was measured") in text
    monkeypatch.setattr(channel.learned, "__defaults__", (0,))
    monkeypatch.setattr(channel, "FREQUENT_SHARE", 20)
    assert found() == want and paragraphs() == text


def test_no_text_is_lost(spark):
    """All characters that are no noise come out, per note, whatever the pages."""
    rows = [(i, i % 3, None if i % 7 == 0 else i, i % 2, None if i % 5 == 0 else "text", SENTENCES[i % 6]) for i in range(300)]
    df = spark.createDataFrame(rows, "block_id long, note_id long, page int, ord int, kind string, content string")
    letters = lambda texts: sorted("".join("".join(c for c in t if c.isalnum()) for t in texts))
    got = scans.paragraphs(df).collect()
    for note in range(3):
        assert letters(r.paragraph for r in got if r.note_id == note) == letters(r[5] for r in rows if r[1] == note)


def test_confusions_are_learned(spark):
    words = spark.createDataFrame([("first", 900), ("f1rst", 9), ("other", 500)], "key string, n long")
    pairs = spark.createDataFrame([("f1rst", 9, "1>i", "first", 900)], "w string, n long, op string, r string, n_r long")
    p = channel.learned_confusions(pairs, words)
    assert p["1>i"] == pytest.approx((9 + 2) / (900 + 9 * 0 + 2000)) and p["5>s"] < p["1>i"]
