"""Garbled text: round trips through wrong encodings, and texts that only look odd."""

import pytest

from quillspark.llm import mojibake
from quillspark.llm.language import Language

CORPUS = [
    "Dose–response of the acute membrane in mice", "Effects of β-catenin on growth below 4 °C", "Étude de la protéine sévère chez 12 participants", "Größere Schwelle nach Müller (2010)",
    "¿Es la lesión genética una señal útil?", "AVALIAÇÃO DA MUTAÇÃO EM 12 CASOS", "Роль мембраны в развитии опухоли", "Динамика популяции после лечения", "基于质谱分析的蛋白质综述", "《基因组》与慢性肿瘤综述",
    "Comments on Ruskić and Pellé", "Plasma and alloy as “dense” targets in mice", "Sorrel’s network revisited", "La cohorte, l’hérédité et la réponse aiguë", "Membrane dynamics after loss: 95 ± 37 cases",
]


@pytest.fixture(scope="module")
def decoder():
    return mojibake.Decoder(Language.of(CORPUS * 40))


def read_wrong(text, true, wrong):
    raw = text.encode(true)
    if wrong != "cp1252":
        return raw.decode(wrong)
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "gb18030"])
@pytest.mark.parametrize("text", [t for t in CORPUS if not t.isascii()])
def test_utf8_read_wrong_is_restored(decoder, text, wrong):
    try:
        bad = read_wrong(text, "utf-8", wrong)
    except UnicodeDecodeError:
        pytest.skip("not readable so")
    assert decoder.damaged(bad)
    assert decoder.restore(bad) == text


def test_two_layers(decoder):
    for text in CORPUS:
        if not text.isascii():
            bad = read_wrong(read_wrong(text, "utf-8", "cp1252"), "utf-8", "cp1252")
            assert decoder.restore(bad) == text


def test_other_true_encodings(decoder):
    assert decoder.restore(read_wrong("基于质谱分析的蛋白质综述", "gb18030", "latin-1")) == "基于质谱分析的蛋白质综述"
    assert decoder.restore(read_wrong("Роль мембраны в развитии опухоли", "cp1251", "latin-1")) == "Роль мембраны в развитии опухоли"


def test_lost_bytes(decoder):
    assert decoder.restore("Dose�response of the acute membrane in mice") == "Dose–response of the acute membrane in mice"
    assert decoder.restore("La cohorte, l�h�r�dit� et la r�ponse aigu�") == "La cohorte, l’hérédité et la réponse aiguë"
    assert decoder.damaged("����")


def test_correct_texts_are_left(decoder):
    for text in [*CORPUS, "plain", "", "Ærøskøbing", "naïve 中文 mixed", "São Tomé"]:
        assert decoder.restore(text) == text and not decoder.damaged(text)


def test_operator(spark):
    bad = read_wrong(CORPUS[0], "utf-8", "cp1252")
    rows = [(i, t, "x") for i, t in enumerate(CORPUS * 20)] + [(900, bad, "x"), (900, bad, "x"), (901, None, "x"), (902, "", "x"), (903, "�", "x"), (904, (CORPUS[1] + " ") * 3000, "x"), (None, bad, "x")]
    df = spark.createDataFrame(rows, "note_id long, title string, restored string")
    got = {r.note_id: r.restored for r in mojibake.restored(df, "note_id", "title").collect()}
    assert set(got) == {900, 903} and got[900] == CORPUS[0]
    assert mojibake.restored(df.limit(0), "note_id", "title").count() == 0


def test_damage_that_counts_itself(spark):
    """Titles damaged by a single-byte channel are part of the corpus their oddness is told by."""
    meant = ["Die Membran für das Gewebe", "Wege zur grünen Membran"]
    bad = [read_wrong(t, "cp1252", "mac_roman") for t in meant]
    assert all(map(mojibake.clean, bad)) and not set(bad) & set(meant)
    good = ["Die Membran für das Gewebe und der Knochen", "Das Gewebe für die grünen Zellen", "The membrane of the mice", "Wege zur Membran für alle"] * 30
    rows = [(i, t) for i, t in enumerate(good)] + [(900 + i, t) for i, t in enumerate(bad)]
    got = {r.note_id: r.restored for r in mojibake.restored(spark.createDataFrame(rows, "note_id long, title string"), "note_id", "title").collect()}
    assert got == {900 + i: t for i, t in enumerate(meant)}


def test_lost_han_character_is_read_from_its_place(decoder):
    assert decoder.restore("基于质谱分析的蛋�质综述") == "基于质谱分析的蛋白质综述"


def test_layers_without_end(decoder):
    """As many layers of wrong decoding as there are."""
    bad = text = "Größere Schwelle nach Müller"
    for _ in range(5):
        bad = read_wrong(bad, "utf-8", "cp1252")
    assert decoder.restore(bad) == text


def test_a_reading_that_the_corpus_makes_worse_is_none(decoder):
    assert decoder.best("Müller", {1}, {1: [(2, "ж")]}) == "Müller"


def test_lost_letters_are_of_the_words_script(decoder):
    assert decoder.restore("Gr��ere Schwelle nach M�ller (2010)") == "Größere Schwelle nach Müller (2010)"
