"""Look-alike characters."""

import pytest

from quillspark.llm import lookalikes as K


@pytest.mark.parametrize(
    "value, form",
    [
        ("１０．１２３４／ａｂ－１", "10.1234/ab-1"), ("10.1234/аb​1", "10.1234/ab1"), (" 10.1234/x ", "10.1234/x"), ("10․1234∕a–b", "10.1234/a-b"), ("𝟏𝟎.1234/Α", "10.1234/a"), ("10.1234/­ab", "10.1234/ab"),
    ],
)
def test_doi_cases(value, form):
    assert K.doi_is_case(value) and K.doi_form(value) == form


@pytest.mark.parametrize("value", ["10.1234/ABC", "10.1234/abc", "", " 10.1234/x"])
def test_doi_no_cases(value):
    assert not K.doi_is_case(value)


def test_equal_values_compare_equal():
    assert len({K.doi_form(v) for v in ("10.1234/ABC", "10.1234/аbc", "１０.1234/aBC", "10.1234/ab‍c ")}) == 1


@pytest.mark.parametrize(
    "value, form",
    [
        ("Hierarchical grаph", "Hierarchical graph"), ("Étudе de la", "Étude de la"), ("A b　c", "A b c"), ("Étude", "Étude"), ("cart​ilage", "cartilage"), ("ｉｓｏｔｏｐｅ x", "isotope x"), ("𝐥𝐢𝐠𝐚𝐧𝐝", "ligand"),
        ("clasﬁer", "clasfier".replace("sf", "sfi").replace("fii", "fi")), ("稳健⽻扇豆", "稳健羽扇豆"), ("CD４对", "CD4对"), ("а acute review", "a acute review"), ("Υoreryić said", "Yoreryić said"), ("pathοgen", "pathogen"),
        ("Роль мeмбраны", "Роль мембраны"), ("co­rtex", "cortex"),
    ],
)
def test_title_cases(value, form):
    assert K.title_is_case(value) and K.title_form(value) == form


@pytest.mark.parametrize(
    "value",
    [
        "Effects of β-catenin", "TNF-α对小鼠的影响", "NFκB and TNFα in mice", "“quoted” – dash’s", "Größere Étude", "Роль мембраны", "《基因组》：综述，一（二）？", "4 °C ± 2", "", "Динамика TNF в тканях", "γδT cells", "H²O ™ №", "👩‍🔬 in the lab", "плазма и кровь", "Рост и о",
    ],
)
def test_title_no_cases(value):
    assert not K.title_is_case(value), K.title_form(value)


def test_operator(spark):
    rows = [(1, "10.1234/аb", "plain", "x"), (1, "10.1234/аb", "plain", "x"), (2, None, "grаph of all", "x"), (3, "", "​", "x"), (4, "10.1234/x", "Doseâ€“response", "x"), (5, None, None, "x"), (6, "10.1/x", ("long text " * 5000) + "grаph", "x")]
    df = spark.createDataFrame(rows, "note_id long, doi string, title string, form string")
    got = {(r.ident, r.field): r.form for r in K.cases(df).collect()}
    assert got[1, "doi"] == "10.1234/ab" and got[2, "title"] == "graph of all" and got[3, "title"] == ""
    assert set(got) == {(1, "doi"), (2, "title"), (3, "title"), (6, "title")}
    assert K.cases(df.limit(0)).count() == 0


def test_doi_letters_by_script():
    """A word is spelled in Latin letters if all of it can be; one with letters that have no look-alike is of its own script."""
    assert K.doi_form("10.1234/АВС.оре") == "10.1234/abc.ope" and K.doi_is_case("10.1234/АВС")
    assert not K.doi_is_case("10.1234/журнал")
