"""Hand-written cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import markdown as M
from quillspark.functions import title as T
from quillspark.functions import udfs
from quillspark.functions import wikilink as W


def one(spark, make, *values):
    """Value of an expression over a row of the given columns."""
    names = "abc"[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, doi, safe",
    [
        ("10.1234/ab.c.", "10.1234/ab.c", "10.1234￥ab.c"),
        ("10.1234/ab(2020)", "10.1234/ab", "10.1234￥ab"),
        ("10.1234/ab.(2020)", "10.1234/ab.", "10.1234￥ab."),
        ("10.1234/ab.;", "10.1234/ab.", "10.1234￥ab."),
        ("10.1234/ab (PMID: 123)", "10.1234/ab", "10.1234￥ab"),
        ("10.1234/abPMCID: 9", "10.1234/ab", "10.1234￥ab"),
        ("10.1234/abhttps://x.org", "10.1234/ab", "10.1234￥ab"),
        ("10.1234/ab) and", "10.1234/ab", "10.1234￥ab"),
        ("10.1234/S0(99)1", "10.1234/S0(99)1", "10.1234￥S0(99)1"),
        ("10.1234/a:b__c", "10.1234/a:b__c", "10.1234￥ab￥c"),
    ],
)
def test_canonical(spark, raw, doi, safe):
    got = one(spark, D.canonical, raw)
    assert (got["doi"], got["safe"]) == (doi, safe)


def test_canonical_edges(spark):
    assert len(one(spark, D.canonical, "10.1234/" + "a" * 300)["safe"]) == 200
    empty = one(spark, D.canonical, "https://x.org")
    assert empty["doi"] == "" and empty["safe"].startswith("doi-")
    assert one(spark, D.canonical, "https://x.org") == empty


@pytest.mark.parametrize(
    "text, found",
    [
        ("see 10.1234/ab​.12 x", "10.1234/ab.12"), ("10.1234/ 12.5", "10.1234/12.5"), ("10.1234/ab.\n12", "10.1234/ab.12"), ("10.1234/ab 12 34", "10.1234/ab1234"),
        ("10.1234/ab next word", "10.1234/ab"), ("nothing", None),
    ],
)
def test_repair(spark, text, found):
    assert one(spark, lambda a: D.doi_first(D.repair_text(a)), text) == found


def test_repair_goes_on_to_the_end(spark):
    text = "10.1234/a" + " 1" * 5
    assert one(spark, lambda a: D.doi_first(D.repair_text(a)), text) == "10.1234/a11111"
    assert one(spark, lambda a: D.doi_first(D.repair_text(a)), "10.1234/ab 1 c2 d3 e4 f5") == "10.1234/ab1c2d3e4f5"
    long = "10.1234/a" + " 1" * 300 + " word"
    assert one(spark, lambda a: D.doi_first(D.repair_text(a)), long) == "10.1234/a" + "1" * 300


def test_plausible(spark):
    assert one(spark, D.plausible_dois, "10.1234/abc 10.1234/abc1 10.1234/abc.x") == ["10.1234/abc1", "10.1234/abc.x"]


@pytest.mark.parametrize("raw, key", [("[[10.1234￥A|10.1234/A.]]", "10.1234/a"), ("(10.1234/a1) x", "10.1234/a1"), ("no doi", None), (None, None), ("[[N|10.1234/s(1)2;]]", "10.1234/s(1)2")])
def test_key_of_entry(spark, raw, key):
    assert one(spark, D.key_of_entry, raw) == key


@pytest.mark.parametrize("link, parts", [("[[a|b]]", ("a", "b")), ("[[a|b|c]]", ("a", "b|c")), ("[[ a | ]]", ("a", "")), ("[[a]]", None), ("[[a|b]", None), ("a|b", None), (None, None)])
def test_split(spark, link, parts):
    got = one(spark, W.split, link)
    assert (got and tuple(got)) == parts


@pytest.mark.parametrize("link, page", [("[[F/Name.md|x]]", "Name"), ("[[ Name #2|x]]", "Name"), ("[[Name", "Name"), ("todo", None), ("", None), (None, None), ("[[]]", "")])
def test_page(spark, link, page):
    assert one(spark, W.page, link) == page


def merged_by_loop(text):
    """The paragraph rule, line by line."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        line = line.rstrip(" ") if i == 0 else line.strip(" ")
        nxt = lines[i + 1].strip(" ") if i + 1 < len(lines) else None
        if nxt is None:
            out.append(line)
        elif line and nxt and (line[-1] not in M.SENTENCE_END or nxt[0].islower() or line[-1] == "-"):
            out.append(line[:-1] if line[-1] == "-" else line + " ")
        else:
            out.append(line + "\n")
    return "".join(out)


@pytest.mark.parametrize("text", ["one-\ntwo", "One.\ntwo", "One.\nTwo", "one\nTwo", "a\n\nb", "中文\n继续。\n下", "", "x"])
def test_paragraphs(spark, text):
    assert one(spark, M.merged_paragraphs, text) == merged_by_loop(text)


@pytest.mark.parametrize("line, heading", [("2.1 Design", True), ("RESULTS OF ALL", True), ("AB", False), ("Introduction and more", True), ("A sentence.", False)])
def test_headings(spark, line, heading):
    assert one(spark, M.is_heading, line) is heading


def test_headings_are_promoted_once(spark):
    assert one(spark, M.promoted_headings, "# Results\nResults\ntext") == "# Results\n## Results\ntext"


def test_table(spark):
    df = spark.sql("SELECT array(array('a', 'b\nc'), array(CAST(NULL AS STRING))) AS t, array(array('', ' ')) AS e")
    got = df.select(M.table_markdown(F.col("t")).alias("t"), M.table_markdown(F.col("e")).alias("e")).first()
    assert got["t"] == "| a | b c |\n| --- | --- |\n|  |  |\n" and got["e"] == ""


def test_local_images(spark):
    text = "![](http://x/images/a.png) ![](images/b.png) ![](x\\images\\c.png) ![](C:/Vault/IMAGE/d.png) ![](e.png) ![](images/b.png)"
    assert one(spark, M.local_images, text) == ["b.png", "c.png", "d.png"]


def test_reference_entries(spark):
    text = "x\n## References\n[1] One. \n2. Two\nmore\n"
    assert one(spark, M.reference_entries, text) == ["One", "Two"]
    assert one(spark, M.reference_entries, "[1] none") is None


@pytest.mark.parametrize("title, junk", [("", True), ("abc", True), ("Untitled", True), ("Word", True), ("AB CD EF", True), ("A B C OF XENON", True), ("A good title here", False), ("Springer book of x", True), (None, True)])
def test_junk(spark, title, junk):
    assert one(spark, T.is_junk, title) is junk


@pytest.mark.parametrize("raw, cleaned", [("Article in press A title et al.", "A title"), ("A title Jane Miller Ph.D., X", "A title"), ("DOI: 10.1234/x A title", "A title"), ("  A   title - ", "A title")])
def test_clean_title(spark, raw, cleaned):
    assert one(spark, T.clean, raw) == cleaned


def test_file_name(spark):
    assert one(spark, T.file_name, 'a<b>:"c"/d\n e') == "abcd e"
    assert one(spark, T.file_name, "x" * 300) == "x" * 250
    assert one(spark, T.file_name, "word " * 60) == ("word " * 50).strip()


def test_similarity(spark):
    assert one(spark, udfs.similarity, "abcd", "ABCD") == 1.0
    assert one(spark, udfs.similarity, "abcd", "bcde") == 0.75
    assert one(spark, udfs.similarity, None, "x") is None


def test_links(spark):
    text = "[t](http://x/login) [10.1234/a](http://y) [z](http://d.org/10.1234/b1) [[N|x]] ![i](j)"
    assert one(spark, udfs.plain_links, text) == "(t)(http://x/login)  10.1234/a  10.1234/b1 [N|x] ![i](j)"


def test_linked_urls(spark):
    df = spark.createDataFrame([("http://a.b http://a.b/c ](http://a.b",)], "a string")
    assert df.select(udfs.linked_urls(F.col("a"), M.urls(F.col("a")))).first()[0] == "[http://a.b](http://a.b) [http://a.b/c](http://a.b/c) ](http://a.b"


@pytest.mark.parametrize(
    "text, clean",
    [
        ("![a]( //x.org/i.png )", "![a](https://x.org/i.png)"), ("![a](other/i.png)", "!(other/i.png)"), ("![a](images/i.png)", "![a](images/i.png)"), ("[ ![a](images/i.png) more](http://x)", "![a](images/i.png) more(http://x)"),
        ("<nl>x</LCEL>", "x"),
    ],
)
def test_without_artifacts(spark, text, clean):
    assert one(spark, M.without_artifacts, text) == clean


@pytest.mark.parametrize(
    "text, plain",
    [
        ("see  [10.1234/a1](http://x)  now", "see 10.1234/a1 now"), ("see [t](http://x/10.1234/b2) now", "see 10.1234/b2 now"), ("a [t](http://x/login?10.1234/b2) b", "a (t)(http://x/login?10.1234/b2) b"),
        ("a [t](#top) b", "a (t)(#top) b"), ("[[N|x]]", "[N|x]"), ("![i](j)", "![i](j)"), ("a [t](u) b", "a (t)(u) b"),
    ],
)
def test_plain_links_and_blanks(spark, text, plain):
    assert one(spark, udfs.plain_links, text) == plain


def test_json_leaves():
    assert udfs.string_leaves('{"a": ["x", {"b": "y"}], "c": 1, "d": "z"}') == ["x", "y", "z"] and udfs.string_leaves("{") == udfs.string_leaves(None) == []


def test_screened_similarity(spark):
    rows = [("abcd", "abcd", 1.0), ("abcdef", "fedcba", 0.166667), ("abcdxxxx", "dcbayyyy", 0.5), (None, "a", None)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    got = [(r.got, r.want) for r in df.select("want", udfs.screened_similarity("a", "b").alias("got")).collect()]
    assert got[0] == (1.0, 1.0) and got[1][0] < 0.5 and got[2] == (0.5, 0.5) and got[3] == (None, None)


def test_key_of_entry_equals_plain_python(spark):
    import random
    import re

    def plain(raw):
        m = re.search(r"10\.\d{4,9}/[-A-Za-z0-9._;()/:]+", raw.replace("￥", "/"))
        return (m.group().rstrip(".;:/" if "(" in m.group() else ".;:/()").lower() or None) if m else None

    rng = random.Random(4)
    rows = ["10.1234/ab).", "10.1234/S0(99)1.", "10.1234/a(b).", "10.1234/x(", "10.1234￥A;:", "no", "", "10.12/x", "10.1234/((", "x 10.1234/a) 10.5678/b"]
    rows += ["[[10.1234/" + "".join(rng.choice("aB1.;:/()") for _ in range(rng.randrange(1, 9))) + rng.choice([" x", "]]", ""]) for _ in range(300)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", D.key_of_entry(F.col("r")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [plain(r) for r in rows]
