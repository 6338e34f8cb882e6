"""Operators of the core on small fixtures, with the edge cases their docstrings define."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import linkage, orphans, refs, vault
from quillspark.sinks import vault as sinks
from quillspark.sources import vault as sources
from quillspark.streaming import inbox
from quillspark import bloom, tables
from quillspark.tables import lookup, once, ranked

T0 = dt.datetime(2024, 1, 1)
POINTERS = "id long, carrier long, key string, extra string"
PARENTS = "key string, since timestamp_ntz, extra string"


def found(spark, pointers, parents, carriers):
    p = spark.createDataFrame(pointers, POINTERS)
    q = spark.createDataFrame(parents, PARENTS)
    c = spark.createDataFrame(carriers, "carrier long, as_of timestamp_ntz, extra string")
    return {(r.id, r.reason) for r in orphans.find_orphans(p, q, c, ["id"]).collect()}


def test_orphans(spark):
    late = T0 + dt.timedelta(days=1)
    pointers = [(1, 1, "a", ""), (2, 1, "b", ""), (3, 1, "late", ""), (4, 9, "late", ""), (5, 1, None, ""), (6, 1, "open", ""), (2, 1, "b", ""), (7, 2, "late", "")]
    parents = [("a", T0, ""), ("late", late, ""), ("a", late, ""), (None, T0, ""), ("open", None, "")]
    # unknown carriers and those without a time cannot tell that something is late
    assert found(spark, pointers, parents, [(1, T0, ""), (2, None, "")]) == {(2, "absent"), (3, "late")}


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], [], []) == set()
    assert found(spark, [(1, 1, "a", "")], [], []) == {(1, "absent")}
    assert found(spark, [], [("a", T0, "")], [(1, T0, "")]) == set()


def test_orphans_do_not_depend_on_the_filter(spark, monkeypatch):
    """A filter that is far too small only sends more pointers to the exact join."""
    monkeypatch.setattr(bloom.bloom_filter, "__defaults__", (10, 64))
    pointers = [(i, 1, f"k{i}", "") for i in range(300)]
    parents = [(f"k{i}", T0, "") for i in range(0, 300, 2)]
    assert found(spark, pointers, parents, [(1, T0, "")]) == {(i, "absent") for i in range(1, 300, 2)}


def test_hot_keys_are_spread(spark):
    """Keys above an absolute limit meet their row in many tasks; the result is that of a plain join."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "warm").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string")).alias("key"))
    dim = spark.createDataFrame([("hot", 1), ("4", 2), ("warm", 3)], "key string, v int")
    want = sorted(map(repr, rows.join(dim, "key", "left").select("id", "key", "v").collect()))
    for limit in (100, 500, 5000):
        got = lookup(rows, "key", dim, limit)
        assert got.columns == ["id", "key", "v"] and sorted(map(repr, got.collect())) == want
    hot = tables.Hot(rows, "key", 500)
    salted = rows.withColumn("salt", hot.salt(F.col("key"), F.col("id"))).groupBy("key", "salt").count()
    assert hot.n == 1 and salted.filter("key = 'hot'").agg(F.max("count")).first()[0] < 100 and salted.filter("key = 'hot'").count() == tables.SALTS


def test_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "d"), (3, "e"), (3, "e")], "id long, x string")
    assert sorted(map(repr, once(rows, "id").collect())) == sorted(map(repr, rows.distinct().collect()))
    assert once(rows.limit(0), "id").count() == 0


def test_no_silent_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = spark.conf.__class__.__new__(spark.conf.__class__)

    session = Session()
    session.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()
    with pytest.raises(ValueError, match="checkpoint"):
        tables.ensure_checkpoint_dir(session)


def test_ranked(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert all(r.x == r["rank"] for r in ranked(rows, "x").collect())
    assert ranked(rows.limit(0), "x").count() == 0


def test_similar_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [[f"t{rng.randrange(40)}" for _ in range(rng.randrange(0, 15))] for _ in range(25)]
    sets = [sorted({*b, *([f"u{rng.randrange(9)}"] if rng.random() < 0.5 else [])} - ({b[0]} if b and rng.random() < 0.3 else set())) for b in base for _ in range(3)]
    left, right = list(enumerate(sets[::2])), list(enumerate(sets[1::2]))
    want = {(i, j, round(len({*a} & {*b}) / len({*a} | {*b}), 6)) for i, a in left for j, b in right if a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.85}
    assert want
    df = lambda x: spark.createDataFrame(x, "id long, items array<string>")
    got = {(r.left_id, r.right_id, r.score) for r in linkage.similar(df(left), df(right), linkage.THRESHOLD).collect()}
    assert got == want


def test_deduped_and_pinned(spark):
    items = ["[[a/b|10.1234/X]]", "[[c|10.1234/x]]", "Plain", "plain", "Plain", None, " Plain "]
    df = spark.createDataFrame([(items, "10.1234/x"), ([], None), (None, "10.1234/q")], "r array<string>, d string")
    rows = df.select(refs.deduped(F.col("r")).alias("a"), refs.pinned(F.col("r"), F.col("d")).alias("b")).collect()
    assert rows[0]["a"] == ["[[a￥b|10.1234/X]]", "Plain", "plain"]
    assert rows[0]["b"][:2] == ["[[10.1234￥x|10.1234/x]]", "Plain"]
    assert rows[1]["a"] == [] and rows[1]["b"] == [] and rows[2]["a"] is None


def test_claims(spark):
    rows = [("f", 1, 10, 0, "a"), ("f", 1, 10, 1, "b"), ("f", 2, 20, 0, "a"), ("f", 2, 20, 1, "c"), ("g", 1, 30, 0, "a"), ("f", 2, 20, 2, "b")]
    got = refs.claims(spark.createDataFrame(rows, "folder string, ord int, note_id long, age int, doi string"), 2).collect()
    assert {tuple(r) for r in got} == {("f", 10, 1, "a"), ("f", 10, 2, "b"), ("f", 20, 1, "c"), ("g", 30, 1, "a")}


def test_claims_equal_going_through_in_order(spark):
    import random

    rng = random.Random(5)
    rows = sorted({(rng.choice("fg"), i, 100 + i, rng.randrange(5), f"d{rng.randrange(25)}") for i in range(12) for _ in range(8)})
    rows = list({(f, o, n, d): (f, o, n, a, d) for f, o, n, a, d in rows}.values())
    want = set()
    for folder in "fg":
        taken: set = set()
        for note in sorted({r[2] for r in rows if r[0] == folder}):
            got = [d for _, d in sorted((r[3], r[4]) for r in rows if r[0] == folder and r[2] == note) if d not in taken][:3]
            taken.update(got)
            want |= {(folder, note, i + 1, d) for i, d in enumerate(got)}
    df = spark.createDataFrame(rows, "folder string, ord int, note_id long, age int, doi string")
    assert {tuple(r) for r in refs.claims(df, 3).collect()} == want
    assert refs.claims(df.limit(0), 3).count() == 0


def test_new_citing(spark):
    links = spark.createDataFrame([("x", i) for i in range(1, 7)] + [("y", 1)], "doi string, citing long")
    seen = [(1, 1, "2024/01/02", "10.1/A"), (2, 2, "2024/01/02", "10.1/b"), (3, 3, "2012/01/02", "10.1/c"), (4, 4, "no date", "10.1/d"), (5, 5, "2024/05/05", None), (6, 6, "2023/01/01", "10.1/f")]
    summaries = spark.createDataFrame(seen, "citing long, ord long, published string, citing_doi string")
    listed = spark.createDataFrame([("x", "10.1/f"), ("z", "10.1/a")], "doi string, key string")
    got = {tuple(r) for r in refs.new_citing(links, summaries, listed, "2024-06-30").select("doi", "place", "citing_doi", "n_citing").collect()}
    assert got == {("x", 1, "10.1/A", 6), ("x", 2, "10.1/b", 6), ("y", 1, "10.1/A", 1)}


def test_numbered_names(spark):
    """Numbers that names of the folder bear already are left free; a name of a third of all rows is no group of its own."""
    names = ["a"] * 4 + ["a (1)", "a (3)", "b"] + ["c"] * 300
    rows = spark.createDataFrame([(i, "d", n, f"p{i:04d}") for i, n in enumerate(names)] + [(900, "e", "a", "q")], "note_id long, dir string, name string, path string")
    got = {r.note_id: r.k for r in vault.numbered_names(rows).collect()}
    assert [got[i] for i in range(4)] == [0, 2, 4, 5] and got[900] == got[4] == got[6] == 0 and sorted(got[7 + i] for i in range(300)) == list(range(300))


def test_uri(spark):
    def parsed(uri):
        r = spark.createDataFrame([(uri,)], "u string").select(vault.parsed_uri(F.col("u")).alias("x")).first()["x"]
        return r and tuple(r)

    assert parsed("obsidian://open?vault=My%20Vault&file=a%2Fb+c%20") == ("My Vault", "a/b c")
    assert parsed("obsidian://open?vault=V&file=a%2520b") == ("V", "a b")
    assert parsed("obsidian://open?vault=V") is None and parsed("https://x.org/?vault=V&file=a") is None and parsed("plain/path.md") is None


def test_link_status(spark):
    cases = [("[[a|x]]", "a", True, "skipped"), ("[[a|x]]", "b", True, "matched"), ("[[a|x]]", "b", False, "skipped"), ("[[a|x]]", None, True, "skipped"), ("", None, True, "failed"), (None, "b", False, "matched"), ("", "b", True, "matched")]
    df = spark.createDataFrame(cases, "e string, t string, f boolean, want string")
    assert all(r.got == r.want for r in df.select("want", linkage.link_status(F.col("e"), F.col("t"), F.col("f")).alias("got")).collect())


def test_doi_sets_take_all(spark):
    items = ["see [[n|10.1/a 10.12345/b\n10.12345/c]] end", "10.12345/d and 10.12345/e", None, ""]
    got = spark.createDataFrame([(items,)], "r array<string>").select(linkage.doi_set(F.col("r")).alias("s")).first()["s"]
    assert got == ["10.12345/b", "10.12345/c", "10.12345/d", "10.12345/e"]


def test_rebuilt_lists(spark):
    from quillspark.operators import graph

    rows = [(1, "reference", i, x) for i, x in enumerate(["[[N|10.1234/A1]]", "Plain text", "plain TEXT", "10.1234/a1", "[[q|10.1234/abc]]", " ", "[[M|10.1234/a1.]]"])]
    got = graph.rebuilt_lists(spark.createDataFrame(rows, "note_id long, field string, pos int, raw string")).orderBy("pos").collect()
    assert [(r.pos, r.raw, r.doi) for r in got] == [(0, "[[N|10.1234/A1]]", "10.1234/A1"), (1, "Plain text", None)]


def test_archived_images(spark):
    bodies = spark.createDataFrame([(1, "![a](../images/ab.jpg) ![b](C:\\v\\images\\0f.png) ![](images/cd.jpg)"), (2, None), (3, "![x](D:/y/images/ee.gif)")], "note_id long, body string")
    inventory = spark.createDataFrame([("ab.jpg", "common", 1), ("ab.jpg", "vault", 0), ("0f.png", "common", 1)], "name string, source string, priority int")
    there = spark.createDataFrame([("0f.png",)], "name string")
    assert {tuple(r) for r in vault.archived_images(bodies, inventory, there).collect()} == {(1, "ab.jpg", "vault"), (1, "0f.png", "there"), (3, "ee.gif", None)}


def test_unreferenced(spark):
    inventory = spark.createDataFrame([("a.png",), ("b.png",), ("b.png",)], "name string")
    texts = spark.createDataFrame([("![](images/a.png)",), (None,), ("![[b.png]]",)], "text string")
    assert [r.name for r in vault.unreferenced(inventory, texts).collect()] == ["b.png"]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "vault"
    (root / "a" / "sub").mkdir(parents=True)
    (root / "a" / "One.md").write_bytes("﻿---\r\ntitle: T\r\ntags: [x]\r\n---\r\nBody\r\n".encode())
    (root / "a" / "sub" / "Two.md").write_bytes("---\ntitle: 中文\n---\n正文".encode("gbk"))
    (root / "a" / "Three.md").write_text("no front matter\n")
    (root / "a-b.md").write_text("---\n: [broken\n---\nx")
    (root / "p.json").write_text('{"a": [1, "x"]}')
    (root / "q.json").write_text("{broken")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("d/full.md", "text")
        z.writestr("d/images/i.png", b"1")
        z.writestr("d/other.txt", "x")
    (root / "bad.zip").write_bytes(b"nothing")
    return root


def test_sources(spark, folder):
    pytest.importorskip("yaml")
    got = {r.stem: r for r in sources.markdown_notes(spark, str(folder)).collect()}
    assert set(got) == {"One", "Two", "Three", "a-b"}
    assert json.loads(got["One"].fm) == {"title": "T", "tags": ["x"]} and got["One"].body == "Body\n"
    assert json.loads(got["Two"].fm) == {"title": "中文"} and got["Two"].body == "正文"
    assert got["Three"].fm == "{}" and got["Three"].body == "no front matter\n"
    assert got["a-b"].fm == "{}" and list(got["One"].path_parts) == ["a", "One.md"]
    flat = sources.markdown_notes(spark, str(folder / "a"), recursive=False).collect()
    assert {r.stem for r in flat} == {"One", "Three"}
    assert {r.name for r in sources.file_names(spark, str(folder), "*.json").collect()} == {"p.json", "q.json"}
    values = {r.path[-6:]: r.s for r in sources.json_values(spark, str(folder)).select("path", F.to_json("value").alias("s")).collect()}
    assert values["p.json"] == '{"a":[1,"x"]}' and values["q.json"] is None
    assert {(r.member, r.kind) for r in sources.zip_members(spark, str(folder)).collect()} == {("d/full.md", "text"), ("d/images/i.png", "image")}
    assert sources.cached(spark, str(folder / "none"), "a int").count() == 0


def test_sinks(spark, folder, tmp_path):
    pytest.importorskip("yaml")
    notes = sources.markdown_notes(spark, str(folder))
    out = str(tmp_path / "out")
    assert sinks.write_notes(notes, out) == 4
    again = {r.stem: (r.fm, r.body) for r in sources.markdown_notes(spark, out).collect()}
    assert again == {r.stem: (r.fm, r.body) for r in notes.collect()}
    sinks.save_lookup(spark.createDataFrame([(1,)], "a int"), f"{out}/t")
    assert sources.cached(spark, f"{out}/t", "a int").count() == 1
    plan = spark.createDataFrame([(f"{folder}/p.json", f"{out}/c/p.json"), (f"{folder}/x", f"{out}/c/x"), (f"{folder}/p.json", f"{out}/a/One.md")], "source string, target string")
    assert {r.target.rsplit("/", 1)[1]: r.status for r in sinks.carried_out(plan).collect()} == {"p.json": "copied", "x": "not found", "One.md": "exists"}


def test_first_deliveries(spark, tmp_path):
    rows = [(1, T0), (1, T0 + dt.timedelta(days=2)), (2, T0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "note_id long, received_at timestamp").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("note_id long, received_at timestamp").parquet(path)
    assert sorted(r.note_id for r in inbox.run_to_end(inbox.first_deliveries(stream), str(tmp_path / "out")).collect()) == [1, 2]


def test_begun_paths(spark):
    """A name that only begins a stem leads to the newest such note that resembles it."""
    saved = [(1, "Alder_2002_Plasma", 1), (2, "Alder_2002_Plasma_a", 2), (3, "Alder_2002_Plasma_b", 3), (4, "Alder_2002_Plasma_of_very_many_other_words", 9), (5, "Birch", 1), (6, "alder_2002_Plasm", 9)]
    notes = spark.createDataFrame(saved, "note_id long, stem string, mtime int")
    asked = spark.createDataFrame([(10, "Alder_2002_Plasma_"), (11, "Alder_2002_Pl.md"), (12, "Bi"), (13, "Birc..."), (14, ".md"), (15, "irch"), (16, "Birch")], "note_id long, page string")
    got = {r.note_id: (r.found_id, r.priority) for r in vault.begun_paths(asked, notes).collect()}
    assert got == {10: (3, 3), 11: (3, 3), 13: (5, 3), 16: (5, 3)}


def test_pdf_pages(spark, tmp_path):
    """Pages by a reader that is given; broken files have no rows; the first page with a DOI decides."""
    from quillspark.operators import texts

    (tmp_path / "a.pdf").write_bytes(b"none here|see 10.1234/ab 1 and 10.1234/zz9|10.1234/q8")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"10.1234/c1")

    def read(data):
        if data == b"broken":
            raise ValueError
        return data.decode().split("|")

    pages = sources.pdf_pages(spark, str(tmp_path), read)
    assert sorted((r.path[-5:], r.page) for r in pages.collect()) == [("a.pdf", 0), ("a.pdf", 1), ("a.pdf", 2)]
    assert [r.doi for r in texts.first_page_dois(pages).collect()] == ["10.1234/ab1"]


def test_never_worked_on(spark):
    from quillspark.operators import texts

    df = spark.createDataFrame([('{"title": "x"}',), ('{"aliases": null}',), ('{"reference": []}',), ("{}",), (None,)], "fm string")
    assert [r.x for r in df.select(texts.never_worked_on(F.col("fm")).alias("x")).collect()] == [True, False, False, True, True]
