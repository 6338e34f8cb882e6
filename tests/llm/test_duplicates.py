"""Duplicates hidden by formatting differences, against a brute-force version."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark import tables
from quillspark.llm import duplicates

SCHEMA = "id long, g string, text string, extra string"


def brute(rows):
    groups = defaultdict(set)
    for i, g, text, _ in rows:
        if text is not None and i is not None:
            words = sorted(re.findall(r"[^\W_]+", text.casefold()))
            groups[g, tuple(words)].add(i)
    return {(min(v), i, len(v)) for v in groups.values() for i in v if i != min(v)}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.keep, r.id, r.n) for r in duplicates.copies(df, "id", "text", ["g"]).collect()}
    counts = {r.keep: r.n_copies for r in duplicates.collapsed(df, "id", "text", ["g"]).collect()}
    return got, counts


def variants(rng, n):
    out = []
    for i in range(n):
        words = [rng.choice(["Über", "straße", "alpha", "β", "x1", "中文", "a"]) for _ in range(rng.randrange(0, 4))]
        rng.shuffle(words)
        text = rng.choice([" ", ", ", "-", "　", " | "]).join(words)
        out.append((i, rng.choice("gh"), rng.choice([text, text.upper(), f"({text})", text + "."]), ""))
    return out


def test_equals_brute_force(spark):
    rows = variants(random.Random(1), 400)
    rows += rows[:50] + [(900, "g", None, ""), (901, None, "a b", ""), (902, None, "B, A", ""), (903, "g", "", ""), (904, "g", " .!", ""), (None, "g", "a", "")]
    got, counts = run(spark, rows)
    assert got == brute(rows)
    assert (901, 902, 2) in got
    assert sum(counts.values()) == len({r[0] for r in rows if r[2] is not None and r[0] is not None})


def test_hot_keys_are_salted_with_the_same_result(spark, monkeypatch):
    rows = variants(random.Random(2), 200) + [(1000 + i, "g", "hot key" if i % 2 else "KEY; hot", "") for i in range(300)]
    plain, _ = run(spark, rows)
    monkeypatch.setattr(tables, "HOT_ROWS", 20)
    salted, _ = run(spark, rows)
    assert plain == salted == brute(rows)


def test_empty_and_long(spark):
    assert run(spark, []) == (set(), {})
    long = "word " * 200_000
    got, _ = run(spark, [(1, "g", long, ""), (2, "g", long.upper(), ""), (3, "g", long + "x", "")])
    assert got == {(1, 2, 2)}


def test_order_and_case_of_all_kinds(spark):
    df = spark.createDataFrame([("Γ-SECRETASE of Größe",), ("of GRÖSSE, γ secretase",)], "t string")
    assert df.select(duplicates.canonical_key(F.col("t")).alias("k")).distinct().count() == 1
