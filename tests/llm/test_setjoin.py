"""Similar pairs of sets, against brute force."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.llm import setjoin


def pairs(spark, sets, t, most):
    df = spark.createDataFrame([(i, s, "x") for i, s in sets], "id long, items array<string>, toks string")
    tokens = setjoin.token_sets(df.drop("toks"), "id", F.col("items")).dropDuplicates(["id"])
    distinct = setjoin.classes(tokens)
    member = {r.id: r["class"] for r in setjoin._membership(tokens, distinct).collect()}
    links = {(r.a, r.b) for r in setjoin.similar_classes(distinct, t, most).collect()}
    out = {(min(i, j), max(i, j)) for i in member for j in member if i < j and (member[i] == member[j] or (min(member[i], member[j]), max(member[i], member[j])) in links)}
    return out


def brute(sets, t):
    sets = [(i, {x for x in s if x is not None}) for i, s in sets if s]
    sets = {i: s for i, s in sets if s}
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * t.denominator >= t.numerator * len(sets[i] | sets[j])}


def made(seed):
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(40):
        base = rng.sample(range(300), rng.choice([1, 2, 3, 5, 6, 7, 8, 12, 13, 14, 19, 30]))
        for _ in range(rng.choice([1, 2, 3])):
            s = set(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                s.add(rng.randrange(300)) if rng.random() < 0.5 else s.discard(rng.choice(base))
            out.append((n, [f"t{x}" for x in s] + ["hot"] * (rng.random() < 0.5)))
            n += 1
    return out + [(n, None), (n + 1, []), (n + 2, [None]), (0, out[0][1])]


@pytest.mark.parametrize("seed, t, most", [(1, Fraction(85, 100), 40), (2, Fraction(85, 100), 3), (3, Fraction(70, 100), 40), (4, Fraction(85, 100), 500)])
def test_equals_brute_force(spark, seed, t, most):
    sets = made(seed)
    want = brute(sets, t)
    assert len(want) > 10
    assert pairs(spark, sets, t, most) == want


def test_hot_tokens_are_spread(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PAIR_LIMIT", 2)
    sets = made(5)
    assert pairs(spark, sets, Fraction(85, 100), 3) == brute(sets, Fraction(85, 100))


def test_nothing(spark):
    assert pairs(spark, [(1, [])], Fraction(85, 100), 40) == set()


def test_sizes():
    t = Fraction(85, 100)
    assert setjoin.overlap(7, 7, t) == 7 and setjoin.overlap(6, 7, t) == 6 and list(setjoin.partners(7, t)) == [6, 7, 8]
    small = setjoin.largest_small(t)
    assert 7 <= small < 20
