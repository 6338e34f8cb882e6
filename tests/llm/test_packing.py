"""Containers: nothing lost, nothing too full, little room left."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import encoding, packing


def check(histogram, capacity):
    kinds = packing.plan(dict(histogram), capacity)
    got = Counter()
    for n, content in kinds:
        assert n > 0 and sum(a * b for a, b in content) <= capacity
        for length, each in content:
            got[length] += n * each
    assert got == Counter({k: v for k, v in histogram.items() if k and v})
    rows, containers = packing.places(kinds)
    at = defaultdict(int)
    for length, lo, hi, base, each in rows:
        assert at[length] == lo and (hi - lo) % each == 0 and base + (hi - lo) // each <= containers
        at[length] = hi
    return containers


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 40)), st.integers(30, 40))
def test_plan_keeps_all(histogram, capacity):
    containers = check(histogram, capacity)
    used = sum(k * v for k, v in histogram.items())
    assert containers <= 2 * -(-used // capacity) + 1


def test_exact_fills_come_first():
    assert check({10: 4}, 10) == 4
    assert check({6: 5, 4: 5}, 10) == 5
    assert check({5: 3, 3: 3, 2: 3}, 10) == 3
    assert check({}, 10) == 0


def test_near_the_bound():
    rng = random.Random(1)
    histogram = Counter(min(512, int(rng.lognormvariate(4.5, 1))) for _ in range(50_000))
    containers = check(histogram, 512)
    assert containers <= 1.001 * sum(k * v for k, v in histogram.items()) / 512 + 1


@pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary here")
def test_operator(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 9, 30, 200])))) for i in range(300)] + [(300 + i, t) for i, t in enumerate([None, "", "alpha", "alpha"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = encoding.Encoder().plain
    sizes = {i: len(plain(t or "")) for i, t in rows}
    got = packing.packed(df, [("s", 16), ("m", 64), (None, 3)]).collect()
    for pack, capacity in (("s", 16), ("m", 64)):
        own = [r for r in got if r.pack == pack]
        fill, pieces = Counter(), defaultdict(list)
        for r in own:
            assert r.capacity == capacity
            fill[r.container] += r.n_tokens
            pieces[r.doc_id].append((r.piece, r.n_tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(max(fill) + 1))
        for i, n in sizes.items():
            p = sorted(pieces[i])
            assert [k for k, _ in p] == list(range(len(p))) and sum(x for _, x in p) == n
            # cut only if too long, and then into whole containers and a rest
            assert len(p) == max(1, -(-n // capacity)) and all(x == capacity for _, x in p[:-1])
        assert len(fill) <= 1.05 * sum(sizes.values()) / capacity + 2
    assert packing.packed(df.limit(0), [("s", 16)]).count() == 0
