"""Encoding with chunk reuse equals encoding in one piece."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def enc():
    return encoding.Encoder()


def texts(seed, n=120):
    rng = random.Random(seed)
    parts = ["The cat's hat ", "it'll  do\n\n", "数据处理，模型。", "x" * 90, "don't!", " \t ", "123,456.78 ", "é̂ ü ", "<|endoftext|>", "🙂🙂 ", "a b c d ", "'s 're", "\r\n", "中" * 70, " 　  ", "word " * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("bits", [3, 5, 9])
def test_equals_plain(enc, monkeypatch, bits):
    monkeypatch.setattr(encoding, "CUT_BITS", bits)
    t = texts(bits) + [None, "", " ", "a"] + texts(bits)[:20]
    offsets, ids = enc.encode_column(pa.array(t, pa.string()))
    for i, s in enumerate(t):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.plain(s or ""), repr(s)


def test_sliced_columns_and_small_tables(enc):
    t = texts(1, 30)
    offsets, ids = enc.encode_column(pa.array(t).slice(10, 5))
    assert ids[: offsets[1]].tolist() == enc.plain(t[10])
    small = encoding.Encoder(table_bytes=1000)
    offsets, ids = small.encode_column(pa.array(t))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc.plain(s) for s in t]
    assert small.room <= 1000


def test_chunks_are_shared(enc):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij klmnop. ") for _ in range(20_000))
    data = lambda s: np.frombuffer(s.encode(), np.uint8)
    one, two = encoding.cut_points(data("x" * 77 + passage)), encoding.cut_points(data(passage))
    assert len(two) > 10 and set(one - 77) >= {c for c in two if c > encoding.WINDOW}


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in encoding.encoded(df).collect()]
    plain = encoding.Encoder().plain
    assert sorted(got) == sorted([(1, plain("hello world")), (1, plain("hello world")), (2, []), (3, []), (4, plain("<|endoftext|>"))])
    assert 50256 not in dict(got)[4]
    assert encoding.encoded(df.limit(0)).count() == 0


def test_very_long_text(enc):
    s = "".join(texts(9, 400))
    offsets, ids = enc.encode_column(pa.array([s]))
    assert ids.tolist() == enc.plain(s)
