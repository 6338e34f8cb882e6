"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by content-defined chunk reuse.

A rolling hash over the text's bytes cuts every text where its last 32 bytes say so, so the same passage is cut alike in
every document. A chunk is encoded once per Python worker and then taken from a table. Only the ends of two chunks that
meet depend on each other: from the last place in the left chunk at which the tokenizer starts anew whatever stands
around it, to the first such place in the right chunk, the text is encoded again; a chunk without such a place is
joined as a whole with its neighbours. The ids therefore agree exactly with those of the text encoded in one piece.
The table holds no more than a bounded number of bytes per worker and is emptied when full; that changes no result.

Defined results
    null text and empty text: an empty list; special tokens' strings are ordinary text; documents delivered twice come
    out twice; a text of any length is processed whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.tables import parallel, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's own way to split text before merging bytes (public, belongs to the vocabulary).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk ends where these bits of the hash are zero: every 512 bytes on average.
CUT_BITS = 9
WINDOW = 32
TABLE_BYTES = 96 << 20
#: Places where a new piece starts whatever stands before or after: a blank after a word or a stop, or a stop after a word.
RESTART = re.compile(r"(?<=[A-Za-z0-9一-鿿.,;:!?)\]])(?=[ \n])|(?<=[A-Za-z一-鿿])(?=[,.;:!?，。；：、（）《》])")


def _gear() -> np.ndarray:
    """One fixed pseudo-random number per byte value (from a linear congruence)."""
    out, x = np.empty(256, np.uint32), 2463534242
    for i in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out[i] = x >> 32
    return out


_GEAR = _gear()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of UTF-8 ``data`` at which a chunk may begin: a function of the 32 bytes before."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # the sum over a window of 32 bytes, each shifted by its distance, by doubling
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    at = at[at < len(data)]
    for _ in range(3):  # on to the next character's first byte
        inside = (data[at] & 0xC0) == 0x80
        at = at + inside
        at = at[at < len(data)]
    return np.unique(at)


class Encoder:
    """Encodes texts with a table of chunks seen before."""

    def __init__(self, vocabulary: str = VOCABULARY, table_bytes: int = TABLE_BYTES):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.plain = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks: dict[bytes, tuple] = {}
        self.joints: dict[str, np.ndarray] = {}
        self.room = self.table_bytes = table_bytes

    def _spend(self, n: int) -> None:
        self.room -= n + 200
        if self.room < 0:
            self.chunks.clear()
            self.joints.clear()
            self.room = self.table_bytes

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.plain(text), np.int32)

    def _chunk(self, chunk: bytes) -> tuple:
        """(head, ids between, tail); ids are None for a chunk that does not hold two restarts."""
        text = chunk.decode("utf-8")
        first = RESTART.search(text, 1)
        if first is None:
            entry = (text, None, "")
        else:
            a = b = first.start()
            at = max(a, len(text) - 64)
            for m in RESTART.finditer(text, at):
                b = m.start()
            if b < at or b == a and at > a:  # none among the last characters: look at all of them
                for m in RESTART.finditer(text, a):
                    b = m.start()
            entry = (text[:a], self._ids(text[a:b]), text[b:])
        self.chunks[chunk] = entry
        self._spend(5 * len(chunk))
        return entry

    def _joint(self, text: str) -> np.ndarray:
        ids = self.joints.get(text)
        if ids is None:
            ids = self._ids(text)
            if len(text) <= 256:
                self.joints[text] = ids
                self._spend(5 * len(text))
        return ids

    def parts(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of the text that the chunks make up, in pieces."""
        out, pending = [], ""
        get = self.chunks.get
        for chunk in chunks:
            head, ids, tail = get(chunk) or self._chunk(chunk)
            if ids is None:
                pending += head
                continue
            out.append(self._joint(pending + head))
            out.append(ids)
            pending = tail
        if pending:
            out.append(self._joint(pending))
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a column of strings."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        base, end = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[base:end] if buffer is not None and end > base else np.empty(0, np.uint8)
        raw = data.tobytes()
        starts = (offsets - base).astype(np.int64)
        cuts = cut_points(data)
        valid = np.asarray(texts.is_valid())
        lengths, pieces = np.zeros(n, np.int64), []
        lo = np.searchsorted(cuts, starts[:-1] + WINDOW)  # a window must not reach into the text before
        hi = np.searchsorted(cuts, starts[1:])
        for i in range(n):
            s, e = int(starts[i]), int(starts[i + 1])
            if s == e or not valid[i]:
                continue
            inner = cuts[lo[i] : hi[i]].tolist() if hi[i] > lo[i] else []
            bounds = [s, *inner, e]
            own = self.parts([raw[a:b] for a, b in zip(bounds, bounds[1:])])
            lengths[i] = sum(map(len, own))
            pieces += own
        return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(pieces) if pieces else np.empty(0, np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker, over all its tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encoded(documents: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(ident, ids) of each document. No shuffle: each task encodes the texts it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            offsets, ids = enc.encode_column(batch.column(1))
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["ident", "ids"])

    kind = documents.schema[ident].dataType.simpleString()
    return parallel(documents.select(ident, text)).mapInArrow(run, f"ident {kind}, ids array<int>").withColumnRenamed("ident", ident)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
