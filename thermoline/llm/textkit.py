"""Numpy kernels over the UTF-8 bytes of an Arrow column of texts.

A batch of texts is one byte array plus offsets, so splitting, hashing and counting
run once over the whole batch instead of once a word. Words and lines are told apart by
their bytes within a batch and by 64 bits of a cryptographic digest beyond it; windows of
up to some ten words are polynomials over these digests. `span_hash` is a polynomial over
bytes modulo 2**64 and serves hashed features alone: there are long strings that it can't
tell apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from thermoline.llm import chunks

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
BYTE_VALUE = np.random.default_rng(20240611).integers(1, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: The white space of the word rule, as bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that a kernel takes at a time, unless one text is longer.
SLICE_BYTES = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and their inverses."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(n, base, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text is alone."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, done + most, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(end[to - 1])


_digests: dict[bytes, int] = {}
#: Digests that a worker keeps, about 200 bytes each.
DIGESTS_KEPT = 100_000


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"thermoline").digest(), "little")


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the digest of each span; spans are in order and don't meet. Each different string is digested once."""
    if not len(start):
        return np.zeros(0, U64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1  # a span may begin where another ends
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    ends = np.cumsum(end - start)
    strings, which = chunks.distinct(data[inside], ends - (end - start), int(ends[-1]))
    if len(_digests) > DIGESTS_KEPT:
        _digests.clear()
    out = np.empty(len(strings), U64)
    for k, raw in enumerate(strings):
        h = _digests.get(raw)
        if h is None:
            h = _digest(raw)
            if len(raw) <= 64:
                _digests[raw] = h
        out[k] = h
    return out[which]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts, in order."""

    def __init__(self, data: np.ndarray, off: np.ndarray, split: bool = True):
        self.data, self.off, self.docs = data, off, len(off) - 1
        self._sums: np.ndarray | None = None
        if not split:
            return
        n = len(data)
        word = ~SPACE[data]
        before = np.zeros(n + 1, bool)
        before[1:] = word
        before[off] = False
        after = np.zeros(n + 1, bool)
        after[:n] = word
        after[off] = False
        self.start = np.flatnonzero(word & ~before[:n])
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.docs)

    def sums(self) -> np.ndarray:
        if self._sums is None:
            x = BYTE_VALUE[self.data]
            x *= powers(len(self.data) + 1)[0][:-1]
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(x, out=self._sums[1:])
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start to end, for features."""
        s = self.sums()
        h = (s[end] - s[start]) * powers(len(self.data) + 1)[1][start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return digests(self.data, self.start, self.end)


def window_hash(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring values, at all places, and which of these stay inside one text."""
    m = max(0, len(h) - n + 1)
    pw, inverse = powers(len(h) + 1)
    s = np.zeros(len(h) + 1, U64)
    np.cumsum(h * pw[: len(h)], out=s[1:])
    out = mix((s[n : n + m] - s[:m]) * inverse[:m] + U64(n))
    return out, doc[:m] == doc[n - 1 : n - 1 + m]


def per_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return mix(key + doc.astype(U64) * U64(0xA0761D6478BD642F))


def code_points(data: np.ndarray) -> np.ndarray:
    """At each byte, the characters that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
