"""Texts cut into chunks that tokenizers treat apart, each distinct chunk known by its bytes.

A cut lies before a space between two characters that can be no white space. There the
pre-tokenizer of a byte-level BPE cuts as well, and no piece of a model whose pieces hold
the mark of a space at their beginning only can reach over it; so the tokens of a text are
those of its chunks, one after another. Chunks are told apart by comparing bytes, never by
a hash alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:0x7F] = True
_AFTER = _BEFORE.copy()
_AFTER[0xC3:] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False  # first bytes of some white space, as C2 is


def cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a chunk, the beginnings of texts apart."""
    cut = np.zeros(len(data), bool)
    if len(data) < 3:
        return cut
    inner = data[1:-1] == 0x20
    inner &= _AFTER[data[2:]]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)  # a letter or sign of two bytes, no white space
    inner &= _BEFORE[data[:-2]] | latin[:-2]
    cut[1:-1] = inner
    return cut


def distinct(data: np.ndarray, start: np.ndarray, end: int) -> tuple[list[bytes], np.ndarray]:
    """The different byte strings that lie between neighbouring starts, and which of them each is."""
    offsets = np.append(start, end)
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = wide.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def equal(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which spans of `a` hold the same bytes as those of `b`."""
    out = a_size == b_size
    some = np.flatnonzero(out & (a_size > 0))
    if len(some):
        size = a_size[some]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()))
        out[some] = ~np.logical_or.reduceat(a[place + np.repeat(a_start[some] - first, size)] != b[place + np.repeat(b_start[some] - first, size)], first)
    return out


class Numbered:
    """Numbers for byte strings, kept from slice to slice until there are `most`.

    A hash finds a string that may be the same, and its bytes decide. A string whose hash another one has
    gets a number that is not kept.
    """

    def __init__(self, most: int):
        self.most, self.count, self.used = most, 0, 0
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint8)

    def full(self) -> bool:
        return self.count >= self.most

    def of(self, data: np.ndarray, start: np.ndarray, end: int) -> tuple[np.ndarray, list[bytes]]:
        """The number of each string, and the strings that are new, in order of their numbers."""
        from thermoline.llm.textkit import Words

        stop = np.append(start[1:], end)
        size = stop - start
        h = Words(data, np.array([0, len(data)]), split=False).span_hash(start, stop)
        hashes, where, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = place < len(self.hash)
        hit[inside] = self.hash[place[inside]] == hashes[inside]
        kept = self.number[place[hit]]
        same = hit.copy()
        same[hit] = equal(data, start[where[hit]], size[where[hit]], self.store, self.start[place[hit]], self.size[place[hit]])
        number = np.empty(len(hashes), np.int64)
        number[same] = kept[same[hit]]
        fresh = np.flatnonzero(~same)
        number[fresh] = self.count + np.arange(len(fresh))
        raw = data.tobytes()
        new = [raw[s:e] for s, e in zip(start[where[fresh]].tolist(), stop[where[fresh]].tolist(), strict=True)]
        out = number[back]
        # Strings of one hash in this slice that aren't the first of them.
        others = np.flatnonzero(where[back] != np.arange(len(start)))
        odd = others[~equal(data, start[others], size[others], data, start[where[back[others]]], size[where[back[others]]])]
        told: dict[bytes, int] = {}
        for k in odd.tolist():
            out[k] = told.setdefault(raw[start[k] : stop[k]], self.count + len(new) + len(told))
        new += list(told)
        self.count += len(new)
        self._keep(data, hashes[~hit], start[where[~hit]], size[where[~hit]], number[~hit])
        return out, new

    def _keep(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        used, ends = self.used + int(size.sum()), np.cumsum(size)
        if used > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(2 * used - self.used, np.uint8)])
        self.store[self.used : used] = data[np.arange(used - self.used) + np.repeat(start - (ends - size), size)]
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.number, self.start, self.size = (np.insert(x, at, y) for x, y in ((self.hash, hashes), (self.number, number), (self.start, self.used + ends - size), (self.size, size)))
        self.used = used


class Lists:
    """Lists of numbers, one after another, that grow."""

    def __init__(self, dtype: type = np.int32):
        self.first, self.size, self.values, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, dtype), 0, 0

    def add(self, size: np.ndarray, values: np.ndarray) -> None:
        n, used = self.n + len(size), self.used + len(values)
        if n > len(self.first):
            self.first, self.size = (np.concatenate([x[: self.n], np.zeros(2 * n - self.n, np.int64)]) for x in (self.first, self.size))
        if used > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(2 * used - self.used, self.values.dtype)])
        self.first[self.n : n], self.size[self.n : n] = self.used + np.cumsum(size) - size, size
        self.values[self.used : used] = values
        self.n, self.used = n, used

    def take(self, which: np.ndarray) -> np.ndarray:
        """The values of these lists, one after another."""
        size = self.size[which]
        ends = np.cumsum(size)
        return self.values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[which] - (ends - size), size)]


def _between_cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which chunks begin and end as one does that has a cut at both ends."""
    long = end - start > 1
    first, second, tail, last = data[start], data[np.minimum(start + 1, len(data) - 1)], data[np.maximum(end - 2, 0)], data[end - 1]
    return long & (first == 0x20) & _AFTER[second] & (_BEFORE[last] | (tail == 0xC3))


class BytePairs:
    """A byte-level BPE file of the tokenizers library, over chunks."""

    def __init__(self, path: str, plain_special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        special = {k for k, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token.encode()) if k in special else len(token)  # a character of a token is a byte of text

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids in order. Chunks that cuts can part are encoded together."""
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(length)
        parted = _between_cuts(np.frombuffer(b"".join(chunks), np.uint8), ends - length, ends)
        order = np.concatenate([np.flatnonzero(parted), np.flatnonzero(~parted)])
        size, parts, joined = np.zeros(len(chunks), np.int64), [], int(parted.sum())
        for at in range(0, joined, 20_000):
            some = order[at : min(at + 20_000, joined)]
            text = b"".join([chunks[k] for k in some.tolist()]).decode()
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            covered, wanted = np.cumsum(self.bytes_of[got]), np.cumsum(length[some])
            if len(covered) == 0 or covered[-1] != wanted[-1]:
                raise ValueError("ids don't cover the text")
            size[some] = np.diff(np.searchsorted(covered, wanted, "left") + 1, prepend=0)
            parts.append(got)
        for at in range(joined, len(order), 1000):
            some = order[at : at + 1000].tolist()
            for k, got in zip(some, self.tokenizer.encode_batch_fast([chunks[k].decode() for k in some], add_special_tokens=False), strict=True):
                size[k] = len(got.ids)
                parts.append(np.array(got.ids, np.int32))
        ids = np.concatenate(parts)
        first = np.empty(len(chunks), np.int64)  # of each chunk's ids, which lie in the order of encoding
        first[order] = np.cumsum(size[order]) - size[order]
        done = np.cumsum(size)
        return size, ids[np.arange(len(ids)) + np.repeat(first - (done - size), size)]
