"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A CGK walk reads a string left to right; at step j it writes the current character and a
random bit, fixed for step and character, says whether it moves on. Two strings a few edits
apart fall back into step soon after each edit, so edit distance becomes Hamming distance.
A repetition draws a walk and samples some of its coordinates; equal samples are a hit.

Windows as long as the items open at every word of a document, and of an item, and at every
other pair of characters or so where text has no spaces, chosen by the pair itself and so
alike in a copy and its item. The sampled coordinates are among the first STEPS of a window:
farther ones are out of step at EDIT_PERCENT, and the windows that open later cover them.
Windows whose sample so far begins no item's sample are dropped in mid-walk, which loses none.

Repetitions are added until, on copies of items with the full number of random edits, set
between other text and verified, the target recall is reached in each group: quarters by
length of the items with spaces and of those without. A group that MOST_REPETITIONS don't
bring there is found by pieces instead, exactly: an item is cut into one piece more than its
edits, of which one is free of edits in any copy. So are items too short for walks. Every
candidate is verified by an exact edit distance of the whole item, in characters; one edit
rule holds for all lengths, and short items must also stand between word bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk

#: Edits for each 100 characters of an item that still make a copy.
EDIT_PERCENT = 10
STEPS, SAMPLED = 44, 22
CHECKPOINTS = (10, 20, 32)
TARGET_RECALL, MOST_REPETITIONS, PROBES = 0.99, 12, 200
GRAM_BITS = 10
GRAMS = 1 << GRAM_BITS
#: Items with fewer characters have no room for walks: they are found by pieces and matched between word bounds.
SHORT = 48
#: Bytes of items that one pass over the documents holds in memory.
BLOCK_BYTES = 4 << 20
#: Characters of a run without spaces after which windows open inside it; scripts from this code point on need no such run.
LONG_RUN, UNSPACED = 16, 0x0E00

_U = np.uint64
_PLANE = 1 << 16
_FOLD = np.arange(_PLANE, dtype=np.uint32)
_WORD = np.zeros(_PLANE, bool)
for _c in range(_PLANE):
    _x = chr(_c)
    if _x.isspace():
        _FOLD[_c] = 32
    elif len(_x.lower()) == 1:
        _FOLD[_c] = ord(_x.lower())
    _WORD[_c] = (_x.isalnum() and _c < UNSPACED) or _x == "_"


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = tk.utf8(column)
    try:
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), tk.code_points(data)[off]
    except UnicodeDecodeError:
        texts = [data[s:e].tobytes().decode(errors="replace") for s, e in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case characters, one space for each run of white space, a space after each text; and where texts begin."""
    data, off = _code_points(column)
    docs = len(off) - 1
    data = np.where(data < _PLANE, _FOLD[np.minimum(data, _PLANE - 1)], data)
    out = np.full(len(data) + docs, 32, np.uint32)
    out[np.arange(len(data)) + np.repeat(np.arange(docs), np.diff(off))] = data
    off = off + np.arange(docs + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[off[:-1]] = True
    sums = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return out[keep], sums[off]


def symbols(data: np.ndarray) -> np.ndarray:
    """Characters in the walks' alphabet of 256; verification tells apart those that share a symbol."""
    return np.where(data < 256, data, data * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)


def window_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where windows open: at words, and by the pair of characters in long runs and scripts without spaces."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = data == 32
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    place = np.arange(len(data), dtype=np.int32)
    deep = place - np.maximum.accumulate(np.where(first, place, 0)) >= LONG_RUN
    deep |= data >= UNSPACED
    at = np.flatnonzero(deep & ~space)
    pair = data[at] * np.uint32(2654435761) + data[np.minimum(at + 1, len(data) - 1)] * np.uint32(2246822519)
    first[at[(pair ^ pair >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(31) == 0]] = True
    return np.flatnonzero(first & ~space)


def edit_distance(item: bytes | list[int], text: bytes | list[int]) -> int:
    """Least number of edits between the whole item and any part of the text: Myers' bit-parallel columns."""
    m = len(item)
    if not m:
        return 0
    where: dict[int, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        diag = ((((x & up) + up) ^ up) | x) & full
        h_up = down | (full & ~(diag | up))
        h_down = up & diag
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full  # a match may begin anywhere, so the first row stays 0
        h_down = h_down << 1 & full
        up = h_down | (full & ~(diag | h_up))
        down = h_up & diag
        best = min(best, score)
    return best


def bounds(text: np.ndarray) -> np.ndarray:
    """Places of a plain text, its end too, that don't lie inside a word; characters of scripts without spaces are words each."""
    word = (text < _PLANE) & _WORD[np.minimum(text, _PLANE - 1)]
    out = np.ones(len(text) + 1, bool)
    out[1:-1] = ~(word[1:] & word[:-1])
    return out


def bounded_distance(item: list[int], text: list[int], free: np.ndarray) -> int:
    """Least number of edits between the whole item and a part of the text between two of the free places.

    Nothing is added before the item's first or after its last character: a longer word is another word.
    """
    far = len(item) + len(text)
    row = np.where(free, 0, far).tolist()
    for a in item:
        inner = [x + 1 for x in row]  # the character is missing
        for j, b in enumerate(text):
            inner[j + 1] = min(inner[j + 1], row[j] + (a != b))
        last, row = inner, inner.copy()
        for j in range(len(text)):
            row[j + 1] = min(row[j + 1], row[j] + 1)
    return min((x for x, ok in zip(last, free, strict=True) if ok), default=far)


@dataclass
class Walk:
    """One repetition: the moves of each step and character, and the sampled steps."""

    moves: np.ndarray
    sampled: np.ndarray
    salt: np.uint64

    @classmethod
    def drawn(cls, seed: int) -> Walk:
        rng = np.random.default_rng([20240917, seed])
        sampled = np.zeros(STEPS, bool)
        sampled[rng.choice(STEPS, SAMPLED, replace=False)] = True
        return cls(rng.integers(0, 2, (STEPS, 256), dtype=np.int32), sampled, _U(rng.integers(1, 2**62) * 2 + 1))

    def keys(self, text: np.ndarray, starts: np.ndarray, wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Windows of a text in symbols that are left, their keys, the keys at each checkpoint and how far each walk came."""
        live, at, key, seen = np.arange(len(starts)), starts.astype(np.int32), np.zeros(len(starts), _U), []
        for j in range(STEPS):
            c = text.take(at, mode="clip")
            if self.sampled[j]:
                key *= self.salt
                key += c
            at += self.moves[j].take(c)
            if j + 1 in CHECKPOINTS:
                seen.append(key.copy() if wanted is None else key)
                if wanted is not None:
                    table = wanted[len(seen) - 1]
                    good = np.flatnonzero(table.take(_slot(key, len(table))))
                    live, at, key = live[good], at[good], key[good]
        return live, key, seen, at


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """A place in a table whose size is a power of 2."""
    return ((key * _U(0x9E3779B97F4A7C15)) >> _U(65 - size.bit_length())).astype(np.int64)


def _table(key: np.ndarray, size: int) -> np.ndarray:
    table = np.zeros(size, bool)
    table[_slot(key, size)] = True
    return table


class Index:
    """The items' windows under each walk, and the pieces of those that walks can't find.

    Built once, on the driver, and sent to the tasks without its tables, which are made again there.
    `recalls` says for each group of items whether they have spaces, their lengths, the recall
    measured and the number of copies it was measured on.
    """

    def __init__(self, items: list[tuple[int | None, str]], percent: int = EDIT_PERCENT, target: float = TARGET_RECALL):
        data, off = plain(pa.array([t for _, t in items], pa.string()))
        self.ids, self.raw = [i for i, _ in items], [data[s:e][: -1 if e - s > 1 and data[e - 1] == 32 else None] for s, e in zip(off[:-1], off[1:], strict=True)]
        self.raw = [r[1:] if len(r) and r[0] == 32 else r for r in self.raw]
        self.edits = np.array([len(r) * percent // 100 for r in self.raw], np.int64)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        begin = np.cumsum([0, *(self.size + 1)])
        joined = np.full(int(begin[-1]), 32, np.uint32)
        for r, s in zip(self.raw, begin, strict=False):
            joined[s : s + len(r)] = r
        place = window_starts(joined, begin)
        item = np.searchsorted(begin, place, "right") - 1
        long = self.size[item] >= SHORT
        self.item, self.at = item[long], (place - begin[item])[long]
        self.walks: list[tuple[Walk, list[np.ndarray], np.ndarray, np.ndarray]] = []
        self.wanted: list[list[np.ndarray]] = []
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.recalls: list[tuple[bool, int, int, float, int]] = []
        self.grams = np.array([np.minimum(np.bincount(self._gram(r), minlength=GRAMS), 255) for r in self.raw], np.uint8).reshape(-1, GRAMS)
        groups = self._groups()
        probes = [self._probes(g, np.random.default_rng([11, n])) for n, g in enumerate(groups)]
        missed = [np.arange(len(p)) for p in probes]
        reached, enough = [0.0] * len(groups), [MOST_REPETITIONS] * len(groups)
        while groups and min(reached) < target and len(self.walks) < MOST_REPETITIONS:
            self._add(Walk.drawn(len(self.walks)), joined, place[long], begin[1:][self.item])
            for g, (copies, left) in enumerate(zip(probes, missed, strict=True)):
                if len(left):
                    data = np.concatenate([copies[x][1] for x in left])
                    off = np.cumsum([0, *(len(copies[x][1]) for x in left)])
                    own = np.array([copies[x][0] for x in left])
                    found = self._judged(data, off, (rows[own[rows[:, 0]] == rows[:, 1]] for rows in self._walked(data, off, [len(self.walks) - 1])))
                    missed[g] = np.array([x for x, got in zip(left, found, strict=True) if copies[x][0] not in got], int)
                reached[g] = 1 - len(missed[g]) / len(copies)
                enough[g] = min(enough[g], len(self.walks)) if reached[g] >= target else MOST_REPETITIONS
        for g, r in zip(groups, reached, strict=True):
            self.recalls.append((self._spaced(g[0]), int(self.size[g[0]]), int(self.size[g[-1]]), r if r >= target else 1.0, PROBES if r >= target else 0))
        weak = [k for g, r in zip(groups, reached, strict=True) if r < target for k in g]
        if weak:  # their windows go, and so do the repetitions that only they had
            self._keep(~np.isin(self.item, weak), max((n for n, r in zip(enough, reached, strict=True) if r >= target), default=0))
        self._cut([k for k, r in enumerate(self.raw) if 0 < len(r) < SHORT] + weak)

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "wanted"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.wanted = [[_table(x, self._slots()) for x in seen] for _, seen, _, _ in self.walks]

    def _slots(self) -> int:
        return 1 << min(25, max(20, (32 * len(self.item)).bit_length()))

    def _spaced(self, k: int) -> bool:
        return bool((self.raw[k] == 32).sum() * LONG_RUN >= self.size[k])

    def _groups(self) -> list[list[int]]:
        """Quarters by length of the long items with spaces and of those without."""
        long = sorted(np.flatnonzero(self.size >= SHORT).tolist(), key=lambda k: (self.size[k], k))
        return [q.tolist() for spaced in (True, False) for q in np.array_split([k for k in long if self._spaced(k) == spaced], 4) if len(q)]

    def _probes(self, group: list[int], rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
        """Copies of items from all over a group with as many random edits as are allowed, between parts of other items."""
        out = []
        for n in range(PROBES):
            k = group[n * len(group) // PROBES] if len(group) > PROBES else group[n % len(group)]
            text, gap = self.raw[k].tolist(), [32] * self._spaced(k)
            for _ in range(self.edits[k]):
                at, c = int(rng.integers(len(text))), int(rng.choice(self.raw[k]))
                kind = rng.integers(3)
                if kind == 0:
                    text[at] = c
                elif kind == 1:
                    text.insert(at, c)
                else:
                    del text[at]
            before, after = (self.raw[group[int(rng.integers(len(group)))]][int(rng.integers(SHORT)) :][:60].tolist() for _ in range(2))
            out.append((k, np.array([*before, *gap, *text, *gap, *after, 32], np.uint32)))
        return out

    def _add(self, walk: Walk, joined: np.ndarray, place: np.ndarray, limit: np.ndarray) -> None:
        _, key, seen, end = walk.keys(symbols(joined), place)
        window = np.flatnonzero(end < limit)
        key, seen = key[window], [np.unique(x[window]) for x in seen]
        order = np.argsort(key, kind="stable")
        self.walks.append((walk, seen, key[order], window[order]))
        self.wanted.append([_table(x, self._slots()) for x in seen])

    def _keep(self, window: np.ndarray, repetitions: int) -> None:
        self.walks = [(walk, seen, key[window[which]], which[window[which]]) for walk, seen, key, which in self.walks[:repetitions]]
        self.wanted = self.wanted[:repetitions]

    def _cut(self, exact: list[int]) -> None:
        """Hashes, items and places of the pieces, by length."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k in exact:
            raw, n = self.raw[k], int(self.edits[k]) + 1
            edge = [len(raw) * x // n for x in range(n + 1)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                rows.setdefault(e - s, []).append((int(tk.window_hash(tk.mix(raw[s:e].astype(_U)), np.zeros(e - s, np.int64), e - s)[0][0]), k, s))
        for n, got in rows.items():
            got.sort()
            self.pieces[n] = (np.array([x for x, _, _ in got], _U), np.array([k for _, k, _ in got]), np.array([s for _, _, s in got]))

    @staticmethod
    def _gram(text: np.ndarray) -> np.ndarray:
        """Counter of each three neighbouring characters."""
        return ((text[:-2] * np.uint32(2654435761) + text[1:-1]) * np.uint32(2246822519) + text[2:] * np.uint32(3266489917) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)

    def _expanded(self, off: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (text, item, bucket of the item's begin), each once, of hits whose items are rows low to high."""
        n = high - low
        turn = np.cumsum(n) >> 20  # a million pairs at a time
        for t in np.unique(turn[n > 0]):
            some = np.flatnonzero((turn == t) & (n > 0))
            which = np.repeat(low[some], n[some]) + np.arange(int(n[some].sum())) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            where, k = np.repeat(place[some], n[some]), item[which]
            bucket = (where - at[which]) // (2 * self.edits[k] + 1)
            least, many = int(bucket.min()), int(np.ptp(bucket)) + 1
            packed = np.unique(((np.searchsorted(off, where, "right") - 1) * len(self.raw) + k) * many + bucket - least)
            yield np.stack([packed // many // len(self.raw), packed // many % len(self.raw), packed % many + least], axis=1)

    def _walked(self, data: np.ndarray, off: np.ndarray, walks: list[int]) -> Iterator[np.ndarray]:
        starts, text = window_starts(data, off), symbols(data)
        for x in walks:
            walk, _, keys, window = self.walks[x]
            for s in range(0, len(starts), 1 << 15):
                some = starts[s : s + (1 << 15)]
                live, key, _, _ = walk.keys(text, some, self.wanted[x])
                yield from self._expanded(off, some[live], np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right"), self.item[window], self.at[window])

    def _pieced(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        if not self.pieces or not len(data):
            return
        h, doc = tk.mix(data.astype(_U)), np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n, (keys, item, at) in self.pieces.items():
            key, inside = tk.window_hash(h, doc, n)
            place = np.flatnonzero(inside)
            low = np.searchsorted(keys, key[place], "left")
            place, low = (x[keys.take(low, mode="clip") == key[place]] for x in (place, low))
            yield from self._expanded(off, place, low, np.searchsorted(keys, key[place], "right"), item, at)

    def _likely(self, data: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The candidates whose item has its 3-grams about there: an edit changes at most three of them.

        Candidates of a text that begin near one another share one count.
        """
        if not len(rows):
            return rows
        slack = 2 * self.edits[rows[:, 1]] + 1
        low = np.maximum(off[rows[:, 0]], rows[:, 2] * slack - self.edits[rows[:, 1]])
        high = np.minimum(off[rows[:, 0] + 1], (rows[:, 2] + 1) * slack + self.size[rows[:, 1]] + 2 * self.edits[rows[:, 1]])
        order = np.lexsort((high - low, low >> 6, rows[:, 0]))
        rows, low, high = rows[order], low[order], high[order]
        group = np.flatnonzero(np.diff(rows[:, 0], prepend=-1) | np.diff(low >> 6, prepend=-1) | np.diff(np.arange(len(rows)) >> 10, prepend=0))
        good = np.ones(len(rows), bool)
        for s, e in zip(group, [*group[1:], len(rows)], strict=True):
            here = np.minimum(np.bincount(self._gram(data[low[s:e].min() : high[s:e].max()]), minlength=GRAMS), 255).astype(np.int16)
            good[s:e] = np.maximum(self.grams[rows[s:e, 1]] - here, 0).sum(axis=1) <= 3 * self.edits[rows[s:e, 1]]
        return rows[good]

    def _judged(self, data: np.ndarray, off: np.ndarray, candidates: Iterator[np.ndarray]) -> list[dict[int, int]]:
        """For each text, the items that stand where a candidate says, and the least number of edits."""
        found: list[dict[int, int]] = [{} for _ in range(len(off) - 1)]
        tried: set[tuple[int, int, int]] = set()
        for rows in candidates:
            for d, k, bucket in self._likely(data, off, rows).tolist():
                if (d, k, bucket) in tried or found[d].get(k) == 0:
                    continue
                tried.add((d, k, bucket))
                edits = int(self.edits[k])
                slack, begin, end = 2 * edits + 1, int(off[d]), int(off[d + 1])
                low, high = max(begin, bucket * slack - edits), min(end, (bucket + 1) * slack + int(self.size[k]) + 2 * edits)
                item, text = self.raw[k].tolist(), data[low:high].tolist()
                n = edit_distance(item, text)
                if n <= edits and len(item) < SHORT:
                    n = bounded_distance(item, text, bounds(data[max(begin, low - 1) : high + 1])[min(1, low - begin) :][: len(text) + 1])
                if n <= edits:
                    found[d][k] = min(n, found[d].get(k, n))
        return found

    def matches(self, column: pa.Array) -> list[dict[int, int]]:
        """For each text, the items that it holds and the least number of edits."""
        data, off = plain(column)

        def candidates() -> Iterator[np.ndarray]:
            yield from self._walked(data, off, list(range(len(self.walks))))
            yield from self._pieced(data, off)

        return self._judged(data, off, candidates())


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, percent: int, target: float, block_bytes: int) -> Iterator[Broadcast]:
    """The items' indexes, at most `block_bytes` of items in each; equal texts of one id once. An item without an id goes by a digest of its text."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct().orderBy("id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if size and size + len(r["text"]) > block_bytes:
            yield benchmark.sparkSession.sparkContext.broadcast(Index(block, percent, target))
            block, size = [], 0
        block.append((r["id"] if r["id"] is not None else hashlib.sha256(r["text"].encode()).hexdigest(), r["text"]))
        size += len(r["text"])
    if block:
        yield benchmark.sparkSession.sparkContext.broadcast(Index(block, percent, target))


#: What a pass over the documents carries: items with an id and those without, and their edits.
_HELD = {"item_ids": pa.int64(), "edits": pa.int32(), "unnamed_items": pa.string(), "unnamed_edits": pa.int32()}


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = EDIT_PERCENT, target: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: the items it holds, in order of id, and their edits.

    Case and the length of white space don't count. Null and empty texts hold nothing; null
    and blank items are held by nothing; items that share an id are one, with the least of
    their edits; those without an id are told by the SHA-256 of their texts, in columns of their own; repeated rows are judged each; an empty table of
    documents gives no rows, of items no hits; other columns, whatever their names, aren't
    looked at. A text longer than a slice is a slice of its own, about 60 bytes of memory for
    each of its characters. The benchmark passes through the driver, `block_bytes` at a time:
    each block is one index, broadcast, and one step along the same pass over the documents.
    No shuffle: a document never meets another.
    """
    kinds = {"item_ids": "array<long>", "edits": "array<int>", "unnamed_items": "array<string>", "unnamed_edits": "array<int>"}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.array().cast(kind).alias(c) for c, kind in kinds.items()))
    for index in _indexes(benchmark, item_col, "text", percent, target, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.slices(batch, "text", 1 << 20):
                    held = {c: [] for c in _HELD}
                    for *old, got in zip(*(part.column(c).to_pylist() for c in _HELD), index.value.matches(part.column("text")), strict=True):
                        best = dict(zip(old[0] + old[2], old[1] + old[3], strict=True))
                        for k, x in got.items():
                            best[index.value.ids[k]] = min(x, best.get(index.value.ids[k], x))
                        for (names, edits), kind in ((("item_ids", "edits"), int), (("unnamed_items", "unnamed_edits"), str)):
                            held[names].append(sorted(i for i in best if isinstance(i, kind)))
                            held[edits].append([best[i] for i in held[names][-1]])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *(pa.array(held[c], pa.list_(kind)) for c, kind in _HELD.items())], ["doc_id", "text", *_HELD])

        rows = rows.mapInArrow(scan, "doc_id long, text string, " + ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    return rows.select("doc_id", (F.size("item_ids") + F.size("unnamed_items")).cast("long").alias("n_items"), "item_ids", "edits", "unnamed_items", "unnamed_edits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", percent: int = EDIT_PERCENT, target: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item, be it with or without an id.

    Null and empty texts stay; repeated rows stay or go alike; empty tables and long texts as above.
    """
    for index in _indexes(benchmark, item_col, "text", percent, target, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.slices(batch, text_col, 1 << 20):
                    yield part.filter(pa.array([not x for x in index.value.matches(part.column(text_col))], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
