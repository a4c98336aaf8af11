"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations are the paths of its lattice of pieces, each with the product of its
pieces' probabilities. Perturbed A* search draws k different ones: the perturbed value of a
set of paths - the largest of their log probabilities plus Gumbel noise - is known from the
set's total probability without looking into it. The agenda starts with all paths; the best
entry is opened by walking down its lattice, each step by its exact conditional probability,
and leaves at every step one entry, all paths that turn off there, whose value is a Gumbel
draw cut off at the opened one's. The next best entry is opened next, and no path comes twice.
The value that is best after k paths is the threshold, and 1 - exp(-exp(log p - threshold))
is the probability with which a path is included.

No piece spans the place where a word ends and a space begins, so a text's lattice is a
chain of its words' lattices. Each distinct word of a slice gets one, built and summed in
numpy; a text's paths walk through shared tables. All draws are hashes of the row key, the
sample and the place, so a result depends neither on partitions nor on neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import chunks
from thermoline.llm import textkit as tk

SAMPLES = 2
#: Bytes of text that share one table of lattices: words repeat, but a table takes some hundred times as much.
SLICE_BYTES = 2 << 20
#: A piece of rank r has a weight of (r + RANK_SHIFT) ** -SHARPNESS, a byte that of the last rank.
RANK_SHIFT, SHARPNESS = 50.0, 1.5
#: More than Gumbel noise from numbers of 53 bits can be; steps of a path whose entries are drawn first.
MOST_NOISE, NEAR = 38.0, 64
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids array<int>"
_U = np.uint64


#: Bytes of the character that a byte begins.
_CHAR_BYTES = np.ones(256, np.uint8)
_CHAR_BYTES[0xC0:], _CHAR_BYTES[0xE0:], _CHAR_BYTES[0xF0:] = 2, 3, 4


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    h = np.zeros(1, _U)
    for p in parts:
        h = tk.mix(h * _U(0x9E3779B97F4A7C15) + np.asarray(p).astype(_U) + _U(0x632BE59BD9B4E019))
    return h


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1 from the hash of the parts."""
    return _share(_hashed(*parts))


def _share(h: np.ndarray) -> np.ndarray:
    """Bits as a number between 0 and 1."""
    return ((h >> _U(11)).astype(float) + 0.5) * 2.0**-53


def _stream(seed: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1 for the turns of a seed that is a hash itself."""
    h = seed + np.asarray(turn).astype(_U) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    return _share(h)


class _Table:
    """Hashes with a value each, found by address: the second address holds those whose first is taken."""

    SHIFTS = ((0x9E3779B97F4A7C15, 46), (0xD6E8FEB86659FD93, 46))

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values.astype(np.int32)
        self.slots, left = [], np.arange(len(hashes))
        for times, shift in self.SHIFTS:
            slot = np.zeros(1 << (64 - shift), np.int32)
            at = self._address(hashes[left], times, shift)
            slot[at] = left
            self.slots.append(slot)
            left = left[slot[at] != left]
        self.rest = {int(hashes[k]): int(values[k]) for k in left}

    @staticmethod
    def _address(h: np.ndarray, times: int, shift: int) -> np.ndarray:
        return ((h * _U(times)) >> _U(shift)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are there, and the values of those."""
        at = self.slots[0][self._address(h, *self.SHIFTS[0])]
        good = self.hashes[at] == h
        miss = np.flatnonzero(~good)
        other = self.slots[1][self._address(h[miss], *self.SHIFTS[1])]
        hit = self.hashes[other] == h[miss]
        at[miss[hit]], good[miss[hit]] = other[hit], True
        value = self.values[at]
        for k, v in self.rest.items():
            same = h == _U(k)
            value[same], good[same] = v, True
        return good, value[good]


class Pieces:
    """A SentencePiece model's pieces by their bytes, a space standing for the word mark."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.raw = [b""] * n
        self.byte_id = np.full(256, -1)
        by_size: dict[int, dict[bytes, int]] = {}
        rank = 0
        self.log_weight = np.zeros(n)
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.raw[k] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("a piece spans words")
                self.raw[k] = piece.replace("▁", " ").encode()
                by_size.setdefault(len(self.raw[k]), {}).setdefault(self.raw[k], k)
                self.log_weight[k] = -SHARPNESS * np.log(rank + RANK_SHIFT)
                rank += 1
        if (self.byte_id < 0).any():
            raise ValueError("the model has no bytes to fall back on")
        self.log_weight[self.byte_id] = -SHARPNESS * np.log(rank + RANK_SHIFT)
        self.size = np.array([len(r) for r in self.raw])
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self.longest = max(by_size)
        #: By length: hashes of all beginnings, and the piece that each is, or -1.
        self.tables = []
        for m in range(1, self.longest + 1):
            begins = {p[:m]: -1 for size, own in by_size.items() if size >= m for p in own}
            begins |= by_size.get(m, {})
            joined = np.frombuffer(b"".join(begins), np.uint8).reshape(-1, m)
            h = np.zeros(len(begins), _U)
            for k in range(m):
                h += self.turn(joined[:, k], k)
            self.tables.append(_Table(h, np.array(list(begins.values()))))
        #: The first two lengths by their bytes: whether any piece begins so, and the piece.
        self.short = [(np.zeros(256**m, bool), np.full(256**m, -1)) for m in (1, 2)]
        for p in (p for own in by_size.values() for p in own):
            for m, (begin, piece) in enumerate(self.short, 1):
                if len(p) >= m:
                    begin[int.from_bytes(p[:m], "big")] = True
                    if len(p) == m:
                        piece[int.from_bytes(p, "big")] = by_size[m][p]

    @staticmethod
    def turn(byte: np.ndarray, k: int) -> np.ndarray:
        """What the k-th byte of a string adds to its hash."""
        return tk.BYTE_VALUE[byte] * tk.powers(k + 1)[0][k]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists one after another, each with its leading word mark, and the bytes of each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        take = np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(self.first[ids], size)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], ends])
        return self.bytes[take], total[bounds[1:]] - total[bounds[:-1]]


_models: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Lattices:
    """The lattices of a slice's distinct words, as one table of states and arcs in descending nearness to the word's end."""

    def __init__(self, model: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        # Words in descending length: the states with a given number of bytes left are then one
        # run, and word w's is the w-th of it, so a state's number needs no search.
        by_length = np.argsort(start - end, kind="stable")
        stop, span = end[by_length].astype(np.int32), (end - start)[by_length]
        longest = int(span[0]) if len(span) else 0
        width = np.searchsorted(-span, -np.arange(1, longest + 1), "right").astype(np.int32)  # words with so many bytes or more
        level = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        total = int(level[-1])
        left = np.repeat(np.arange(1, longest + 1, dtype=np.int32), width)
        word = np.arange(total, dtype=np.int32) - np.repeat(level[:-1], width)
        where = stop[word] - left
        lead = data[where]
        char = (lead & 0xC0) != 0x80
        sizes = _CHAR_BYTES[lead]
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        own = np.zeros(total, bool)
        alive = np.flatnonzero(char).astype(np.int32)
        h = np.zeros(len(alive), _U)
        for m, table in enumerate(model.tables, 1):
            if m > 1:
                enough = left[alive] >= m
                alive, h = alive[enough], h[enough]
            if not len(alive):
                break
            byte = data[where[alive] + (m - 1)]
            h += model.turn(byte, m - 1)
            if m <= 2:
                code = byte.astype(np.int32) if m == 1 else lead[alive].astype(np.int32) << 8 | byte
                begins, pieces = model.short[m - 1]
                good = begins[code]
                alive, h, piece = alive[good], h[good], pieces[code[good]]
            else:
                good, piece = table.find(h)
                alive, h = alive[good], h[good]
            hit = piece >= 0
            found.append((alive[hit], m, piece[hit]))
            own[alive[hit & (sizes[alive] == m)]] = True
        # A character that is no piece is spelled by its bytes; their states lie below one another.
        lacking = np.flatnonzero(char & ~own).astype(np.int32)
        for k in range(4):
            some = lacking[sizes[lacking] > k]
            some = level[left[some] - k - 1] + word[some]
            found.append((some, 1, model.byte_id[data[where[some]]]))

        count = np.zeros(total + 1, np.int32)
        for at, _, _ in found:
            count[at] += 1
        self.first = np.zeros(total + 2, np.int32)
        np.cumsum(count, out=self.first[1:])
        arcs = int(self.first[total])
        self.to, self.piece = np.empty(arcs, np.int32), np.empty(arcs, np.int32)
        filled = self.first[:-1].copy()
        ends = np.concatenate([[total], level[:-1]]).astype(np.int32)  # first state with so many bytes left; none left is the end
        for at, m, piece in reversed(found):  # longest pieces first
            slot = filled[at]
            filled[at] += 1
            after = left[at] - m
            self.to[slot], self.piece[slot] = ends[after] + np.where(after > 0, word[at], 0), piece
        self.end = total
        self.begin = np.empty(len(span), np.int32)
        self.begin[by_length] = ends[span] + np.arange(len(span), dtype=np.int32)

        beta = np.full(total + 1, -np.inf)
        beta[total] = 0.0
        self.log_p, self.p = model.log_weight[self.piece], np.empty(arcs)
        for d in range(longest):
            s, e = int(level[d]), int(level[d + 1])
            a, b = int(self.first[s]), int(self.first[e])
            if b == a:
                continue
            has = np.flatnonzero(count[s:e])
            at, each = self.first[s:e][has] - a, count[s:e][has]
            x = self.log_p[a:b]
            x += beta[self.to[a:b]]
            x -= np.repeat(np.maximum.reduceat(x, at), each)
            top = self.log_p[a:b][at]  # what each state's first arc has left, to find its largest again
            p = np.exp(x)
            sums = np.add.reduceat(p, at)
            p /= np.repeat(sums, each)
            self.p[a:b] = p
            # The state's total: its first arc's weight and total, less what was taken off it.
            first = a + at
            beta[s + has] = model.log_weight[self.piece[first]] + beta[self.to[first]] - top + np.log(sums)
            x -= np.repeat(np.log(sums), each)
        self.last = np.maximum(self.first[1:-1] - 1, 0)

    def step(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc that each uniform number picks."""
        arc, last, rest = self.first[state], self.last[state], u.copy()
        wait = np.flatnonzero((rest >= self.p[arc]) & (arc < last))
        while len(wait):
            rest[wait] -= self.p[arc[wait]]
            arc[wait] += 1
            wait = wait[(rest[wait] >= self.p[arc[wait]]) & (arc[wait] < last[wait])]
        return arc

    def walk(self, arc: np.ndarray, key: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """A path from each arc, itself included, to the end of its word: all arcs, and the arcs of each."""
        early = _stream(_hashed(key, 4000 + r)[:, None], np.arange(16))
        steps, live, turn = [(np.arange(len(arc)), arc)], np.flatnonzero(self.to[arc] != self.end), 0
        state = self.to[arc[live]]
        while len(live):
            got = self.step(state, early[live, turn] if turn < 16 else _uniform(key[live], 5000 + r, turn))
            steps.append((live, got))
            go = self.to[got] != self.end
            live, state, turn = live[go], self.to[got[go]], turn + 1
        return _by_owner(steps, len(arc))

    def paths(self, begin: np.ndarray, key: np.ndarray, nth: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """A path through each word: all arcs, one word after another, and the arcs of each word."""
        state, live, steps = begin.copy(), np.arange(len(begin)), []
        turn, seed = 0, _hashed(key, nth * 64 + sample)
        while len(live):
            arc = self.step(state, _stream(seed[live], turn))
            steps.append((live, arc))
            state = self.to[arc]
            go = state != self.end
            live, state = live[go], state[go]
            turn += 1
        return _by_owner(steps, len(begin))


def _by_owner(steps: list[tuple[np.ndarray, np.ndarray]], owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of walks that went on side by side, one walk after another, and the arcs of each."""
    count = np.zeros(owners, np.int64)
    for live, _ in steps:
        count[live] += 1
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for turn, (live, arc) in enumerate(steps):
        out[first[live] + turn] = arc
    return out, count


def _cut(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws around a location, given that they are below a limit."""
    with np.errstate(over="ignore"):
        return np.where(np.isfinite(location), location - np.log(np.exp(location - limit) - np.log(u)), -np.inf)


class _Path:
    """One sample of every text of a slice: its arcs, and at each step the value of the paths that turn off there."""

    def __init__(self, arcs: np.ndarray, count: np.ndarray):
        self.arcs, self.count = arcs, count
        self.off = np.concatenate([[0], np.cumsum(count)])


def _segment_max(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each segment and its place; -inf and -1 for an empty one."""
    n = len(off) - 1
    best, at = np.full(n, -np.inf), np.full(n, -1)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        best[full] = np.maximum.reduceat(x, off[:-1][full])
        doc = np.repeat(np.arange(n), np.diff(off))
        hit = np.flatnonzero(x == best[doc])
        at[doc[hit][::-1]] = hit[::-1]
    return best, at


def sample_slice(model: Pieces, data: np.ndarray, off: np.ndarray, key: np.ndarray, samples: int) -> list[dict[str, np.ndarray]]:
    """`samples` segmentations of every text; a text with fewer is left out of the later ones."""
    docs = len(off) - 1
    space = data == 0x20
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data)) if len(start) else start
    doc = np.searchsorted(off, start, "right") - 1
    nth = np.arange(len(start)) - np.searchsorted(doc, doc)
    if len(start):
        _, where, back = np.unique(chunks.distinct(data, start, len(data))[1], return_index=True, return_inverse=True)
        lattice = Lattices(model, data, start[where], end[where])
        begin = lattice.begin[back]
    else:
        lattice, begin = Lattices(model, data, start, end), start
    word_off = np.searchsorted(doc, np.arange(docs + 1))

    word_key = key[doc]

    def fresh(r: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New paths through some of the words, and where each word's begins, those left out being empty."""
        arcs, own = lattice.paths(begin[some], word_key[some], nth[some], r)
        count = np.zeros(len(start) + 1, np.int64)
        count[some + 1] = own
        return arcs, np.cumsum(count)

    def values(path: _Path, limit: np.ndarray, fixed: np.ndarray, r: int) -> None:
        """Log probability, and the entries beyond the first `fixed` steps.

        A step's entry is at most the log probability of what lies before it plus MOST_NOISE. That
        only falls, so behind the step where it is below `samples` entries of the first NEAR steps
        no entry is ever the best, and none is drawn.
        """
        sums = path.sums = np.concatenate([[0.0], np.cumsum(lattice.log_p[path.arcs])])
        path.log_prob = sums[path.off[1:]] - sums[path.off[:-1]]
        path.entry = np.full(len(path.arcs), -np.inf)
        seed = _hashed(key, 1000 + r)

        def draw(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = stop - start
            owner = np.repeat(np.arange(docs), size)
            place = np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)
            rest = 1 - lattice.p[path.arcs[place]]
            with np.errstate(divide="ignore"):
                location = sums[place] - sums[path.off[owner]] + np.where(rest > 1e-12, np.log(np.maximum(rest, 1e-300)), -np.inf)
            path.entry[place] = _cut(location, limit[owner], _stream(seed[owner], place - path.off[owner]))
            return owner, place

        begin, stop = path.off[:-1] + fixed, path.off[1:]
        near = np.minimum(begin + NEAR, stop)
        owner, place = draw(begin, near)
        early = np.full((docs, max(NEAR, samples)), -np.inf)
        early[owner, place - begin[owner]] = path.entry[place]
        least = np.partition(early, -samples, axis=1)[:, -samples] + sums[path.off[:-1]] - MOST_NOISE
        low, high = near, stop  # the first step behind `near` with less than `least` before it lies between
        while (low < high).any():
            middle = (low + high) // 2
            over = sums[middle] >= least
            low, high = np.where((low < high) & over, middle + 1, low), np.where((low < high) & ~over, middle, high)
        draw(near, low)

    out = []
    paths: list[_Path] = []
    barred: dict[tuple[int, int, int], list[int]] = {}
    value = -np.log(-np.log(_uniform(key, 999)))
    alive = np.ones(docs, bool)
    for r in range(samples):
        if r == 0:
            arcs, first = fresh(0, np.arange(len(start)))
            path = _Path(arcs, first[word_off[1:]] - first[word_off[:-1]])
            values(path, value, np.zeros(docs, np.int64), 0)
        else:
            best, places = (np.stack(x) for x in zip(*(_segment_max(p.entry, p.off) for p in paths), strict=True))
            value, which = best.max(axis=0), best.argmax(axis=0)
            alive &= np.isfinite(value)
            turned = np.flatnonzero(alive)
            place = places[which, np.arange(docs)]
            branch, chosen, before, depth = (np.zeros(docs, t) for t in (np.int64, lattice.first.dtype, float, np.int64))
            for k, old in enumerate(paths):
                some = turned[which[turned] == k]
                at = place[some]
                branch[some] = old.words[np.searchsorted(old.ends, at, "right")]
                chosen[some], before[some], depth[some] = old.arcs[at], old.sums[at] - old.sums[old.off[some]], at - old.off[some]
            arcs, first = fresh(r, np.flatnonzero(alive[doc] & (np.arange(len(start)) > branch[doc])))
            pick = _uniform(key, 2000 + r)
            states = np.searchsorted(lattice.first, chosen, "right") - 1
            turn_off, location = np.zeros(docs, np.int64), np.full(docs, -np.inf)
            for d in turned.tolist():
                taken = barred.setdefault((d, int(which[d]), int(depth[d])), [int(chosen[d])])
                choice = np.array([a for a in range(int(lattice.first[states[d]]), int(lattice.first[states[d] + 1])) if a not in taken])
                p = np.cumsum(lattice.p[choice])
                arc = int(choice[min(int(np.searchsorted(p, p[-1] * pick[d], "right")), len(choice) - 1)])
                rest = max(0.0, 1 - lattice.p[taken].sum() - lattice.p[arc])
                taken.append(arc)
                turn_off[d] = arc
                if rest > 1e-12 and len(choice) > 1:
                    location[d] = before[d] + np.log(rest)
            entry = _cut(location[turned], value[turned], _uniform(key[turned], 3000 + r))
            for k, old in enumerate(paths):
                some = which[turned] == k
                old.entry[place[turned[some]]] = entry[some]
            rests, size = lattice.walk(turn_off[turned], key[turned], r)
            ends = np.cumsum(size)
            parts, counts, fixed = [], np.zeros(docs, np.int64), np.zeros(docs, np.int64)
            fixed[turned] = depth[turned] + 1
            for d, s, e in zip(turned.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                old = paths[which[d]]
                whole = [old.arcs[old.off[d] : place[d]], rests[s:e], arcs[first[branch[d] + 1] : first[word_off[d + 1]]]]
                counts[d] = sum(map(len, whole))
                parts += whole
            path = _Path(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), counts)
            values(path, value, fixed, r)
        # The words in the path, and the step behind each: a word's last step reaches the end state.
        path.words = np.flatnonzero(alive[doc]) if len(doc) else np.zeros(0, np.int64)
        path.ends = np.flatnonzero(lattice.to[path.arcs] == lattice.end) + 1
        paths.append(path)
        out.append({"alive": alive.copy(), "value": value.copy(), "log_prob": path.log_prob, "ids": lattice.piece[path.arcs], "count": path.count})
    limit = np.stack([_segment_max(p.entry, p.off)[0] for p in paths]).max(axis=0)
    for got in out:
        with np.errstate(over="ignore"):
            got["inclusion"] = -np.expm1(-np.exp(got["log_prob"] - limit))
    return out


def normal(column: pa.Array) -> pa.Array:
    """What the model's lattice reads: a word mark before a text that is not empty, and for each space."""
    column = pc.fill_null(column, "")
    column = pc.replace_substring(column, "▁", " ")
    return pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise("", column, " "))


def sampled(docs: DataFrame, model_path: str, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to `samples` rows for each row of `docs`, best first: a segmentation's ids and scores, and whether it decodes to the text.

    A null or empty text has one segmentation, without pieces, as any text with fewer than
    `samples` has fewer rows. A null id draws like id 0. Repeated rows draw alike; an empty
    table gives no rows; paths of equal score can't be told apart by their draws, which are
    hashes, and are taken in order of place; other columns don't matter. The word mark itself,
    in a text, reads as a space. Needs no shuffle. The model's file has ranks and no
    probabilities, so a piece's weight is a power law of its rank. A lattice takes some hundred
    times the bytes of a slice's different words, so one word of many megabytes needs as much.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(model_path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE_BYTES):
                data, off = tk.utf8(normal(part.column("text")))
                key = pc.fill_null(part.column("doc_id"), 0).to_numpy().astype(np.int64).view(_U)
                for r, got in enumerate(sample_slice(model, data, off, key, samples)):
                    keep = np.flatnonzero(got["alive"])
                    raw, size = model.decode(got["ids"], got["count"])
                    fits = size == np.diff(off)
                    if fits.all():
                        wrong = np.concatenate([[0], np.cumsum(raw != data)])
                        fits &= wrong[off[1:]] == wrong[off[:-1]]
                    else:
                        ends = np.cumsum(size)
                        fits = np.array([raw[e - n : e].tobytes() == data[s:t].tobytes() for e, n, s, t in zip(ends, size, off[:-1], off[1:], strict=True)])
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(got["count"])]).astype(np.int32), pa.array(got["ids"], pa.int32()))
                    columns = [part.column("doc_id"), pa.array(np.full(part.num_rows, r + 1, np.int32)), pa.array(got["count"]), pa.array(got["log_prob"]), pa.array(got["value"]), pa.array(got["inclusion"]), pa.array(fits), lists]
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in columns] if len(keep) < part.num_rows else columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(drawn, SCHEMA)


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with their texts: the pieces' bytes joined, without the first word mark; null ids have a null text."""
    from pyspark.sql.types import StringType, StructField, StructType

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else b"".join(model.raw[k] for k in ids)[1:].decode("utf-8", "replace") for ids in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(joined, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
