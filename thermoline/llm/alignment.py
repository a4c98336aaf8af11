"""Alignment of the tokens of two tokenizers over the same bytes.

Tokens of B are disjoint intervals in order, so the arrays of their starts and ends are a
static interval index; two bisections give the range of B tokens that an A token overlaps.
A gap between neighbouring B tokens that no A token spans is a boundary of groups, and the
two tokens that end there are linked.

No token of either reaches over a cut (see `chunks`), so each distinct chunk of a worker is
encoded and aligned once, and a text's tokens, groups and links are those of its chunks in
order. Linked tokens end together, so one is a suffix of the other: the pairs that can be
linked follow from the two vocabularies, and corpus-wide counts are one bounded array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import chunks
from thermoline.llm import textkit as tk
from thermoline.llm.workspace import stored

#: Known chunks of a worker, about 600 bytes each, and bytes of a text that are looked at together.
CHUNKS_KEPT, PIECE_BYTES = 200_000, 4 << 20
#: A writer of links holds so many bytes before they go to disk.
ROW_GROUPS = {"parquet.block.size": str(16 << 20)}
MARK = "▁"
_TABLE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_sign() -> dict[str, int]:
    """The bytes behind the signs of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def overlaps(b_start: np.ndarray, b_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stabbing queries of intervals against disjoint intervals in order: those from the first to before the second are overlapped."""
    return np.searchsorted(b_end, start, "right"), np.searchsorted(b_start, end, "left")


def boundaries(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens that cover the same bytes: the last A token and the last B token of each group."""
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    low, high = overlaps(b_start, b_end, a_start, a_end)
    edge = np.zeros(len(b_end) + 1, np.int64)  # a token that overlaps B tokens low to high - 1 spans the gaps behind low to high - 2
    np.add.at(edge, low, 1)
    np.add.at(edge, high - 1, -1)
    last_b = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    last_a = np.searchsorted(a_end, b_end[last_b], "left")
    return last_a, last_b


class Aligner:
    """Both tokenizers of a worker, and what is known of chunks."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = chunks.BytePairs(a_path, plain_special=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        sign = byte_of_sign()
        self.a_bytes = [b""] * len(self.a.bytes_of)
        for token, k in self.a.tokenizer.get_vocab().items():
            self.a_bytes[k] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.pairs = self._pairs()
        self._forget()

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(MARK, " ").encode()

    def _pairs(self) -> np.ndarray:
        """A id * B's size + B id of all pairs of which one's bytes end with the other's, in order."""
        a_of, b_of = dict[bytes, list[int]](), dict[bytes, list[int]]()
        for of, table in ((a_of, self.a_bytes), (b_of, self.b_bytes)):
            for k, raw in enumerate(table):
                of.setdefault(raw, []).append(k)
        many, found = len(self.b_bytes), set[int]()
        for raw, ids in a_of.items():
            found.update(a * many + b for k in range(len(raw)) for b in b_of.get(raw[k:], ()) for a in ids)
        for raw, ids in b_of.items():
            found.update(a * many + b for k in range(len(raw)) for a in a_of.get(raw[k:], ()) for b in ids)
        return np.array(sorted(found), np.int64)

    def _forget(self) -> None:
        self.known, self.links, self.shown = chunks.Numbered(CHUNKS_KEPT), chunks.Lists(), list[str]()
        self.counts, self.sound = np.zeros((0, 3), np.int64), np.zeros(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        """Encode and align chunks that weren't known; a chunk that B doesn't give back has no tokens and isn't sound."""
        a_size, a_ids = self.a.encode(new)
        b_lists = self.b.encode([c[1:].decode() for c in new], num_threads=1) if new else []
        sound = np.array([b"".join([self.b_bytes[k] for k in ids]) == c for ids, c in zip(b_lists, new, strict=True)], bool)
        b_size = np.array([len(x) for x in b_lists], np.int64) * sound
        b_ids = np.array([k for x, good in zip(b_lists, sound.tolist(), strict=True) if good for k in x], np.int64)
        a_ids, a_size = a_ids[np.repeat(sound, a_size)].astype(np.int64), a_size * sound
        a_length, b_length = self.a.bytes_of[a_ids], np.array([len(self.b_bytes[k]) for k in b_ids.tolist()], np.int64)
        last_a, last_b = boundaries(np.cumsum(a_length), np.cumsum(b_length))
        pair = a_ids[last_a] * len(self.b_bytes) + b_ids[last_b]
        place = np.searchsorted(self.pairs, pair)
        if len(pair) and not np.array_equal(self.pairs[np.minimum(place, len(self.pairs) - 1)], pair):
            raise ValueError("tokens that end together aren't suffixes of one another")
        chunk_of = np.searchsorted(np.cumsum(b_size), last_b, "right")
        groups = np.bincount(chunk_of, minlength=len(new)).astype(np.int64)
        self.links.add(groups, place.astype(np.int32))
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        a_to, b_to = (last_a + 1).tolist(), (last_b + 1).tolist()
        parts = [f"{','.join(a_text[s:e])}|{','.join(b_text[t:f])}" for s, e, t, f in zip([0, *a_to[:-1]], a_to, [0, *b_to[:-1]], b_to, strict=True)] if a_to else []
        ends = np.cumsum(groups).tolist()
        self.shown += [";".join(parts[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        self.counts = np.concatenate([self.counts, np.stack([a_size, b_size, groups], axis=1)])
        self.sound = np.concatenate([self.sound, sound])

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known chunks of some texts, one after another, and the first of each text."""
        if self.known.full():
            self._forget()
        cut = chunks.cuts(data)
        cut[off[:-1]] = True
        start = np.flatnonzero(cut)
        which, new = self.known.of(data, start, len(data))
        self._learn(new)
        return which, np.searchsorted(start, off)

    def align(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """For each text, which begins with the added space: its tokens in A and B, groups, links, digest and places of linked pairs."""
        if len(off) == 2 and off[1] > 2 * PIECE_BYTES:
            yield self._long(data)
            return
        which, first = self._chunks(data, off)
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.counts[which], axis=0)])
        bad = np.concatenate([[0], np.cumsum(~self.sound[which])])
        links, ends = self.links.take(which), sums[:, 2]
        shown, numbers = self.shown, which.tolist()
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if bad[e] > bad[s]:
                yield NOTHING
                continue
            n_a, n_b, n = (sums[e] - sums[s]).tolist()
            digest = hashlib.sha256(";".join([shown[k] for k in numbers[s:e]]).encode()).hexdigest()
            yield n_a, n_b, n, n, digest, links[ends[s] : ends[e]]

    def _long(self, data: np.ndarray) -> tuple[int, int, int, int, str, np.ndarray]:
        """One long text, piece by piece; pieces meet at cuts."""
        at, reach, total, digest, links = 0, PIECE_BYTES, np.zeros(3, np.int64), hashlib.sha256(), []
        while at < len(data):
            piece = data[at : at + reach]
            if at + reach < len(data):
                inner = np.flatnonzero(chunks.cuts(piece))
                if not len(inner):
                    reach *= 2
                    continue
                piece = piece[: inner[-1]]
            which, _ = self._chunks(piece, np.array([0, len(piece)]))
            if not self.sound[which].all():
                return NOTHING
            digest.update((";" * (at > 0) + ";".join([self.shown[k] for k in which.tolist()])).encode())
            total += self.counts[which].sum(axis=0)
            links.append(self.links.take(which))
            at, reach = at + len(piece), PIECE_BYTES
        n_a, n_b, n = total.tolist()
        return n_a, n_b, n, n, digest.hexdigest(), np.concatenate(links)


#: A text without tokens.
NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int32))
_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner a Python worker: what it knows serves all tasks of the worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: numbers of tokens, groups and links, digest of the groups, and the places of its linked pairs in `Aligner.pairs`, 4 bytes each."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner_of(a_path, b_path)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                text = part.column("text")
                full = pc.fill_null(pc.greater(pc.binary_length(text), 0), False).to_numpy(zero_copy_only=False)
                rows = [NOTHING] * part.num_rows
                if full.any():
                    # A large type: a space before a text of 2 GiB would not fit another.
                    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text.filter(pa.array(full)).cast(pa.large_string()), pa.scalar("", pa.large_string()))
                    for k, got in zip(np.flatnonzero(full).tolist(), known.align(*tk.utf8(spaced)), strict=True):
                        rows[k] = got
                *plain, links = zip(*rows, strict=True)
                raw = pa.array([x.astype("<i4").tobytes() for x in links], pa.binary())
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(plain, types, strict=True)), raw], [x.split()[0] for x in _TABLE.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(aligned, _TABLE)


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of all rows, one after another, and where each row's begin."""
    raw, off = tk.utf8(batch.column("links"))
    return raw.view("<i4"), off // 4


def pair_counts(links: DataFrame, pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair. Tasks count into an array of the pairs, of which only what isn't zero is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(pairs, np.int64)
        for batch in batches:
            n += np.bincount(_places(batch)[0], minlength=pairs)
        place = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n[place])], ["place", "n"])

    # No more rows than pairs that the two vocabularies allow.
    got = links.select("links").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(pairs, np.int64)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, in two passes: tokens, groups and links of each text, then counts of its linked pairs over all texts.

    A is a byte-level BPE file of the tokenizers library, B a SentencePiece model with an added
    space in front whose pieces hold the mark of a space at their beginning only. A text that is
    null or empty, or that B doesn't give back byte by byte (it holds U+2581, say), has no tokens:
    zeros and an empty digest. A null id stays null, repeated rows count each by itself, an empty
    table gives no rows, and other columns are not looked at, whatever their names. A long text is
    taken in pieces; of a stretch without cuts the whole is encoded at once. Counts are sums over
    all links of all rows, so a frequent pair is one row of each task; the array of counts has one
    place for each pair that the vocabularies allow (some hundred thousand) and is all that the
    driver and the tasks share.
    """
    known = aligner_of(a_path, b_path)
    table = stored(linked(docs, a_path, b_path, id_col, text_col), "links", **ROW_GROUPS)
    counts = pair_counts(table, len(known.pairs))
    b_of = known.pairs % len(known.b_bytes)
    best = np.zeros(len(known.b_bytes), np.int64)
    np.maximum.at(best, b_of, counts)
    highest = counts == best[b_of]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _places(batch)
            sums = (np.concatenate([[0], np.cumsum(x)]) for x in (highest[flat].astype(np.int64), counts[flat]))
            n_best, count_sum = (pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], n_best, count_sum, batch.column("groups_sha256")], [x.split()[0] for x in ALIGNED.split(", ")])

    return table.mapInArrow(scored, ALIGNED)
