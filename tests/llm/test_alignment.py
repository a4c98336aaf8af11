import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from thermoline.llm import alignment as al
from thermoline.llm import chunks, queries
from thermoline.llm import textkit as tk

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
SIGN = al.byte_of_sign()


def tokens(text):
    """Ids and bytes of the tokens of both, over the whole text at once; none where there are none by the rule."""
    if not text:
        return None
    whole = (" " + text).encode()
    got = A.encode(" " + text, add_special_tokens=False)
    a = [(k, bytes(SIGN[c] for c in t)) for k, t in zip(got.ids, got.tokens, strict=True)]
    b = [(k, bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode()) for k in B.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    return a, b


def brute(rows):
    """Groups by walking over both lists; counts over all rows."""
    done, count = [], Counter()
    for doc_id, text in rows:
        got = tokens(text)
        if got is None:
            done.append((doc_id, 0, 0, [], []))
            continue
        a, b = got
        groups, links, i, j, at, ends = [], [], 0, 0, [0, 0], []
        while i < len(a) or j < len(b):
            s, t = i, j
            while True:
                if at[0] <= at[1]:
                    at[0] += len(a[i][1])
                    i += 1
                else:
                    at[1] += len(b[j][1])
                    j += 1
                if at[0] == at[1]:
                    break
            ends.append(at[0])
            groups.append(f"{','.join(str(k) for k, _ in a[s:i])}|{','.join(str(k) for k, _ in b[t:j])}")
            links.append((a[i - 1][0], b[j - 1][0]))
        assert len(set(ends)) == len(links)
        count.update(links)
        done.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in done]


def same(got, rows):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns[:8] == columns
    assert sorted((tuple(r[:8]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


PIECES = ["a", "Word", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "é", "ß", "日本", "\U0001f600", "'s", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "12", ".", "!?", "\r\n", "\x1c", "à", "\x00", " the", "ing"]


def test_chunks_have_the_tokens_of_the_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice([*PIECES, "▁"] if k % 9 == 0 else PIECES) for _ in range(rng.randint(1, 40))) for k in range(3000)]
    known = al.Aligner(A_PATH, B_PATH)
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        for text, (n_a, n_b, n, _, digest, links) in zip(some, known.align(*tk.utf8(pa.array([" " + t for t in some]))), strict=True):
            want = brute([(0, text)])[0]
            assert (n_a, n_b, n, digest) == (*want[1:4], want[7]), repr(text)
            assert len(links) == n
    assert sum(tokens(t) is None for t in texts) > 50


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(PIECES) for _ in range(30_000)) + "x" * 30_000 + " tail of it"
    whole = brute([(0, text)])[0]
    monkeypatch.setattr(al, "PIECE_BYTES", 5000)
    (got,) = al.Aligner(A_PATH, B_PATH).align(*tk.utf8(pa.array([" " + text])))
    assert (*got[:3], got[4]) == (*whole[1:4], whole[7])
    (got,) = al.Aligner(A_PATH, B_PATH).align(*tk.utf8(pa.array([" " + text + " ▁ x"])))
    assert got[:5] == al.NOTHING[:5]


def test_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(al, "CHUNKS_KEPT", 3)
    known = al.Aligner(A_PATH, B_PATH)
    for text in ("one two three four", "five one six", "one two", "seven"):
        (got,) = known.align(*tk.utf8(pa.array([" " + text])))
        assert (*got[:3], got[4]) == (*brute([(0, text)])[0][1:4], brute([(0, text)])[0][7])
    assert known.known.count < 5


def test_boundaries_by_intervals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in range(2))
        last_a, last_b = al.boundaries(a, b)
        common = np.intersect1d(a, b)
        assert a[last_a].tolist() == b[last_b].tolist() == common.tolist()
        starts = np.concatenate([[0], b[:-1]])
        low, high = al.overlaps(starts, b, np.concatenate([[0], a[:-1]]), a)
        for s, e, lo, hi in zip([0, *a[:-1].tolist()], a.tolist(), low.tolist(), high.tolist(), strict=True):
            assert [k for k in range(len(b)) if starts[k] < e and b[k] > s] == list(range(lo, hi))


def test_chunks_are_told_apart_by_bytes():
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    strings, which = chunks.distinct(np.frombuffer((one + two + one).encode(), np.uint8), np.array([0, 1024, 2048]), 3072)
    assert strings == [one.encode(), two.encode()] and which.tolist() == [0, 1, 0]


def test_numbers_go_by_bytes():
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rng = random.Random(4)
    for first in (one, two):  # the colliding string is new in one slice and known in another
        known, told = chunks.Numbered(1 << 20), {}
        for k in range(6):
            strings = [rng.choice(["x", "yy", "", "zzz", one, two, f"n{k}", f"m{k}"]) for _ in range(50)] if k else [first, "x"]
            raw = [s.encode() for s in strings if s]
            start = np.cumsum([0, *map(len, raw)])
            number, new = known.of(np.frombuffer(b"".join(raw), np.uint8), start[:-1], int(start[-1]))
            base = len(told)
            for n, s in enumerate(new):
                told[base + n] = s
            assert [told[n] for n in number.tolist()] == raw
            assert known.count == len(told)
    assert chunks.equal(*(np.frombuffer(b"abcab", np.uint8), np.array([0, 0, 2, 5]), np.array([2, 3, 1, 0])), *(np.frombuffer(b"ababd", np.uint8), np.array([2, 0, 2, 1]), np.array([2, 3, 1, 0]))).tolist() == [True, False, False, True]


def test_table(spark, real):
    rows = [(x.doc_id, x.text) for x in real.collect()]
    same(queries.op13_interval_alignment(spark, "/root/testdata/sf0.001"), rows)


def test_odd_rows(table, odd):
    rows = [*odd, (9, "has ▁ in it"), (10, " starts with a space"), (11, "ends\n"), (12, "x <s> <|endoftext|> y"), (13, "same words same words")]
    same(al.aligned(table(rows), A_PATH, B_PATH), rows)
    same(al.aligned(table([]), A_PATH, B_PATH), [])
    same(al.aligned(table([(1, None), (2, "")]), A_PATH, B_PATH), [(1, None), (2, "")])
