"""Two strings that a polynomial modulo 2**64 with an odd base can't tell apart, in every operator that compares words, lines or texts."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from thermoline.llm import ngram_join, quality_rules, segment_sampling
from thermoline.llm import textkit as tk

ONE = "a"
for _ in range(10):
    ONE += ONE.translate(str.maketrans("ab", "ba"))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def test_they_meet_in_the_polynomial():
    data, off = tk.utf8(pa.array([ONE, TWO]))
    h = tk.Words(data, off).span_hash(off[:-1], off[1:])
    assert h[0] == h[1]


def test_digests():
    text = f"one {ONE}\n{TWO} one {ONE}"
    data, off = tk.utf8(pa.array([text, "one"]))
    w = tk.Words(data, off)
    want = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=b"thermoline").digest(), "little") for x in [*text.split(), "one"]]
    assert w.hashes().tolist() == want
    edge = np.array([0, 3, 3, 10]), np.array([3, 3, 10, 11])  # spans that touch, and an empty one
    assert tk.digests(data, edge[0][[0, 2, 3]], edge[1][[0, 2, 3]]).tolist() == [int.from_bytes(hashlib.blake2b(text[s:e].encode(), digest_size=8, key=b"thermoline").digest(), "little") for s, e in ((0, 3), (3, 10), (10, 11))]
    assert len(tk.digests(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_quality_rules():
    got = quality_rules.measure(pa.array([f"{ONE}\n{TWO}\n{ONE}", f"{ONE} x y {TWO} x y"]))
    assert got["n_dup_lines"].tolist() == [1, 0] and got["n_repeat_words"].tolist() == [0, 0]


def test_join(table):
    rows = table([(1, ONE), (2, TWO), (3, ONE)])
    assert sorted(x.doc_id for x in ngram_join.one_of_each(rows).collect()) == [1, 2]


@pytest.mark.parametrize("order", [(ONE, TWO), (TWO, ONE)])
def test_segments(table, order):
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = segment_sampling.sampled(table([(1, order[0]), (2, order[1])]), model).collect()
    alone = segment_sampling.sampled(table([(1, order[0])]), model).collect() + segment_sampling.sampled(table([(2, order[1])]), model).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, alone), key=str)
