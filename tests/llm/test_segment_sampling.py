import math
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from thermoline.llm import segment_sampling as g
from thermoline.llm import textkit as tk

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return g.Pieces(PATH)


def paths(model, text):
    """Every segmentation of a text with its probability."""
    raw = (" " + text.replace("▁", " ")).encode() if text else b""
    table = {}
    for k, r in enumerate(model.raw):
        if r and k not in model.byte_id:
            table.setdefault(r, k)
    starts = [k for k in range(len(raw)) if raw[k] & 0xC0 != 0x80] + [len(raw)]
    ends = dict(zip(starts, starts[1:], strict=False))
    memo = {len(raw): [((), 0.0)]}
    for at in reversed(starts[:-1]):
        out = []
        for to in (e for e in starts if e > at):
            piece = table.get(raw[at:to])
            if piece is not None:
                out += [((piece, *p), w + model.log_weight[piece]) for p, w in memo[to]]
        if raw[at : ends[at]] not in table:
            ids = tuple(int(model.byte_id[b]) for b in raw[at : ends[at]])
            out += [((*ids, *p), w + sum(model.log_weight[k] for k in ids)) for p, w in memo[ends[at]]]
        memo[at] = out
    all_paths = memo[0]
    total = math.log(sum(math.exp(w) for _, w in all_paths))
    return {p: w - total for p, w in all_paths}


def draw(model, texts, keys, samples):
    data, off = tk.utf8(g.normal(pa.array(texts)))
    out = []
    for got in g.sample_slice(model, data, off, np.array(keys, np.uint64), samples):
        ends = np.cumsum(got["count"])
        out.append([(tuple(got["ids"][e - n : e].tolist()), float(lp), float(v), float(q)) if ok else None for e, n, lp, v, q, ok in zip(ends, got["count"], got["log_prob"], got["value"], got["inclusion"], got["alive"], strict=True)])
    return out


def test_samples_are_paths_with_their_probabilities(model):
    texts = ["ab c", "the the", "a", "", "  x ", "é日", "\U0001f600a", "hello", "\n\t", "▁a"]
    for k in range(20):
        got = draw(model, texts, [k] * len(texts), 3)
        for d, t in enumerate(texts):
            every = paths(model, t)
            mine = [x[d] for x in got if x[d]]
            assert len(mine) == min(3, len(every)), t
            assert len({m[0] for m in mine}) == len(mine)
            for ids, lp, _, q in mine:
                assert lp == pytest.approx(every[ids], abs=1e-9)
                assert 0 <= q <= 1
            assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)


def test_draws_follow_sampling_without_replacement(model):
    n, text = 30_000, "tion a"
    every = paths(model, text)
    first, second = draw(model, [text] * n, range(n), 2)
    assert sum(math.exp(w) for w in every.values()) == pytest.approx(1)
    p = {k: math.exp(w) for k, w in every.items()}
    one, two = Counter(x[0] for x in first), Counter(x[0] for x in second)
    for path, share in sorted(p.items(), key=lambda x: -x[1])[:8]:
        assert abs(one[path] - n * share) < 5 * math.sqrt(n * share * (1 - share)) + 1
        later = sum(q * share / (1 - q) for other, q in p.items() if other != path)
        assert abs(two[path] - n * later) < 5 * math.sqrt(n * later) + 1


def test_inclusion_scores_are_unbiased(model):
    """Weighting each sampled path by probability over inclusion sums to 1 on average."""
    n = 20_000
    got = draw(model, ["stre on"] * n, range(n), 3)
    total = sum(math.exp(lp) / q for x in got for _, lp, _, q in x) / n
    assert total == pytest.approx(1, abs=0.03)


def test_draws_do_not_depend_on_neighbours(model):
    texts = ["some words here", "and other words", "more"]
    together = draw(model, texts, [5, 6, 7], 2)
    for d, (t, k) in enumerate(zip(texts, [5, 6, 7], strict=True)):
        alone = draw(model, [t], [k], 2)
        for r in range(2):
            assert together[r][d][0] == alone[r][0][0] and together[r][d][2] == pytest.approx(alone[r][0][2])


def test_round_trip(spark, real, table, odd):
    docs = real.select("doc_id", "text").union(table(odd).select("doc_id", "text"))
    rows = g.sampled(docs, PATH)
    assert rows.where("NOT round_trip").count() == 0
    back = g.decoded(rows, PATH)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    assert all(r.decoded in texts[r.doc_id] for r in back.select("doc_id", "decoded").collect())
    assert rows.where("sample = 1").count() == docs.count()
    assert g.sampled(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("samples", [2, 5])
def test_entries_that_cannot_win_change_nothing(monkeypatch, model, samples):
    """All entries drawn, and only those behind which none can be the best."""
    rng = np.random.default_rng(5)
    words = np.array("the of segmentation unbelievable naïve corpus 中文 xqzt running a".split())
    texts = ["", " x", *(" " + " ".join(rng.choice(words, n)) for n in (3, 40, 400, 3000))]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    key = np.arange(len(texts), dtype=np.uint64)
    got = []
    for near in (1, 20000):
        monkeypatch.setattr(g, "NEAR", near)
        got.append(g.sample_slice(model, data, off, key, samples))
    for some, every in zip(*got, strict=True):
        assert all(np.array_equal(some[k], every[k]) for k in some)
